"""Task pipelines: from input tables to a one-row report, by a route. Nothing runs until the report is read.

Model scores (speech recognition, speaker similarity, opinion scores, learned translation metrics) come from providers: a table of
scores or transcripts by sample, or any function from a sample table to one (a `mapInPandas` or a pandas UDF over a model).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal, spoken, text, tokens
from ..operators import alignment, diarization, metrics
from ..sources.structured import label_of, label_spec
from .routes import OPINIONS, SPEAKERS, Route, find

Provider = DataFrame | Callable[[DataFrame], DataFrame]


def require(inputs: dict, route: Route) -> None:
    """Raise, with their names, for roles that a route needs and the inputs lack."""
    absent = [r for r in route.roles if inputs.get(r) is None]
    if absent:
        raise ValueError(f"{route.pipeline_id()} needs {', '.join(absent)}")


def normalised(df: DataFrame, name: str, language: str, column: str = "text") -> DataFrame:
    """df with its text normalised by a route's component."""
    c = F.coalesce(F.col(column), F.lit(""))
    if name.startswith("whisper"):
        out = spoken.chain("english")(c)
    elif name.startswith("canonical"):
        out = spoken.chain("canonical" if language == "zh" else "canonical_mixed")(c)
    elif name.startswith("wetext"):
        out = text.strip_for_scoring(spoken.chain("spoken_zh")(spoken.chain("fold")(c)))
    elif name.startswith("aispeech"):
        out = text.strip_for_scoring(spoken.chain(f"recogniser_{language}" if language in ("zh", "cs") else "recogniser_en")(c))
    elif name.startswith("gstar"):
        out = text.speaker_normalise(c, language)
    else:
        raise LookupError(f"no normaliser {name}")
    return df.withColumn(column, out)


def _report(df: DataFrame, route: Route, language: str | None) -> DataFrame:
    return df.select(F.lit(route.pipeline_id(language)).alias("pipeline_id"), F.lit(route.metric).alias("metric"), "*")


def asr(ref: DataFrame, hyp: DataFrame, language: str = "en", metric: str | None = None, **selectors) -> DataFrame:
    """Error rate of key-text tables (line_at, key, text). zh counts characters and cs both, whatever rate is asked for."""
    metric = {"zh": "cer", "cs": "mer"}.get(language, metric or "wer")
    route = find("asr", language, metric, **selectors)
    r, h = (normalised(t, route.chain[0], language) for t in (ref, hyp))
    pairs = alignment.left_pairs(r, h)
    if route.chain[1].startswith("token_"):
        out = metrics.error_rate(metrics.spacing_repaired(pairs))
    elif metric == "mer":
        out = metrics.code_switch_rates(pairs).withColumn("score", F.col("mer"))
    else:
        out = metrics.error_rate(metrics.scored(pairs, tokens.scoring_characters if metric == "cer" else tokens.words))
    return _report(metrics.require_tokens(out), route, language)


def s2tt(ref: DataFrame, hyp: DataFrame, language: str = "en", metric: str = "bleu", src: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """Translation quality of key-text tables, matched by key; learned metrics read the provider's (key, score)."""
    route = find("s2tt", language, metric)
    if metric in ("xcomet_xl", "bleurt_20"):
        tables = [t for t in (src, ref, hyp) if t is not None]
        alignment.require_same_keys(*tables)
        rows = alignment.triples(src if src is not None else ref, ref, hyp)
        return _report(metrics.segment_mean(_provided(rows, provider, "key")), route, language)
    pairs = alignment.left_pairs(ref, hyp).withColumnRenamed("key", "id")  # a missing hypothesis is an empty one
    out = metrics.chrf(pairs) if route.metric == "chrf" else metrics.bleu(pairs, tokens.bleu_zh if language == "zh" else tokens.bleu_13a)
    return _report(out, route, language)


def sd(ref: DataFrame, hyp: DataFrame, collar: float = 0.25) -> DataFrame:
    """Mean diarisation error over sessions of segment tables."""
    return _report(diarization.session_mean(diarization.der(ref, hyp, collar)), find("sd", None, "der"), None)


def sa_asr(ref: DataFrame, hyp: DataFrame, language: str = "en", collar: float = 0.5) -> DataFrame:
    """Concatenated minimum-permutation error over normalised words, and the diarisation error beside it."""
    r, h = (normalised(t, "gstar_norm", language, "words") for t in (ref, hyp))
    cp = diarization.combined(diarization.cpwer(r, h))
    der = diarization.session_mean(diarization.der(ref, hyp, collar)).select(F.col("score").alias("der"))
    return _report(cp.crossJoin(der), find("sa_asr", None, "cpwer"), language)


def classification(ref: DataFrame, hyp: DataFrame, task: str = "classification", spec: dict | str | None = None) -> DataFrame:
    """Accuracy of labels over all references."""
    s = label_spec(spec, task)
    pairs = alignment.left_pairs(ref, hyp)
    named = pairs.select(label_of(F.col("ref"), s).alias("truth"), F.when(~F.col("missing"), label_of(F.col("hyp"), s)).alias("said"))
    return _report(metrics.accuracy(named, "truth", "said"), find(task.lower(), None, "accuracy"), None)


def slu(ref: DataFrame, hyp: DataFrame, choices: DataFrame, output: str = "id") -> DataFrame:
    """Accuracy of answers, each read as one of its prompt's choices."""
    pairs = alignment.left_pairs(ref, hyp).join(choices.select("key", "choices"), "key", "left")
    read = pairs.select(alignment.choice_answer(F.col("ref"), F.col("choices"), output)["answer"].alias("truth"), F.when(~F.col("missing"), alignment.choice_answer(F.col("hyp"), F.col("choices"), output)["answer"]).alias("said"))
    named = read.select(text.label_value(F.col("truth")).alias("truth"), text.label_value(F.col("said")).alias("said"))
    return _report(metrics.accuracy(named, "truth", "said"), find("slu", None, "accuracy"), None)


def kws(samples: DataFrame, metric: str = "accuracy", threshold: float = 0.5, budget: int = 0, step: float = 0.01, input_mode: str = "json_pair") -> DataFrame:
    """Accuracy at a threshold, or the most recall within a budget of false alarms."""
    route = find("kws", None, metric, input_mode=input_mode)
    if route.metric == "accuracy":
        return _report(metrics.kws_report(samples, threshold).withColumn("score", F.col("accuracy")), route, None)
    return _report(metrics.best_recall(metrics.det_curve(samples, step), budget), route, None)


def _provided(rows: DataFrame, provider: Provider | None, key: str) -> DataFrame:
    """rows with the provider's columns; a sample without a score, or with several, raises."""
    if provider is None:
        raise ValueError("a provider is needed for this metric")
    got = provider(rows) if callable(provider) else provider
    one = got.groupBy(key).agg(F.first(F.struct(*[c for c in got.columns if c != key])).alias("x"), F.count("*").alias("n"))
    joined = rows.join(one, key, "left")
    wrong = F.when(F.coalesce("n", F.lit(0)) != 1, F.raise_error(F.concat(F.lit("the provider must give one row for "), F.col(key).cast("string"))).cast("double"))
    return joined.select(*rows.columns, F.coalesce(wrong, F.col("x.score").cast("double")).alias("score"), *[F.col(f"x.{c}").alias(c) for c in got.columns if c not in (key, "score", *rows.columns)])


def audio(samples: DataFrame, task: str, wanted: list[str], language: str | None = None, providers: dict[str, Provider] | None = None) -> DataFrame:
    """A row for each wanted metric of tts, vc, se or tse samples, in the order asked.

    cer and wer read transcripts (sample_id, transcript) and the samples' reference_text (for vc, where there is none, the transcript of
    the reference audio: reference_transcript). si_sdr reads signals from the samples: prediction, reference (and mixed for si_sdri).
    """
    providers = providers or {}
    out = None
    for m in wanted:
        route = find(task, language, m)
        name = route.metric
        if name in ("cer", "wer"):
            rows = samples.join(_given(providers, name, samples), "sample_id")
            truth = F.coalesce("reference_text", "reference_transcript") if task == "vc" and "reference_transcript" in rows.columns else F.col("reference_text")
            at = F.struct(F.lit("").alias("file"))
            r = rows.select(at.alias("line_at"), F.col("sample_id").alias("key"), truth.alias("text"))
            h = rows.select(at.alias("line_at"), F.col("sample_id").alias("key"), F.col("transcript").alias("text"))
            one = asr(r, h, language or "en", name).select("score")
        elif name in ("si_sdr", "si_sdri"):
            kind = "se" if task == "se" else "tse"
            value = signal.si_sdr(F.col("reference"), F.col("prediction"), kind)
            if name == "si_sdri":
                gain = value - signal.si_sdr(F.col("reference"), F.col("mixed"), kind)
                value = F.when(F.isnan(gain), 0.0).otherwise(gain)
            one = samples.agg(signal.finite_mean(value).alias("score"))
        elif name == "stoi" and providers.get(name) is None and {"prediction", "reference", "rate"} <= set(samples.columns):
            one = samples.agg(F.avg(signal.stoi("reference", "prediction", "rate")).alias("score"))
        elif name in SPEAKERS + OPINIONS + ("stoi", "pesq"):
            one = metrics.provider_summary(_provided(samples, providers.get(name), "sample_id"), "score").select("score")
        else:
            raise LookupError(name)
        row = one.select(F.lit(route.pipeline_id(language)).alias("pipeline_id"), F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def _given(providers: dict, name: str, samples: DataFrame) -> DataFrame:
    p = providers.get("transcripts") if "transcripts" in providers else providers.get(name)
    if p is None:
        raise ValueError(f"{name} needs transcripts")
    return p(samples) if callable(p) else p


def run(task: str, inputs: dict, language: str | None = None, metric: str | None = None, **options) -> DataFrame:
    """One entry for all tasks: checks the inputs against the route, then plans its report."""
    if task in ("tts", "vc", "se", "tse"):
        return audio(inputs["samples"], task, [metric] if isinstance(metric, str) else list(metric), language, inputs.get("providers"))
    if task == "kws":
        return kws(inputs["samples"], metric or "accuracy", **options)
    require(inputs, find(task, language, metric))
    if task == "asr":
        return asr(inputs["ref"], inputs["hyp"], language or "en", metric, **options)
    if task == "s2tt":
        return s2tt(inputs["ref"], inputs["hyp"], language or "en", metric or "bleu", inputs.get("src"), inputs.get("provider"))
    if task in ("sd", "sa_asr"):
        return {"sd": sd, "sa_asr": sa_asr}[task](inputs["ref_segments"], inputs["hyp_segments"], **options)
    if task == "slu":
        return slu(inputs["ref"], inputs["hyp"], inputs["choices"], **options)
    return classification(inputs["ref"], inputs["hyp"], task, **options)
