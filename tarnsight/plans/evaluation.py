"""Metrics by name, whole suites of data sets, histories with recommendations, and the comparison of two result tables."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signal, tokens
from ..operators import alignment, metrics, ranking
from ..sources import sinks, structured
from . import pipelines
from .routes import OPINIONS, SPEAKERS

Metric = Callable[..., DataFrame]


def _pairs(scorer: Callable[[DataFrame], DataFrame], id_name: str | None = None) -> Metric:
    def run(ref: DataFrame, hyp: DataFrame, **_) -> DataFrame:
        p = alignment.left_pairs(ref, hyp)
        return scorer(p.withColumnRenamed("key", id_name) if id_name else p)

    return run


def _labels(task: str) -> Metric:
    return lambda ref, hyp, spec=None, **_: pipelines.classification(ref, hyp, task, spec).drop("pipeline_id", "metric")


def _audio(task: str, name: str) -> Metric:
    return lambda samples, language=None, providers=None, **_: pipelines.audio(samples, task, [name], language, providers).select("score")


METRICS: dict[str, Metric] = {
    "wer": _pairs(lambda p: metrics.error_rate(metrics.scored(p))),
    "cer": _pairs(lambda p: metrics.error_rate(metrics.scored(p, tokens.scoring_characters))),
    "mer": _pairs(lambda p: metrics.code_switch_rates(p).withColumn("score", F.col("mer"))),
    "sclite_wer": _pairs(lambda p: metrics.error_rate(metrics.scored(p, weights=(4, 3, 3)))),
    "bleu": _pairs(metrics.bleu, "id"),
    "bleu_char": _pairs(lambda p: metrics.bleu(p, tokens.bleu_zh), "id"),
    "chrf": _pairs(metrics.chrf, "id"),
    "accuracy": _labels("CLASSIFICATION"),
    "ser_accuracy": _labels("SER"),
    "gr_accuracy": _labels("GR"),
    "der": lambda ref, hyp, **_: pipelines.sd(ref, hyp).select("score", "num_sessions"),
    "cpwer": lambda ref, hyp, language="en", **_: pipelines.sa_asr(ref, hyp, language).select("score", "errors", "length"),
    "kws_accuracy": lambda samples, **o: pipelines.kws(samples, "accuracy", **o).drop("pipeline_id", "metric"),
    "macro_recall": lambda samples, **o: pipelines.kws(samples, "macro_recall", **o).drop("pipeline_id", "metric"),
    "xcomet_xl": lambda ref, hyp, src, provider, language="en", **_: pipelines.s2tt(ref, hyp, language, "xcomet_xl", src, provider).select("score"),
    "bleurt_20": lambda ref, hyp, provider, language="en", **_: pipelines.s2tt(ref, hyp, language, "bleurt_20", None, provider).select("score"),
    "si_sdr": _audio("se", "si_sdr"),
    "si_sdri": _audio("tse", "si_sdri"),
    "stoi": _audio("se", "stoi"),
    "pesq": _audio("se", "pesq"),
    **{m: _audio("tts", m) for m in SPEAKERS + OPINIONS},
}


def calculate(name: str, **inputs) -> DataFrame:
    """One row, with a score, of the named metric."""
    if name not in METRICS:
        raise LookupError(f"no metric {name}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name](**inputs)


def calculate_batch(names: list[str], **inputs) -> DataFrame:
    """(metric, score) of several metrics over the same inputs."""
    out = None
    for n in names:
        row = calculate(n, **inputs).select(F.lit(n).alias("metric"), F.col("score").cast("double").alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


RATES = ("wer", "cer", "mer", "accuracy", "der", "cpwer", "macro_recall", "sclite_wer", "ser_accuracy", "gr_accuracy", "kws_accuracy")


def evaluate_all(suite: dict[str, dict]) -> DataFrame:
    """(dataset, metric, score, error) of data sets: {name: {metric, and its inputs}}. Rates are percents of two decimals.

    A data set whose plan can't be made, or whose report fails, has its error in place of a score; the others aren't touched by it.
    """
    spark = SparkSession.getActiveSession()
    rows = []
    for name, given in suite.items():
        inputs = dict(given)
        metric = inputs.pop("metric")
        try:
            score = calculate(metric, **inputs).select(F.col("score").cast("double")).first()[0]
            rows.append((name, metric, None if score is None else round(score * (100 if metric in RATES else 1), 2), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, metric, None, str(e).strip().splitlines()[0][:300]))
    return spark.createDataFrame(rows, "dataset string, metric string, score double, error string")


def strict_accuracy(ref: DataFrame, hyp: DataFrame, task: str = "SER") -> DataFrame:
    """Accuracy as an older facade counts it: by place, over the references and answers that name a label alone."""
    spec = structured.label_spec(None, task)
    both = alignment.positional(ref.select("line_at", F.col("text").alias("ref")), hyp.select(F.col("line_at").alias("hyp_at"), F.col("text").alias("hyp")), ["line_at"], ["hyp_at"])
    named = both.select(structured.label_of(F.col("ref"), spec).alias("truth"), structured.label_of(F.col("hyp"), spec).alias("said"))
    return metrics.accuracy(named.where("truth is not null and said is not null"), "truth", "said")


def sclite_totals(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals of scored rows in percents of the reference words: correct, substituted, deleted, inserted, errors, sentences with errors."""
    r = metrics.error_rate(rows, by)
    share = lambda c: F.round(100 * F.try_divide(F.col(c).cast("double"), F.col("num_tokens")), 1)
    errors = F.round(100 * F.col("score"), 1)
    return r.select(*by, F.col("num_pairs").alias("sentences"), F.col("num_tokens").alias("words"), *[share(c).alias(c) for c in ("cor", "sub", "del", "ins")], errors.alias("err"), F.round(100 * F.col("sentence_error_rate"), 1).alias("s_err"))


def guessed_task(dataset: Column) -> Column:
    """A data set's task, by what its name holds; recognition where it says nothing."""
    low = F.lower(dataset)
    out = F.lit("asr")
    for task, words in (("kws", ("kws", "wake")), ("slu", ("slu", "mmsu", "intent")), ("gr", ("gender",)), ("ser", ("emotion", "iemocap", "ser_")), ("s2tt", ("covost", "s2tt", "translation")), ("sa_asr", ("sa_asr", "cpwer")), ("sd", ("diar", "der_"))):
        for w in words:
            out = F.when(F.contains(low, F.lit(w)), task).otherwise(out)
    return out


def with_rps(scores: DataFrame, baselines: DataFrame, rates: tuple[str, ...] = ()) -> DataFrame:
    """scores (dataset, metric, score, ...) with their relative score against the baseline of the data set, or of its base name."""
    b = baselines.select("dataset", F.col("score").alias("score"), "higher_is_better")
    j = alignment.with_baseline(scores, b)
    rps = signal.relative_score(F.col("score"), F.col("baseline_score"), F.coalesce("baseline_higher_is_better", F.lit(False)), F.col("metric").isin(*rates) if rates else F.lit(False))
    return j.withColumn("rps", rps).drop("baseline_score", "baseline_higher_is_better")


def record(scores: DataFrame, baselines: DataFrame, path: str, rates: tuple[str, ...] = ()) -> DataFrame:
    """Append tools' scores with their relative scores to the store at path; the rows as stored."""
    rows = with_rps(scores, baselines, rates)
    named = [f.split()[0] for f in structured.RECORD.split(", ")]
    missing = {f.split()[0]: f.split(" ", 1)[1] for f in structured.RECORD.split(", ") if f.split()[0] not in rows.columns}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}).select(*named)
    sinks.append_records(rows, path)
    return rows


def recommend(records: DataFrame, dataset: str | None = None) -> DataFrame:
    """(dataset, task, rank, tool_name, rps, score): tools in order of their latest relative score on each data set."""
    rows = records.where(F.col("dataset") == dataset) if dataset else records
    now = ranking.latest(rows, ["dataset", "tool_name"], "timestamp", "tool_name")
    return ranking.ranked(now, "rps", ["tool_name"], ["dataset"]).select("dataset", guessed_task(F.col("dataset")).alias("task"), "rank", "tool_name", "rps", "score")


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, column, left, right) wherever two result tables disagree: absent rows, and values by text, or by more than the tolerance for numbers."""
    a, b = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("_l")), right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("_r"))
    both = a.join(b, keys, "full")
    kinds = {f.name: f.dataType for f in left.schema}
    parts = []
    for c in (c for c in left.columns if c not in keys):
        x, y = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        near = F.abs(x.cast("double") - y.cast("double")) <= tolerance if isinstance(kinds[c], T.NumericType) else x == y
        nan = F.isnan(x) & F.isnan(y) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.lit(False)
        same = F.coalesce(near, F.lit(False)) | nan | (x.isNull() & y.isNull() & F.col("_l").isNotNull() & F.col("_r").isNotNull())
        parts.append(F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    return both.select(*keys, F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("d")).select(*keys, "d.*")


def main(argv: list[str]) -> None:
    """Score files from a shell: `--metric wer --ref ref.txt --hyp hyp.txt`, or `--metric utmos --samples samples.jsonl --scores scores.jsonl`."""
    from ..sources import keytext

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--metric", required=True, choices=sorted(METRICS))
    for name in ("ref", "hyp", "samples", "scores", "out"):
        p.add_argument(f"--{name}")
    p.add_argument("--task", default="tts", choices=sorted(structured.SAMPLES))
    p.add_argument("--language", default="en")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.samples:
        scores = structured.json_lines(spark, a.scores, "sample_id string, score double") if a.scores else None
        inputs = {"samples": structured.json_lines(spark, a.samples, structured.SAMPLES[a.task]), "providers": {a.metric: scores}, "language": a.language}
    else:
        inputs = {"ref": keytext.read(spark, a.ref), "hyp": keytext.read(spark, a.hyp, "lenient")}
    report = calculate(a.metric, **inputs)
    body = json.dumps(sinks.plain(report.first()), ensure_ascii=False)
    if a.out:
        sinks.write_text(report, spark, a.out, body + "\n")
    print(body)


if __name__ == "__main__":
    main(sys.argv[1:])
