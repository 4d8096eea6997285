"""Named evaluation routes: which normaliser and scorer a task, language and metric stand for, and their dotted identity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SPEAKERS = ("wavlm_large_sim", "ecapa_tdnn_sim", "eres2net_sim")
OPINIONS = ("dnsmos", "wv_mos", "utmos")
ALIASES = {
    "sim/wavlm-large": "wavlm_large_sim", "sim/ecapa-tdnn": "ecapa_tdnn_sim", "sim/eres2net": "eres2net_sim", "wv-mos": "wv_mos", "si-sdr": "si_sdr", "macro-recall": "macro_recall",
    **{f"{t}_{m}": m for t in ("tts", "vc", "tse") for m in ("cer", "wer")},
}


def slug(x: str | None) -> str:
    """Lower case, other signs to underscores; nothing is `any`."""
    out = re.sub(r"[^a-z0-9]+", "_", (x or "").strip().lower()).strip("_")
    return "any" if out in ("", "n_a", "none") else out


def canonical(metric: str) -> str:
    return ALIASES.get(metric.strip().lower(), slug(metric))


@dataclass(frozen=True)
class Route:
    task: str
    language: str  # `any` fits every language
    metric: str
    chain: tuple[str, ...]  # component names with their versions
    roles: tuple[str, ...]  # tables that it needs
    selectors: tuple[tuple[str, str], ...] = ()
    default: bool = True

    def pipeline_id(self, language: str | None = None) -> str:
        return ".".join([slug(self.task), slug(language if self.language == "any" else self.language), self.metric, *self.chain])


def _routes() -> list[Route]:
    out: list[Route] = []
    add = lambda *a, **k: out.append(Route(*a, **k))
    pair = ("ref", "hyp")
    for lang, metric, normal, scorer, canonical_scorer in (("zh", "cer", "wetext_norm_zh_itn_v1", "wenet_cer_v1", "token_cer_v1"), ("en", "wer", "whisper_norm_v1", "wenet_wer_v1", "token_mer_v1"), ("cs", "mer", "aispeech_norm_v1", "wenet_mer_v1", "token_mer_v1")):
        add("asr", lang, metric, (normal, scorer), pair)
        if lang != "cs":
            add("asr", lang, metric, ("aispeech_norm_v1", scorer), pair, (("normalizer", "aispeech"),), False)
        add("asr", lang, metric, (f"canonical_itn_{lang}_v1", canonical_scorer), pair, (("normalizer", "canonical"),), False)
    for lang in ("zh", "en"):
        for metric, node in (("bleu", "sacrebleu_v1"), ("bleu_char", "sacrebleu_v1"), ("chrf", "sacrebleu_v1"), ("xcomet_xl", "xcomet_xl_v1"), ("bleurt_20", "bleurt_20_v1")):
            add("s2tt", lang, metric, (node,), ("src", *pair) if metric == "xcomet_xl" else pair)
    add("sd", "any", "der", ("meeteval_v1",), ("ref_segments", "hyp_segments"))
    add("sa_asr", "any", "cpwer", ("stm_to_txt_v1", "gstar_norm_v1", "txt_to_stm_v1", "meeteval_v1"), ("ref_segments", "hyp_segments"))
    for task in ("tts", "vc", "tse"):
        for lang, metric, reader in (("zh", "cer", "paraformer_zh_v1"), ("en", "wer", "whisper_large_v3_v1")):
            add(task, lang, metric, (reader, "wetext_norm_zh_itn_v1" if lang == "zh" else "whisper_norm_v1", f"wenet_{metric}_v1"), ("samples", "transcripts"))
        for m in SPEAKERS + OPINIONS:
            add(task, "any", m, (f"{m}_v1",), ("samples", "provider"))
    add("vc", "any", "cer_two_pass", ("paraformer_zh_v1", "paraformer_zh_v1", "wenet_cer_v1"), ("samples", "transcripts"), (), False)
    for m in ("si_sdr", "stoi", "pesq", *OPINIONS):
        add("se", "any", m, (f"{m}_v1",), ("signals",) if m == "si_sdr" else ("samples", "provider"))
    for m in ("si_sdr", "si_sdri"):
        add("tse", "any", m, ("si_sdr_v1",), ("signals",))
    for task in ("classification", "ser", "gr"):
        add(task, "any", "accuracy", ("classify_v1",), pair)
    add("slu", "any", "accuracy", ("prompt_norm_v1", "classify_v1"), (*pair, "choices"))
    for mode in ("json_pair", "wekws_score_ctc", "wekws_frame_score"):
        for m in ("accuracy", "macro_recall"):
            add("kws", "any", m, (f"{mode}_v1", "wekws_det_v1"), ("samples",), (("input_mode", mode),), mode == "json_pair")
    return out


ROUTES = _routes()


def find(task: str, language: str | None = None, metric: str | None = None, pipeline_id: str | None = None, **selectors: str) -> Route:
    """The first declared route that fits; a metric that no route of the language has is looked up without it."""
    mine = [r for r in ROUTES if r.task == task]
    if pipeline_id:
        fit = [r for r in mine if pipeline_id in {r.pipeline_id(language), r.pipeline_id(), *(r.pipeline_id(x) for x in ("zh", "en", "cs"))}]
    else:
        wanted = canonical(metric) if metric else None
        by = lambda rs: [r for r in rs if (wanted is None or r.metric == wanted) and (all(dict(r.selectors).get(k) == v for k, v in selectors.items()) if selectors else r.default or not any(x.default and x.metric == r.metric for x in rs))]
        tongue = slug(language)
        fit = by([r for r in mine if r.language in (tongue, "any")] if language else mine) or by(mine)
    if not fit:
        raise LookupError(f"no route for {task}, {language}, {metric or pipeline_id}, {selectors}")
    return fit[0]


def describe(task: str, language: str | None = None, metrics: tuple[str, ...] = (), **selectors: str) -> dict:
    """What would run: one route, or a bundle of several with a joint identity."""
    found = [find(task, language, m, **selectors) for m in metrics] if metrics else [find(task, language, **selectors)]
    ids = [r.pipeline_id(language) for r in found]
    prefix = f"{slug(task)}.{slug(language)}."
    joint = ids[0] if len(ids) == 1 else prefix + "multi." + "__".join(i.removeprefix(prefix) for i in ids)
    roles = tuple(dict.fromkeys(x for r in found for x in r.roles))
    return {"task": task, "language": slug(language), "metrics": [r.metric for r in found], "pipeline_id": joint, "members": ids, "roles": roles, "nodes": [list(r.chain) for r in found]}


def catalog(spark: SparkSession) -> DataFrame:
    """Every route as a row."""
    rows = [(r.task, r.language, r.metric, r.pipeline_id(), list(r.chain), list(r.roles), dict(r.selectors), r.default) for r in ROUTES]
    return spark.createDataFrame(rows, "task string, language string, metric string, pipeline_id string, nodes array<string>, roles array<string>, selectors map<string,string>, is_default boolean")
