"""Typed readers: JSON lines, samples, choices, labels, keyword spotting, segments, records, baselines, reports, audio."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyword, label_value
from .keytext import lines

TEXTS = "map<string,string>"


def json_lines(spark: SparkSession, path: str, schema: str, bad: str = "fail") -> DataFrame:
    """JSON lines under a fixed schema. bad: fail, drop, or keep (adds `line_at` and `corrupt`)."""
    if bad == "keep":
        rows = lines(spark, path).where(F.trim("value") != "")
        parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        return rows.select("line_at", parsed.alias("x")).select("line_at", "x.*").withColumnRenamed("_corrupt", "corrupt")
    return spark.read.schema(schema).json(path, mode={"fail": "FAILFAST", "drop": "DROPMALFORMED"}[bad])


def read_predictions(spark: SparkSession, path: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(predictions, problems) of a JSON-lines file: (key, value) of each key's last line, and (problem, key) of what is wrong.

    Problems are `line:N` for a line that is no object, `line:N:missing_key` for one without key, `duplicate` for a key given before.
    """
    from pyspark.sql.window import Window

    rows = lines(spark, path).withColumn("n", F.row_number().over(Window.orderBy("line_at"))).where(F.trim("value") != "")
    fields = F.from_json("value", "map<string,string>")
    parsed = rows.select("line_at", "value", "n", fields.isNotNull().alias("good"), F.trim(F.get_json_object("value", f"$.{key}")).alias("key"))
    named = F.col("good") & (F.coalesce("key", F.lit("")) != "")
    where = F.concat(F.lit("line:"), F.col("n").cast("string"))
    bad = parsed.where(~named).select(F.when(~F.col("good"), where).otherwise(F.concat(where, F.lit(":missing_key"))).alias("problem"), F.lit(None).cast("string").alias("key"))
    twice = parsed.where(named).groupBy("key").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "key")
    return parsed.where(named).groupBy("key").agg(F.max_by("value", "line_at").alias("value")), bad.unionByName(twice)


SAMPLES = {
    "tts": "sample_id string, prediction_audio string, language string, reference_text string, reference_audio string, metadata map<string,string>",
    "vc": "sample_id string, converted_audio string, language string, reference_text string, reference_audio string, metadata map<string,string>",
    "se": "sample_id string, enhanced_audio string, noisy_audio string, reference_audio string, metadata map<string,string>",
    "tse": "sample_id string, prediction_audio string, reference_audio string, mixed_audio string, enrollment_audio string, language string, reference_text string, metadata map<string,string>",
}
REQUIRED = {
    "tts": ("sample_id", "prediction_audio", "language"),
    "vc": ("sample_id", "converted_audio", "language"),
    "se": ("sample_id", "enhanced_audio"),
    "tse": ("sample_id", "prediction_audio", "reference_audio", "mixed_audio"),
}
SPEAKER = ("wavlm_large_sim", "ecapa_tdnn_sim", "eres2net_sim")


def violations(samples: DataFrame, task: str, metrics: list[str] = ()) -> DataFrame:
    """(rule, sample_id, message) of audio samples: absent fields, by task and requested metric, repeated ids, several languages."""
    need = list(REQUIRED[task])
    asked = set(metrics)
    if task in ("tts", "tse") and asked & {"cer", "wer"}:
        need.append("reference_text")
    if task in ("tts", "vc") and asked & set(SPEAKER):
        need.append("reference_audio")
    if task == "se" and asked & {"si_sdr", "stoi", "pesq"}:
        need.append("reference_audio")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = F.array(*[F.when(empty(F.col(c)), F.struct(F.lit("required").alias("rule"), F.concat(F.lit(c), F.lit(" is absent")).alias("message"))) for c in need])
    out = samples.select("sample_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select("x.rule", "sample_id", "x.message")
    twice = samples.groupBy("sample_id").count().where("count > 1").select(F.lit("unique").alias("rule"), "sample_id", F.lit("sample_id is repeated").alias("message"))
    out = out.unionByName(twice)
    if "language" in samples.columns:
        many = samples.agg(F.countDistinct("language").alias("n")).where("n <> 1").select(F.lit("language").alias("rule"), F.lit(None).cast("string").alias("sample_id"), F.lit("exactly one language is needed").alias("message"))
        out = out.unionByName(many)
    return out


def read_samples(spark: SparkSession, path: str, task: str, metrics: list[str] = ()) -> DataFrame:
    """Audio samples of a task; any violation raises, with the first ones named. Relative audio paths start at the file's folder."""
    rows = json_lines(spark, path, SAMPLES[task])
    found = violations(rows, task, metrics).orderBy("rule", "sample_id", "message").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r['sample_id']}: {r['message']}" for r in found))
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    for c in rows.columns:
        if c.endswith("_audio"):
            rows = rows.withColumn(c, F.when(F.col(c).rlike(r"^(/|[a-z0-9]+://)"), F.col(c)).when(F.col(c) != "", F.concat(F.lit(base + "/"), F.col(c))))
    return rows


CHOICE = "array<struct<id:string,text:string,aliases:array<string>>>"


def choices_of(item: Column) -> Column:
    """Choices of a JSON item: an object, a list of objects, a list of strings, or option lines of its prompt."""
    raw = F.coalesce(F.get_json_object(item, "$.choices"), F.get_json_object(item, "$.options"))
    pairs = F.from_json(raw, TEXTS)
    by_object = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("text"), F.array().cast("array<string>").alias("aliases")))
    parts = F.from_json(raw, "array<string>")

    def one(x: Column, i: Column) -> Column:
        is_object = F.trim(x).startswith("{")
        value = F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in ("text", "label", "value")], F.lit(""))
        aliases = F.get_json_object(x, "$.aliases")
        many = F.when(aliases.startswith("["), F.from_json(aliases, "array<string>")).when(aliases.isNotNull(), F.array(aliases)).otherwise(F.array().cast("array<string>"))
        number = (i + 1).cast("string")
        return F.struct(
            F.when(is_object, F.coalesce(F.get_json_object(x, "$.id"), number)).otherwise(number).alias("id"),
            F.when(is_object, value).otherwise(x).alias("text"),
            F.when(is_object, many).otherwise(F.array().cast("array<string>")).alias("aliases"),
        )

    by_list = F.transform(parts, one)
    return F.when(raw.startswith("{"), by_object).when(raw.startswith("["), by_list).otherwise(choices_of_prompt(F.get_json_object(item, "$.prompt")))


def choices_of_prompt(prompt: Column) -> Column:
    """Choices from the lettered, numbered or circled option lines of a prompt."""
    option = r"^\s*([A-Za-z]+|\d+|[\x{2460}-\x{2473}])\s*[.):\x{FF1A}\x{3001}]\s*(.+?)\s*$"
    rows = F.filter(F.split(F.coalesce(prompt, F.lit("")), r"\r?\n"), lambda r: r.rlike(option))
    return F.transform(rows, lambda r: F.struct(F.regexp_extract(r, option, 1).alias("id"), F.regexp_extract(r, option, 2).alias("text"), F.array().cast("array<string>").alias("aliases")))


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """(key, prompt, choices) of prompt JSON lines."""
    rows = lines(spark, path).where(F.trim("value") != "")
    item = F.col("value")
    return rows.select(F.get_json_object(item, "$.key").alias("key"), F.coalesce(F.get_json_object(item, "$.prompt"), F.lit("")).alias("prompt"), choices_of(item).alias("choices"))


EMOTIONS = [("neu", ["neutral"], 0), ("hap", ["happy", "happiness"], 1), ("ang", ["angry", "anger"], 2), ("sad", ["sadness"], 3)]
GENDERS = [("man", ["male", "m"], 0), ("woman", ["female", "f"], 1)]


def label_spec(spec: dict | str | None = None, task: str = "classification") -> dict:
    """{id, unknown, aliases}: a given spec (a mapping, or the path of a JSON file), or the task's own; later labels override."""
    if isinstance(spec, str):
        with open(spec, encoding="utf-8") as f:
            spec = json.load(f)
    if spec is None:
        built = {"SER": (EMOTIONS, True, "invalid"), "GR": (GENDERS, True, "invalid"), "CLASSIFICATION": (EMOTIONS + GENDERS, False, "keep"), "ACCURACY": (EMOTIONS + GENDERS, False, "keep")}
        labels, genders, unknown = built.get(task.upper(), ([], False, "keep"))
        spec = {"id": task.lower(), "unknown_policy": unknown, "labels": [{"id": i, "aliases": a, "numeric_ids": [n] if genders or i in {e[0] for e in EMOTIONS} else []} for i, a, n in labels]}
    aliases: dict[str, str] = {}
    for label in spec.get("labels", ()):
        for name in (label["id"], label.get("display"), *label.get("aliases", ()), *label.get("numeric_ids", ())):
            if name is not None:
                aliases[" ".join(str(name).split()).lower()] = str(label["id"])
    return {"id": spec.get("id", task), "unknown": spec.get("unknown_policy", "invalid"), "aliases": aliases}


def label_of(value: Column, spec: dict) -> Column:
    """The label that a value names; an unknown one is null, or itself under the policy `keep`."""
    norm = label_value(value)
    if not spec["aliases"]:
        return norm if spec["unknown"] == "keep" else F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in sorted(spec["aliases"].items()) for x in kv])
    found = F.try_element_at(table, norm)
    return found if spec["unknown"] == "invalid" else F.coalesce(found, norm)


KWS = "key string, expected_detected boolean, expected_keyword string, detected boolean, predicted_keyword string, score double, scores array<double>, duration double"


def kws_from_json(reference: DataFrame, outputs: DataFrame) -> DataFrame:
    """Samples from JSON texts (column value): the outputs drive the rows; an output without a reference raises."""
    r, o = F.col("value"), F.col("value")
    text = lambda c, *names: F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names])
    said = text(r, "expected", "label", "expected_detected")
    words = text(r, "keyword", "text", "txt")
    truth = F.when(said.isNull(), F.coalesce(F.trim(words), F.lit("")) != "").otherwise(F.lower(said).isin("true", "1", "yes", "detected", "positive"))
    ref = reference.select(text(r, "key", "id").alias("key"), truth.alias("expected_detected"), keyword(words).alias("expected_keyword"), text(r, "duration").cast("double").alias("duration"))
    got = outputs.select(
        text(o, "key", "id").alias("key"),
        F.lower(F.coalesce(text(o, "result.detected", "detected"), F.lit("false"))).isin("true", "1", "yes").alias("detected"),
        keyword(text(o, "result.keyword", "keyword")).alias("predicted_keyword"),
        text(o, "result.score", "score").cast("double").alias("score"),
        F.from_json(text(o, "result.scores", "scores"), "array<double>").alias("scores"),
    )
    joined = got.join(ref, "key", "left")
    known = F.when(F.col("expected_detected").isNull(), F.raise_error(F.concat(F.lit("no reference for "), "key")).cast("boolean")).otherwise(F.col("expected_detected"))
    return joined.withColumn("expected_detected", known).select(*[c.split()[0] for c in KWS.split(", ")])


def _last_line(scores: DataFrame, *columns: Column) -> DataFrame:
    """The columns (key first) of the last line of each key; without `line_at`, of the one that Spark numbers last."""
    at = F.col("line_at") if "line_at" in scores.columns else F.monotonically_increasing_id()
    rows = scores.select(*columns, at.alias("_at"))
    rest = [c for c in rows.columns if c not in ("key", "_at")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "_at").alias("x")).select("key", "x.*")


def kws_from_ctc(labels: DataFrame, scores: DataFrame, wanted: str) -> DataFrame:
    """Samples from labels (key, text) and score lines (value) `key detected <keyword> <score>` or `key rejected`.

    Labels drive the rows: one without a score raises. Of repeated score lines the last counts.
    """
    p = F.split(F.trim("value"), r"\s+")
    hit = (F.get(p, F.lit(1)) == "detected") & (F.size(p) >= 4)
    got = _last_line(scores, F.get(p, F.lit(0)).alias("key"), hit.alias("detected"), F.when(hit, keyword(F.get(p, F.lit(2)))).alias("predicted_keyword"), F.when(hit, F.get(p, F.lit(3)).cast("double")).alias("score"))
    ref = labels.select("key", F.coalesce(keyword(F.col("text")).contains(F.upper(F.lit(wanted))), F.lit(False)).alias("expected_detected"))
    joined = ref.join(got, "key", "left")
    there = F.when(F.col("detected").isNull(), F.raise_error(F.concat(F.lit("no score for "), "key")).cast("boolean")).otherwise(F.col("detected"))
    return joined.select("key", "expected_detected", F.when(F.col("expected_detected"), F.upper(F.lit(wanted))).alias("expected_keyword"), there.alias("detected"), "predicted_keyword", "score", F.lit(None).cast("array<double>").alias("scores"), F.lit(None).cast("double").alias("duration"))


def kws_from_frames(labels: DataFrame, scores: DataFrame, wanted: str, threshold: float = 0.5) -> DataFrame:
    """Samples from labels (key, text) and frame lines (value) `key keyword s1 s2 ...` of one keyword; detected where the largest reaches the threshold.

    Labels drive the rows: one without frames raises. Of repeated lines the last counts.
    """
    p = F.split(F.trim("value"), r"\s+")
    frames = F.transform(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), lambda x: x.cast("double"))
    got = _last_line(scores.where(keyword(F.get(p, F.lit(1))) == F.upper(F.lit(wanted))), F.get(p, F.lit(0)).alias("key"), frames.alias("scores"))
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    ref = labels.select("key", F.coalesce(keyword(F.col("text")).contains(F.upper(F.lit(wanted))), F.lit(False)).alias("expected_detected"))
    there = F.when(F.col("scores").isNull(), F.raise_error(F.concat(F.lit("no frames for "), "key")).cast("boolean")).otherwise(top >= threshold)
    return ref.join(got, "key", "left").select("key", "expected_detected", F.when(F.col("expected_detected"), F.upper(F.lit(wanted))).alias("expected_keyword"), there.alias("detected"), F.when(top >= threshold, F.upper(F.lit(wanted))).alias("predicted_keyword"), top.alias("score"), "scores", F.lit(None).cast("double").alias("duration"))


SEGMENTS = ["session", "channel", "speaker", "start", "end", "words"]


def parse_segments(rows: DataFrame, kind: str) -> DataFrame:
    """(line_at, session, channel, speaker, start, end, words) of STM, RTTM, CTM or SegLST lines (column value); other lines are dropped."""
    v, word = F.trim("value"), r"\S+"
    if kind == "stm":
        p = rf"^({word})\s+({word})\s+({word})\s+({word})\s+({word})(?:\s+(.*))?$"
        g = lambda i: F.regexp_extract(v, p, i)
        out = rows.where(v.rlike(p) & ~v.startswith(";;")).select("line_at", g(1).alias("session"), g(2).alias("channel"), g(3).alias("speaker"), g(4).try_cast("double").alias("start"), g(5).try_cast("double").alias("end"), g(6).alias("words"))
    elif kind in ("rttm", "ctm"):
        p = F.split(v, r"\s+")
        g = lambda i: F.get(p, F.lit(i))
        if kind == "rttm":
            rows, session, channel, speaker, start, length, text = rows.where(v.startswith("SPEAKER")), g(1), g(2), g(7), g(3), g(4), F.lit(None).cast("string")
        else:
            session, channel, speaker, start, length, text = g(0), g(1), g(1), g(2), g(3), g(4)
        start = start.try_cast("double")
        out = rows.select("line_at", session.alias("session"), channel.alias("channel"), speaker.alias("speaker"), start.alias("start"), (start + length.try_cast("double")).alias("end"), text.alias("words"))
    elif kind == "seglst":
        g = lambda *n: F.coalesce(*[F.get_json_object("value", f"$.{x}") for x in n])
        start = g("start_time", "start", "begin").try_cast("double")
        end = F.coalesce(g("end_time", "end").try_cast("double"), start + g("duration").try_cast("double"), start)
        out = rows.select("line_at", g("session_id", "session").alias("session"), g("channel").alias("channel"), g("speaker").alias("speaker"), start.alias("start"), end.alias("end"), g("words", "text").alias("words"))
    else:
        raise ValueError(f"kind {kind!r}")
    return out.where("session is not null and start is not null and end is not null")


def csv_samples(spark: SparkSession, path: str, task: str, language: str, dataset: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(key, path, target, task, language, dataset) of a CSV with an audio and a text column, whatever they are called."""
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    audio = [c for c in rows.columns if c.strip().lower() in ("audio", "path", "wav", "file", "audio_path", "audio:file")]
    text = [c for c in rows.columns if c.strip().lower() in ("text", "target", "transcript", "sentence", "label", "text:label")]
    if not audio or not text:
        raise ValueError(f"no audio or text column in {rows.columns}")
    where = F.coalesce(*[F.col(f"`{c}`") for c in audio])
    for a, b in (prefixes or {}).items():
        where = F.when(where.startswith(a), F.concat(F.lit(b), F.substring(where, F.lit(len(a) + 1), F.length(where)))).otherwise(where)
    key = F.regexp_replace(F.element_at(F.split(where, "/"), -1), r"\.[^.]*$", "")
    out = rows.select(key.alias("key"), where.alias("path"), F.trim(F.coalesce(*[F.col(f"`{c}`") for c in text])).alias("target"), F.lit(task).alias("task"), F.lit(language).alias("language"), F.lit(dataset).alias("dataset"))
    return out.where(F.col("path").isNotNull() & (F.col("path") != ""))


RECORD = "tool_name string, model_name string, dataset string, metric string, score double, rps double, timestamp string, metadata map<string,string>"
BASELINE = "dataset string, metric string, score double, higher_is_better boolean, sota_model string, description string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of Parquet, or of a JSON array; a store that isn't there has none."""
    try:
        return spark.read.schema(RECORD).parquet(path) if not path.endswith(".json") else spark.read.schema(RECORD).json(path, multiLine=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def baselines(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A baseline table of given rows; those without metric or score are left out, lower is better unless said."""
    kept = [(r["dataset"], r["metric"], float(r["score"]), bool(r.get("higher_is_better", False)), r.get("sota_model"), r.get("description")) for r in rows if r.get("metric") and r.get("score") is not None]
    return spark.createDataFrame(kept, BASELINE)


def read_baselines(spark: SparkSession, text: str) -> DataFrame:
    """A baseline table from YAML text: a mapping of data sets to mappings of scalars, below a `baselines` key or at the top."""
    rows: list[dict] = []
    scalar = lambda v: json.loads(v) if v[:1] in '"[{' or v in ("true", "false", "null") else v.strip("'")
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        name, _, value = body.strip().partition(":")
        if not body.strip() or body.lstrip().startswith("#") or body.strip() == "baselines:":
            continue
        if not value.strip():
            rows.append({"dataset": scalar(name)})
        elif rows:
            rows[-1][name] = scalar(value.strip())
    return baselines(spark, rows)


REPORT = "models map<string,struct<tasks:array<string>,track_i:map<string,struct<metric:string,score:double,rps:double>>,track_ii:map<string,struct<metric:string,score:double,rps:double,task:string>>>>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(model, dataset, task, metric, score, rps, track) of nested reports; of a dataset in both tracks the second counts."""
    raw = spark.read.schema(REPORT).json(path, multiLine=True).select(F.explode("models").alias("model", "m"))
    first = raw.select("model", F.explode("m.track_i").alias("dataset", "r")).select("model", "dataset", F.lit("ASR").alias("task"), "r.metric", "r.score", "r.rps", F.lit(1).alias("track"))
    second = raw.select("model", F.explode("m.track_ii").alias("dataset", "r")).select("model", "dataset", "r.task", "r.metric", "r.score", "r.rps", F.lit(2).alias("track"))
    both = first.unionByName(second)
    return both.groupBy("model", "dataset").agg(F.max_by(F.struct("task", "metric", "score", "rps", "track"), "track").alias("x")).select("model", "dataset", "x.*")


AUDIO = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


def decode_wav(data: bytes) -> tuple[int, np.ndarray] | None:
    """(rate, mono float samples) of 8, 16, 24 or 32 bit PCM or 32 bit float; None for anything else."""
    if data is None or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE and len(body) >= 26 else kind, channels, rate, bits)
        elif name == b"data" and form:
            kind, channels, rate, bits = form
            step = bits // 8
            body = body[: len(body) // (step * channels) * step * channels]
            if kind == 3 and bits == 32:
                x = np.frombuffer(body, "<f4").astype(np.float32)
            elif kind != 1:
                return None
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
                x = (np.where(v >= 1 << 23, v - (1 << 24), v) / (1 << 23)).astype(np.float32)
            elif bits in (16, 32):
                x = (np.frombuffer(body, f"<i{step}") / float(1 << (bits - 1))).astype(np.float32)
            else:
                return None
            return rate, x.reshape(-1, channels).mean(1)
        at += 8 + size + (size & 1)
    return None


@F.pandas_udf(AUDIO)
def _wav(content: pd.Series) -> pd.DataFrame:
    got = [decode_wav(c) for c in content]
    return pd.DataFrame({"rate": pd.array([g[0] if g else None for g in got], dtype="Int32"), "samples": [g[1] if g else None for g in got]})


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples): mono audio of WAV files; null where a file can't be read as such."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", _wav("content").alias("a")).select("path", "a.rate", "a.samples")
