"""Imports of corpora into one sample schema: nested JSON, Parquet splits, Kaldi tables, candidate lists, audio look-ups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import milliseconds
from ..functions.text import script_language
from ..runtime import ship
from .keytext import lines

NESTED = "struct<aid:string,path:string,segments:array<struct<sid:string,begin_time:double,end_time:double,text:string,subsets:array<string>>>>"


#: What follows an object of an array; strings and brackets of JSON.
_AFTER = re.compile(r"\s*(,\s*\{\s*|\][\s\S]*)")
_MARKS = re.compile(r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"|[{}\[\]]')


def object_end(text: str) -> int:
    """Where the object ends that text continues from behind its opening brace. Nothing is decoded, so memory doesn't follow its size."""
    depth = 1
    for m in _MARKS.finditer(text):
        c = text[m.start()]
        if c != '"':
            depth += 1 if c in "{[" else -1
            if not depth:
                return m.end()
    raise ValueError(f"an object doesn't end: {text[-80:]!r}")


def array_elements(spark: SparkSession, path: str, first_key: str) -> DataFrame:
    """(value) the objects of one huge JSON array as texts, read in parallel: the file is split wherever first_key stands.

    Every object must begin with that key, and none may hold it again inside; a file that is otherwise made raises. What stands within an
    object's brackets is left to those who read it.
    """
    ship(spark)

    @F.pandas_udf("string")
    def whole(chunks: pd.Series) -> pd.Series:
        def one(chunk: str) -> str | None:
            if not chunk.lstrip().startswith(":"):
                return None  # what stands before the first object
            end = object_end(chunk)
            if not _AFTER.fullmatch(chunk, end):
                raise ValueError(f"an object doesn't begin with {first_key}: {chunk[end : end + 80]!r}")
            return f'{{"{first_key}"{chunk[:end]}'

        return chunks.map(one)

    pieces = spark.read.option("lineSep", f'"{first_key}"').text(path)
    return pieces.select(whole("value").alias("value")).where("value is not null")


def nested_segments(spark: SparkSession, path: str, subset: str, minimum: float = 0.01) -> DataFrame:
    """Segments of a subset from JSON files of nested audios, however large; a segment lasts at least `minimum` seconds."""
    audio = array_elements(spark, path, "aid").select(F.from_json("value", NESTED, {"mode": "FAILFAST"}).alias("a"))
    seg = audio.select("a.aid", "a.path", F.explode("a.segments").alias("s")).where(F.array_contains("s.subsets", subset))
    end = F.greatest(F.col("s.end_time"), F.col("s.begin_time") + minimum)
    return seg.select(F.col("s.sid").alias("key"), "path", F.col("s.text").alias("target"), F.col("s.begin_time").alias("begin_time"), end.alias("end_time"), milliseconds(F.col("s.begin_time"), end).alias("duration_ms"))


def parquet_split(spark: SparkSession, path: str, name: str, text: str = "text") -> DataFrame:
    """Rows of a Parquet split with the language of their script and a data set name for each language."""
    rows = spark.read.parquet(path)
    language = script_language(F.col(text))
    return rows.withColumn("language", language).withColumn("dataset", F.concat(F.lit(f"{name}_"), language))


def kaldi(spark: SparkSession, text_path: str, wav_path: str) -> DataFrame:
    """(key, path, target) of Kaldi's text and wav.scp; the last of repeated keys counts."""
    word, rest = F.regexp_extract("value", r"^\s*(\S+)", 1), F.trim(F.regexp_replace("value", r"^\s*\S+\s*", ""))
    read = lambda p, n: lines(spark, p).where(F.trim("value") != "").groupBy(word.alias("key")).agg(F.max_by(rest, "line_at").alias(n))
    return read(text_path, "target").join(read(wav_path, "path"), "key")


def ark_slice(content: Column, start: Column, length: Column) -> Column:
    """Bytes of an archive from a 0-based offset."""
    return F.substring(content, start + 1, length)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, task) of a JSON file that is a list, or an object with candidates, items or data."""
    item = "array<struct<id:string,name:string,task:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    obj = F.coalesce(*[F.from_json(F.get_json_object("v", f"$.{n}"), item) for n in ("candidates", "items", "data")])
    return raw.select(F.inline(F.when(F.col("v").startswith("["), F.from_json("v", item)).otherwise(obj)))


def raw_json_from_csv(spark: SparkSession, path: str, audio: str, text: str, language: str, metadata: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, audio, text, language, metadata) of a CSV with named columns, ready for `sinks.json_lines`; rows without audio are left out.

    The id is the audio file's stem. limit: as many rows as an import is to stop at.
    """
    rows = spark.read.option("header", True).csv(path)
    absent = [c for c in (audio, text, metadata) if c and c not in rows.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {rows.columns}")
    where = F.trim(F.col(f"`{audio}`"))
    stem = F.regexp_replace(F.element_at(F.split(where, "/"), -1), r"\.[^.]*$", "")
    out = rows.select(stem.alias("id"), where.alias("audio"), F.trim(F.col(f"`{text}`")).alias("text"), F.lit(language).alias("language"), (F.col(f"`{metadata}`") if metadata else F.lit(None).cast("string")).alias("metadata"))
    return limited(out.where("audio is not null and audio <> ''"), limit)


def limited(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows of an import, or all."""
    return rows if n is None else rows.limit(n)


def found_audio(samples: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """samples (key, path) with the first of their places under the roots that is in a file listing (path)."""
    tries = F.transform(F.array(*[F.lit(r.rstrip("/") + "/") for r in roots]), lambda r: F.concat(r, F.col("path")))
    wanted = samples.select("*", F.posexplode(F.concat(F.array("path"), tries)).alias("_rank", "_place"))
    there = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_place")).distinct()
    hit = wanted.join(there, "_place").groupBy("key").agg(F.min_by("_place", "_rank").alias("audio"))
    return samples.join(hit, "key", "left")
