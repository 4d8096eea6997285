"""Readers of `key<TAB>text` files and their relatives.

Every reader gives `line_at`, a struct (file, block, row) that orders lines as in the files however Spark splits them, and needs no
shuffle. Dialects differ in what counts as a row; `checked` turns the strict one's rules into an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECTS = ("counted", "lenient", "strict", "scorer", "whitespace", "prediction", "columns")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_at, value) of text files."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(at.alias("line_at"), F.regexp_replace("value", r"\r$", "").alias("value"))


def parse(rows: DataFrame, dialect: str = "counted") -> DataFrame:
    """(line_at, key, text, status) of `lines`; status is ok, blank or malformed.

    counted: key and text trimmed, no TAB or an empty key is malformed. lenient: no TAB is blank, nothing is trimmed. strict: as counted,
    to be `checked`. scorer: a line without TAB raises; `last_by_key` gives what its readers use. whitespace: the first word is the key. prediction: TAB where there is one, else the first white space. columns:
    the line is trimmed before it is split, so a row without text is blank.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect {dialect!r} is none of {DIALECTS}")
    v = F.col("value")
    tab = F.instr(v, "\t") > 0
    parts = F.split(v, "\t", 2)
    key, text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    word = F.regexp_extract(v, r"^\s*(\S+)", 1)
    rest = F.regexp_replace(v, r"^\s*\S+\s*", "")
    blank = F.trim(v) == ""
    if dialect in ("counted", "strict"):
        key, text = F.trim(key), F.trim(text)
        status = F.when(blank, "blank").when(~tab | (key == ""), "malformed").otherwise("ok")
    elif dialect == "lenient":
        status = F.when(tab, "ok").otherwise("blank")
    elif dialect == "scorer":
        key, text = F.trim(key), F.trim(text)
        status = F.when(blank, "blank").when(tab, "ok").otherwise(F.raise_error(F.concat(F.lit("no TAB in: "), v)).cast("string"))
    elif dialect == "whitespace":
        key, text = word, rest
        status = F.when(blank, "blank").otherwise("ok")
    elif dialect == "prediction":
        key, text = F.when(tab, F.trim(key)).otherwise(word), F.when(tab, F.trim(text)).otherwise(F.trim(rest))
        status = F.when(blank, "blank").when(key == "", "malformed").otherwise("ok")
    else:
        parts = F.split(F.trim(F.regexp_replace(v, r"^\s+|\s+$", "")), "\t", 2)
        key, text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        status = F.when(blank | text.isNull(), "blank").otherwise("ok")
    ok = status == "ok"
    return rows.select("line_at", F.when(ok, key).alias("key"), F.when(ok, F.coalesce(text, F.lit(""))).alias("text"), status.alias("status"))


def read(spark: SparkSession, path: str | list[str], dialect: str = "counted") -> DataFrame:
    """(line_at, key, text) of the valid rows."""
    return parse(lines(spark, path), dialect).where("status = 'ok'").drop("status")


def statistics(parsed: DataFrame) -> DataFrame:
    """One row: rows, rows with empty text, malformed rows."""
    return parsed.agg(
        F.count_if(F.col("status") == "ok").alias("num_rows"),
        F.count_if((F.col("status") == "ok") & (F.col("text") == "")).alias("num_empty_text_rows"),
        F.count_if(F.col("status") == "malformed").alias("num_malformed_rows"),
    )


def checked(parsed: DataFrame, unique: bool = True) -> DataFrame:
    """The valid rows of a strict file; a malformed line, a repeated key or no row at all raises a ValueError."""
    s = statistics(parsed).first()
    if s["num_malformed_rows"]:
        raise ValueError(f"{s['num_malformed_rows']} lines are not key<TAB>text")
    if not s["num_rows"]:
        raise ValueError("no key<TAB>text row")
    rows = parsed.where("status = 'ok'").drop("status")
    twice = rows.groupBy("key").count().where("count > 1").limit(5).collect() if unique else []
    if twice:
        raise ValueError(f"repeated keys: {sorted(r['key'] for r in twice)}")
    return rows


def last_by_key(rows: DataFrame) -> DataFrame:
    """One row a key: its last one in file order."""
    return rows.groupBy("key").agg(F.max_by("text", "line_at").alias("text"), F.min("line_at").alias("line_at"))


def joined_by_key(rows: DataFrame, separator: str = " ") -> DataFrame:
    """One row a key: its texts in file order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("line_at", "text")))
    return rows.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"), F.min("line_at").alias("line_at"))


def numbered(rows: DataFrame, by: str = "line_at", name: str = "line_no") -> DataFrame:
    """A dense number in file order, from 1."""
    from ..operators.alignment import places

    return places(rows, [by], name)
