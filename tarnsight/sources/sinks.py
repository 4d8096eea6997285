"""Writers. Rows go out in parallel through Spark; only one-row summaries are formatted on the driver."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import hadoop_path


def finite(x: Column) -> Column:
    """null for NaN and infinities, which JSON can't hold."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def plain(value):
    """A value for JSON: numpy scalars unwrapped, non-finite numbers null, rows and tuples as objects and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_text(df: DataFrame, spark, path: str, body: str) -> None:
    """A small driver-made file, through Hadoop's file system."""
    fs, at = hadoop_path(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


def run_artifacts(report: DataFrame, description: dict, folder: str, samples: DataFrame | None = None) -> None:
    """report.json of the one-row report, pipeline_description.json, and the per-sample rows as Parquet."""
    spark = report.sparkSession
    write_text(report, spark, f"{folder}/report.json", json.dumps(plain(report.first()), ensure_ascii=False, indent=2))
    write_text(report, spark, f"{folder}/pipeline_description.json", json.dumps(plain(description), ensure_ascii=False, indent=2))
    if samples is not None:
        samples.write.mode("overwrite").parquet(f"{folder}/samples")


def key_text(df: DataFrame, path: str, key: str = "key", text: str = "text") -> None:
    """key<TAB>text lines; null text is empty."""
    df.select(F.concat(F.col(key), F.lit("\t"), F.coalesce(F.col(text), F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def template(samples: DataFrame, path: str) -> DataFrame:
    """key<TAB> for every sample; the manifest rows (dataset, task, count)."""
    key_text(samples.withColumn("text", F.lit("")), path)
    return samples.groupBy("dataset", "task").agg(F.count("*").alias("num_samples"))


def stm(df: DataFrame, path: str) -> None:
    """STM lines of segments in row order; missing words are empty."""
    line = F.concat_ws(" ", "session", "channel", "speaker", F.format_string("%.2f", "start"), F.format_string("%.2f", "end"), F.coalesce("words", F.lit("")))
    df.orderBy("line_at").select(F.rtrim(line).alias("value")).write.mode("overwrite").text(path)


def trn(df: DataFrame, path: str) -> None:
    """`text (id)` lines."""
    df.select(F.concat(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit(" ("), F.col("key"), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a row; non-finite doubles are null, in structs, arrays and maps too."""
    df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").json(path)


def _finite(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(x)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_finite(x[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _finite(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _finite(v, kind.valueType))
    return x


def sample_reports(df: DataFrame, path: str) -> None:
    """Per-sample rows in folders by dataset and metric."""
    df.repartition("dataset", "metric").write.mode("overwrite").partitionBy("dataset", "metric").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add evaluation records to a Parquet store."""
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def baseline_yaml(baselines: DataFrame) -> str:
    """The baselines as YAML, data sets in order; a table of a row a data set."""
    out = ["baselines:"]
    for r in sorted(baselines.collect(), key=lambda r: r["dataset"]):
        out.append(f"  {json.dumps(r['dataset'], ensure_ascii=False)}:")
        out += [f"    {k}: {json.dumps(plain(v), ensure_ascii=False)}" for k, v in r.asDict().items() if k != "dataset" and v is not None]
    return "\n".join(out) + "\n"


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; of a larger one the first `limit` rows, and a line that says so."""
    rows = df.limit(limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows), *([f"\nThe first {limit} rows."] if more else [])])


def protocol(path: str, run: dict) -> None:
    """Run metadata as simple YAML (nested mappings and lists of scalars), through Hadoop's file system."""

    def lines(value, depth):
        for k, v in value.items():
            pad = "  " * depth
            if isinstance(v, dict):
                yield f"{pad}{k}:"
                yield from lines(v, depth + 1)
            elif isinstance(v, list):
                yield f"{pad}{k}:"
                yield from (f"{pad}  - {json.dumps(x, ensure_ascii=False)}" for x in v)
            else:
                yield f"{pad}{k}: {json.dumps(plain(v), ensure_ascii=False)}"

    spark = SparkSession.getActiveSession()
    write_text(spark.range(0), spark, str(path), "\n".join(lines(run, 0)) + "\n")
