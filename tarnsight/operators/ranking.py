"""Histories, baselines, leaderboards: windows with full tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filtered(records: DataFrame, **equal) -> DataFrame:
    """Records equal in every given column; an empty value filters nothing."""
    for c, v in equal.items():
        if v:
            records = records.where(F.col(c) == v)
    return records


def latest(records: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """One record a group: the latest by time, ties to the first by `order`."""
    w = Window.partitionBy(*by).orderBy(F.col(time).desc_nulls_last(), F.col(order).asc())
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, score: str, order: list[str], by: list[str] = (), name: str = "rank", k: int | None = None) -> DataFrame:
    """Rows with a place from 1 by descending score, ties by `order`; the first k of each group where asked."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in order])
    out = rows.withColumn(name, F.row_number().over(w))
    return out if k is None else out.where(F.col(name) <= k)


def leaderboard(results: DataFrame, model: str = "model", dataset: str = "dataset", rps: str = "rps") -> DataFrame:
    """(rank, model, average_rps, num_datasets, num_best): models by mean relative score, with the datasets that each leads."""
    lead = Window.partitionBy(dataset).orderBy(F.col(rps).desc_nulls_last(), F.col(model).asc())
    flagged = results.withColumn("_best", F.row_number().over(lead) == 1)
    out = flagged.groupBy(model).agg(F.coalesce(F.avg(rps), F.lit(0.0)).alias("average_rps"), F.count("*").alias("num_datasets"), F.count_if("_best").alias("num_best"))
    # one row a model
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("average_rps").desc(), F.col(model).asc())))


def compared(results: DataFrame, models: list[str], dataset: str) -> DataFrame:
    """The named models on one dataset in order of score; a model without result is marked."""
    spark = results.sparkSession
    asked = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model string, _i int")
    one = results.where(F.col("dataset") == dataset)
    out = asked.join(one, "model", "left").withColumn("status", F.when(F.col("dataset").isNull(), "no result").otherwise("ok"))
    return out.withColumn("rank", F.when(F.col("dataset").isNotNull(), F.row_number().over(Window.orderBy(F.col("rps").desc_nulls_last(), "_i")))).drop("_i")


def anomaly(metric: Column, score: Column, rps: Column) -> Column:
    """Why a result looks wrong, or null: relative score absent or under one half first, then limits on the score itself."""
    return (
        F.when(rps.isNull(), "no baseline").when(rps < 0.5, "low relative score").when(metric.isin("wer", "cer", "mer") & (score > 50), "high error rate").when((metric == "accuracy") & (score < 20), "low accuracy").when(metric.startswith("bleu") & (score < 10), "low bleu")
    )


def merged(*payloads: DataFrame, keys: list[str] = ("dataset", "metric"), override: bool = False) -> DataFrame:
    """All rows of several tables; a repeated key raises, or the later table's row counts."""
    out = None
    for i, p in enumerate(payloads):
        p = p.withColumn("_i", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    if override:
        return out.withColumn("_n", F.row_number().over(w.orderBy(F.col("_i").desc()))).where("_n = 1").drop("_i", "_n")
    n = F.count("*").over(w)
    clash = F.when(n > 1, F.raise_error(F.concat_ws(" ", F.lit("repeated"), *[F.col(k).cast("string") for k in keys])).cast("int")).otherwise(F.col("_i"))
    return out.withColumn("_i", clash).where("_i is not null").drop("_i")


def sampled(rows: DataFrame, by: list[str], k: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """min(k, n) rows of each group, drawn by a seeded MD5 of the key (of all columns without one); ties by those columns."""
    names = [key] if key else rows.columns
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in names)))
    w = Window.partitionBy(*by).orderBy(h, *names)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
