"""Running error rates and latest records over streams. The batch engine that these results match knows no streams; this part is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_error_rate(scored: DataFrame, time: str, window: str, late: str, by: list[str] = ()) -> DataFrame:
    """Errors, tokens and rate by event-time window: sums alone, so partial results merge and state stays small."""
    w = scored.withWatermark(time, late).groupBy(F.window(time, window), *by)
    out = w.agg(F.sum("dist").alias("errors"), F.sum("n").alias("num_tokens"))
    return out.withColumn("score", F.try_divide(F.col("errors").cast("double"), F.col("num_tokens")))


def first_in_window(records: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One record a key within the time that late data may come."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
