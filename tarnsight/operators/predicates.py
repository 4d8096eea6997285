"""Predicates and projections over results, candidates and predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Vectors of a block of `cosine_pairs`, and about how many of its rows are made at once.
BLOCK, PIECE = 2048, 1 << 16
TIMING = ("elapsed", "elapsed_seconds", "runtime", "duration_seconds", "path", "audio_path", "prediction_audio", "reference_audio")


def with_task(models: DataFrame, task: str, column: str = "supported_tasks") -> DataFrame:
    """Models that list a task."""
    return models.where(F.array_contains(column, task))


def names(task: str, *columns: str) -> Column:
    """Whether any of the columns holds the task's name, in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(task.lower()))


def contract_violations(predictions: DataFrame, task: str) -> DataFrame:
    """One row: the sorted keys whose prediction (column `value`, JSON) lacks what its task needs."""
    has = lambda *n: F.coalesce(*[F.get_json_object("value", f"$.{x}") for x in n], F.lit("")) != ""
    need = {
        "kws": has("detected", "result.detected"), "sd": has("segments", "annotation", "rttm"), "sa_asr": has("segments", "annotation", "stm"), "tts": has("prediction_audio", "audio"), "vc": has("converted_audio", "audio"),
        "se": has("enhanced_audio", "audio"), "tse": has("prediction_audio", "audio"),
    }.get(task, has("text", "prediction", "label"))
    return predictions.agg(F.array_sort(F.collect_set(F.when(~need, F.col("key")))).alias("keys"))


def provider_row(values: Column, metric: str, deny: tuple[str, ...] = TIMING) -> Column:
    """(score, rest) of a provider's map of strings: the score under the metric's or a usual name, other numbers without timings and paths."""
    score = F.coalesce(*[F.try_element_at(values, F.lit(n)).try_cast("double") for n in (metric, "score", "mos", "similarity", "value")])
    rest = F.map_filter(values, lambda k, v: ~F.lower(k).isin(*deny, metric, "score"))
    missing = F.raise_error(F.concat(F.lit(f"no {metric} score in "), F.to_json(values))).cast("double")
    return F.struct(F.coalesce(score, missing).alias("score"), rest.alias("rest"))


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, same) of binary files in two listings (path, content), matched by file name, by SHA-256."""
    side = lambda d, n: d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias(n))
    both = side(left, "a").join(side(right, "b"), "name", "full")
    return both.select("name", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def fixed_segments(samples: Column, rate: Column, seconds: float = 15.0) -> Column:
    """An array of samples as non-overlapping pieces of some seconds; the last may be shorter."""
    step = (rate * seconds).cast("int")
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(samples, i, step))


def mean_vector(vectors: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """The mean vector of each group; vectors of different lengths raise."""
    flat = vectors.select(*by, F.size(column).alias("n"), F.posexplode(column).alias("pos", "v"))
    mean = flat.groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    ok = F.when(F.col("lo") == F.col("hi"), F.col("m")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", ok.alias("m")))), lambda x: x["m"]).alias("mean"))


def cosine_pairs(rows: DataFrame, key: str, other: str, label: str, vector: str, name: str, digits: int) -> DataFrame:
    """(key, other, name): the cosine of all pairs of rows of one label with key < other, rounded half away from zero.

    A label's rows are dealt into blocks of about BLOCK by their keys' hash; each pair of blocks is one matrix product of a task, put out
    in pieces of PIECE rows, so memory follows the blocks. A pair of vectors of unequal lengths or with a zero vector raises; one with a
    missing vector has null.
    """
    spark = rows.sparkSession
    ship(spark)
    v = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    missing, v = v.where("v is null").drop("v"), v.where("v is not null")
    sizes = v.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    v = v.join(F.broadcast(sizes), "l").withColumn("b", F.pmod(F.xxhash64("k"), F.col("blocks").cast("long")).cast("int"))
    # a block goes to its pairs with every block: as the first one of a pair (lo), the second one, or both
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c")
    dealt = v.select("k", "l", "v", "b", with_).select("k", "v", "l", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), (F.col("b") <= F.col("c")).alias("first"))
    kind = rows.schema[key].dataType.simpleString()

    def similar(batches):
        def unit(x):
            ids = np.concatenate([i for i, _ in x])
            size = {m.shape[1] for _, m in x}
            if len(size) > 1:
                raise ValueError("vectors differ in length")
            return ids, np.concatenate([m for _, m in x])

        def pairs(block, same):
            if not block[True] or not (same or block[False]):
                return
            a, m = unit(block[True])
            b, w = (a, m) if same else unit(block[False])
            if m.shape[1] != w.shape[1]:
                raise ValueError("vectors differ in length")
            if same and len(a) < 2:
                return
            n, o = np.sqrt((m * m).sum(1)), np.sqrt((w * w).sum(1))
            if not n.all() or not o.all():
                raise ValueError("a vector is zero")
            step = max(1, PIECE // len(b))
            for i in range(0, len(a), step):
                x = a[i : i + step, None]
                score = m[i : i + step] @ w.T / (n[i : i + step, None] * o) * 10**digits
                score = np.trunc(score + np.copysign(0.5, score)) / 10**digits
                # across two blocks each pair is met once, within one from either side
                at = np.nonzero(x < b) if same else np.nonzero(x != b)
                p, q = a[i + at[0]], b[at[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(score[at])], [key, other, name])

        now, block = None, {True: [], False: []}
        for batch in batches:
            k, vectors, first = batch.column(0).to_numpy(), batch.column(1), batch.column(5).to_numpy(zero_copy_only=False)
            of = list(zip(*(c.to_pylist() for c in batch.columns[2:5])))
            lo = 0
            for i in range(1, len(of) + 1):
                if i == len(of) or of[i] != of[lo] or first[i] != first[lo]:
                    if of[lo] != now:
                        if now is not None:
                            yield from pairs(block, now[1] == now[2])
                        now, block = of[lo], {True: [], False: []}
                    part = vectors.slice(lo, i - lo)
                    lengths = set(np.diff(part.offsets.to_numpy()).tolist())
                    if len(lengths) > 1:
                        raise ValueError("vectors differ in length")
                    block[bool(first[lo])].append((k[lo:i], part.flatten().to_numpy(zero_copy_only=False).reshape(i - lo, lengths.pop())))
                    lo = i
        if now is not None:
            yield from pairs(block, now[1] == now[2])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "l", "lo", "hi").sortWithinPartitions("l", "lo", "hi", "first")
    found = dealt.mapInArrow(similar, f"`{key}` {kind}, `{other}` {kind}, `{name}` double")
    every = v.select("k", "l").withColumn("none", F.lit(False)).unionByName(missing.withColumn("none", F.lit(True)))
    no = missing.select(F.col("k").alias("o"), "l").join(every, "l").where("k < o or (k > o and not none)")
    return found.unionByName(no.select(F.least("k", "o").alias(key), F.greatest("k", "o").alias(other), F.lit(None).cast("double").alias(name)))
