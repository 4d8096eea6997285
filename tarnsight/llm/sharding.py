"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Partition i holds n_i rows and shard j shall hold m_j. A uniform permutation moves a_ij rows from i to j, where the matrix a has the row
sums n and column sums m and follows the multivariate hypergeometric law. No machine holds the matrix: the shard counts of a range of
partitions are split between its halves by a draw that depends on the seed and the range alone, so each partition finds its own row in
log2(partitions) draws, each over the shards that its range still has (in numpy; no more than the range's rows). A partition permutes its rows' targets locally; one exchange takes each row to the partition of its shard, by
number, so no two shards meet by chance; there independent random keys order it. The result is a uniform permutation of the table, with exact shard sizes.

Partition counts must not change between the pass that counts and the pass that moves: the input is the scan of a written table, whose
splits are fixed by its files, or is written once to the shared folder; a partition that finds other than its counted rows raises.

Defined results: shard and position are added to the input's columns; an input column of such a name gets the suffix `_in`. All rows are
kept, repeated rows and nulls too, and texts of any length: a row is its place in the table, not its values. Sizes differ by at most one
unless given. An empty table gives an empty result.

Only the partitions' row counts are broadcast, and the shards' sizes where they are given; even sizes are computed where they are needed.
A task writes one shard, or a run of neighbouring ones where there are more than `most_tasks`; shards and positions don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import set_aside, ship, staged

SHARD_ROWS = 8192
MOST_TASKS = 20_000
_SHIFT = 33  # monotonically_increasing_id: partition << 33 | row


def even_sizes(rows: int, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """Shard sizes of about shard_rows that differ by at most one."""
    n = max(1, -(-rows // shard_rows))
    return np.full(n, rows // n) + (np.arange(n) < rows % n)


def draw(left: int, columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of `left` rows, drawn from sum(columns), fall on each column: multivariate hypergeometric."""
    total = int(columns.sum())
    if left in (0, total) or len(columns) == 1:
        return columns.copy() if left == total else np.zeros(len(columns), np.int64) if not left else np.array([left])
    if total < 1_000_000_000:  # numpy's bound
        return rng.multivariate_hypergeometric(columns, left, method="marginals")
    half = len(columns) // 2
    first = _hypergeometric(int(columns[:half].sum()), int(columns[half:].sum()), left, rng)
    return np.concatenate([draw(first, columns[:half], rng), draw(left - first, columns[half:], rng)])


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good balls among n drawn of good + bad, at any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:  # numpy's bound
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > good + bad:
        return good - _hypergeometric(good, bad, good + bad - n, rng)
    # inversion outward from the mode: about as many steps as the standard deviation is wide
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    ways = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    p = exp(ways(good, mode) + ways(bad, n - mode) - ways(good + bad, n))
    left, lo, hi, below, above = rng.random() - p, mode, mode, p, p
    while left > 0 and (below > 0 or above > 0):
        above *= (good - hi) * (n - hi) / ((hi + 1) * (bad - n + hi + 1)) if hi < min(good, n) else 0
        hi += 1
        if above > 0 and (left := left - above) <= 0:
            return hi
        below *= lo * (bad - n + lo) / ((good - lo + 1) * (n - lo + 1)) if lo > max(0, n - bad) else 0
        lo -= 1
        if below > 0 and (left := left - below) <= 0:
            return lo
    return mode


def matrix_row(partition: int, before: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, counts) of row `partition` of the communication matrix, without zeros. before: running total of the partitions' rows, from 0."""
    lo, hi, shard, columns = 0, len(before) - 1, np.flatnonzero(sizes), sizes[sizes > 0]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(int(before[mid] - before[lo]), columns, np.random.default_rng([seed, lo, hi]))
        if partition < mid:
            hi, columns = mid, left
        else:
            lo, columns = mid, columns - left
        some = columns > 0  # a range of partitions has no more shards than rows
        shard, columns = shard[some], columns[some]
    return shard, columns


def shuffle(docs: DataFrame, sizes: list[int] | None = None, seed: int = 20240601, shard_rows: int = SHARD_ROWS, fixed_splits: bool = True, most_tasks: int = MOST_TASKS) -> DataFrame:
    """docs with (shard, position). sizes: the shards' sizes, that add up to the rows; about shard_rows each where None.

    fixed_splits: docs is a scan, filter or projection of written files, which gives the same partitions each time it runs; otherwise it
    is written to the shared folder first.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = set_aside(docs, ["shard", "position", "__place__", "__key__"])
    if not fixed_splits:
        docs = staged(docs, "shuffle-input")
    pid = F.spark_partition_id()
    counts = {r[0]: r[1] for r in docs.select(pid.alias("p")).groupBy("p").count().collect()}  # a number a partition
    held = np.array([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)], np.int64)
    before = np.concatenate(([0], np.cumsum(held)))
    total = int(before[-1])
    target = even_sizes(total, shard_rows) if sizes is None else np.array(sizes, np.int64)
    if int(target.sum()) != total:
        raise ValueError(f"shard sizes add up to {int(target.sum())}; the table has {total} rows")
    sent = spark.sparkContext.broadcast((before, None if sizes is None else target))
    shards = lambda: even_sizes(total, shard_rows) if sent.value[1] is None else sent.value[1]

    @F.pandas_udf("int")
    def aim(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        before, target = sent.value[0], shards()
        part, plan, seen = -1, None, 0
        for place in batches:
            place = place.to_numpy(np.int64)
            if len(place) and plan is None:
                part = int(place[0]) >> _SHIFT
                row = matrix_row(part, before, target, seed) if part + 1 < len(before) else (np.zeros(0, np.int64),) * 2
                plan = np.random.default_rng([seed, 1, part]).permutation(np.repeat(row[0].astype(np.int32), row[1]))
            seen += len(place)
            if plan is not None and seen > len(plan):
                raise ValueError(f"partition {part} has more rows than were counted: the input's partitions changed")
            yield pd.Series(plan[place & ((1 << _SHIFT) - 1)] if len(place) else np.zeros(0, np.int32))
        if plan is not None and seen != len(plan):
            raise ValueError(f"partition {part} has {seen} rows where {len(plan)} were counted: the input's partitions changed")

    # never evaluated twice or over rows that a later filter leaves: it counts the rows that it sees
    aim = aim.asNondeterministic()
    per = max(1, -(-len(target) // most_tasks))
    parts = -(-len(target) // per)

    @F.pandas_udf("long")
    def ahead(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        target = shards()
        first = np.cumsum(target) - target
        shift = first - first[np.arange(len(target)) // per * per]
        for shard in batches:
            yield pd.Series(shift[shard.to_numpy()])

    rows = docs.withColumn("__place__", F.monotonically_increasing_id()).withColumn("shard", aim("__place__"))
    rows = rows.repartitionById(parts, F.floor(F.col("shard") / per).cast("int"))
    rows = rows.withColumn("__key__", F.xxhash64(F.lit(seed + 2), "__place__")).sortWithinPartitions("shard", "__key__", "__place__").drop("__key__", "__place__")
    # a row's number in its sorted partition, less the rows of the shards before its own
    return rows.withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SHIFT) - 1)) - ahead("shard"))
