"""Segments in time: overlaps, diarisation error, concatenated minimum-permutation error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import tokens
from ..functions.align import distance
from ..runtime import ship


def overlaps(left: DataFrame, right: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs of intervals (start, end) of the same key that overlap, with the overlap: an equi-join on key and time bucket.

    Every interval goes to the buckets that it touches; a pair is taken in the first bucket that both touch, so once.
    """

    def bucketed(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
        out = df.where(F.col("end") > F.col("start")).select(*[F.col(c).alias(c if c == key else f"{side}_{c}") for c in df.columns], first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("bucket"))
        return out

    j = bucketed(left, "l").join(bucketed(right, "r"), [key, "bucket"])
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return j.where((F.col("bucket") == F.greatest("l_first", "r_first")) & (lo < hi)).withColumn("overlap", hi - lo).drop("bucket", "l_first", "r_first")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; every row of the shorter side has one. Shortest augmenting paths, O(n^3)."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assignment(cost.T)]
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]] = cur[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def session_der(ref: tuple, hyp: tuple, collar: float) -> tuple[float, float, float, float]:
    """(scored reference time, missed, false alarm, confusion) of one session's (speakers, starts, ends); times within the collar of a
    reference boundary don't count, nor do segments without speaker."""
    edges = [ref[1], ref[2], hyp[1], hyp[2]]
    marks = np.concatenate([ref[1], ref[2]])
    if collar:
        edges += [marks - collar, marks + collar]
    t = np.unique(np.concatenate(edges))
    if len(t) < 2:
        return 0.0, 0.0, 0.0, 0.0
    mid, width = (t[1:] + t[:-1]) / 2, np.diff(t)
    if collar and len(marks):
        marks = np.sort(marks)
        at = np.searchsorted(marks, mid)
        near = np.minimum(np.abs(mid - marks[np.minimum(at, len(marks) - 1)]), np.abs(mid - marks[np.maximum(at - 1, 0)]))
        width = np.where(near < collar, 0.0, width)

    def active(speakers: list, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        of: dict = {}
        for i, s in enumerate(speakers):
            if s is not None:
                of.setdefault(s, []).append(i)
        rows = np.zeros((len(of), len(mid)), bool)
        for row, s in zip(rows, sorted(of)):
            on = np.zeros(len(mid) + 1)
            np.add.at(on, np.searchsorted(mid, start[of[s]]), 1)
            np.add.at(on, np.searchsorted(mid, end[of[s]]), -1)
            row[:] = np.cumsum(on)[:-1] > 0
        return rows

    a, b = active(*ref), active(*hyp)
    nr, nh = a.sum(0), b.sum(0)
    shared = (a * width) @ b.T.astype(float)
    right = np.zeros(len(mid))
    for i, j in assignment(-shared):
        right += a[i] & b[j]
    return tuple(float(x @ width) for x in (nr, np.maximum(nr - nh, 0), np.maximum(nh - nr, 0), np.minimum(nr, nh) - right))


def _both(ref: DataFrame, hyp: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides with `_hyp`, a session's in one partition."""
    spark = ref.sparkSession
    ship(spark)
    sides = [df.select("session", F.lit(h).alias("_hyp"), *columns) for df, h in ((ref, False), (hyp, True))]
    return sides[0].unionByName(sides[1]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session")


def _by_session(rows: DataFrame, score, schema: str) -> DataFrame:
    """(session, score(columns of ref, columns of hyp)) of each session that ref has. A partition's sessions pass one after another in
    Arrow batches: a call a session by Spark would cost more than the work in it. rows: session, _hyp, then what score reads."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def scored(batches):
        def done():
            # the columns of either side, joined where they came in several batches
            sides = [[sum((x[i] for x in got), []) if isinstance(got[0][i], list) else np.concatenate([x[i] for x in got]) for i in range(len(got[0]))] if got else None for got in held]
            if sides[0] is not None:
                out.append((now, *score(sides[0], sides[1])))

        held, now, begun = ([], []), None, False
        for batch in batches:
            session, hyp = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [c.to_pylist() if not pa.types.is_floating(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            out: list[tuple] = []
            lo = 0
            for i in range(1, len(session) + 1):
                if i == len(session) or session[i] != session[lo] or hyp[i] != hyp[lo]:
                    if not begun or session[lo] != now:
                        done()
                        held, now, begun = ([], []), session[lo], True
                    held[hyp[lo]].append([c[lo:i] for c in columns])
                    lo = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)
        out = []
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)

    return rows.sortWithinPartitions("session", "_hyp").mapInArrow(scored, schema)


def der(ref: DataFrame, hyp: DataFrame, collar: float = 0.25) -> DataFrame:
    """(session, scored, missed, false_alarm, confusion, der) of every session of ref; hypotheses of other sessions don't count."""
    none = ([], np.zeros(0), np.zeros(0))

    def one(r, h):
        total, miss, fa, conf = session_der(r, h or none, collar)
        return total, miss, fa, conf, (miss + fa + conf) / total if total else 0.0

    rows = _both(ref, hyp, ["speaker", "start", "end"])
    rows = rows.select(F.col("session").cast("string").alias("session"), "_hyp", "speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return _by_session(rows, one, "session string, scored double, missed double, false_alarm double, confusion double, der double")


def session_mean(rows: DataFrame, score: str = "der") -> DataFrame:
    """Unweighted mean over sessions; 0 without any."""
    return rows.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("score"), F.count("*").alias("num_sessions"))


def cpwer(ref: DataFrame, hyp: DataFrame, tokenise=tokens.words) -> DataFrame:
    """(session, errors, length, cpwer): each speaker's words in time order as one text, speakers matched for the fewest errors.

    A speaker without partner counts as all deletions or all insertions.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", F.coalesce("words", F.lit("")).alias("words"))))
    g = _both(ref, hyp, ["speaker", "start", "words"]).groupBy("session", "_hyp", "speaker").agg(F.array_join(F.transform(ordered, lambda x: x["words"]), " ").alias("t"))

    def one(r, h):
        a, b = r[0], h[0] if h else []
        n = max(len(a), len(b))
        a, b = a + [[]] * (n - len(a)), b + [[]] * (n - len(b))
        cost = np.array([[distance(x, y) for y in b] for x in a], float)
        errors, length = int(sum(cost[i, j] for i, j in assignment(cost))), sum(map(len, a))
        return errors, length, errors / length if length else 0.0

    rows = g.select(F.col("session").cast("string").alias("session"), "_hyp", tokenise(F.col("t")).alias("tokens"))
    return _by_session(rows, one, "session string, errors long, length long, cpwer double")


def combined(rows: DataFrame) -> DataFrame:
    """All sessions' errors over all their words."""
    return rows.agg(F.try_divide(F.sum("errors").cast("double"), F.sum("length")).alias("score"), F.sum("errors").alias("errors"), F.sum("length").alias("length"))
