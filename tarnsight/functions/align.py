"""Token alignment by edit distance.

Unit costs; on ties a deletion beats an insertion beats a match or substitution, in the cell that is reached. Every cell carries the
counts of its one predecessor, so the counts are those of the backtrace. Pairs go through one Arrow UDF, bit-parallel: a column of the
matrix is two long integers, of the places where it rises and falls, so whole texts of thousands of tokens cost milliseconds.
`counts_native` does the same by higher-order functions in the JVM, which pays for pairs of a few tokens only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

BLOCK = 256
COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("dist", "cor", "sub", "del", "ins")])
OPS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("op", "ref", "hyp")]))


def _cell(dist, cor, sub, dele, ins):
    return F.struct(dist.cast("int").alias("dist"), cor.cast("int").alias("cor"), sub.cast("int").alias("sub"), dele.cast("int").alias("del"), ins.cast("int").alias("ins"))


def _plus(c: Column, cor: int = 0, sub: int = 0, dele: int = 0, ins: int = 0) -> Column:
    return _cell(c["dist"] + (sub + dele + ins), c["cor"] + cor, c["sub"] + sub, c["del"] + dele, c["ins"] + ins)


def counts_native(ref: Column, hyp: Column) -> Column:
    """dist, cor, sub, del, ins of two token arrays, in the JVM."""
    zero = F.lit(0)
    start = F.transform(F.sequence(zero, F.size(hyp)), lambda j: _cell(j, zero, zero, zero, j))

    def row(before: Column, r: Column) -> Column:
        first = F.array(_plus(F.element_at(before, 1), dele=1))

        def step(done: Column, j: Column) -> Column:
            dele = _plus(F.element_at(before, j + 1), dele=1)
            ins = _plus(F.element_at(done, -1), ins=1)
            same = F.element_at(hyp, j) == r
            diag = F.when(same, _plus(F.element_at(before, j), cor=1)).otherwise(_plus(F.element_at(before, j), sub=1))
            best = F.least(dele["dist"], ins["dist"], diag["dist"])
            return F.concat(done, F.array(F.when(dele["dist"] == best, dele).when(ins["dist"] == best, ins).otherwise(diag)))

        return F.aggregate(F.sequence(F.lit(1), F.size(hyp)), first, step)

    full = F.element_at(F.aggregate(ref, start, row), -1)
    n, m = F.size(ref), F.size(hyp)
    return F.when(m == 0, _cell(n, zero, zero, n, zero)).when(n == 0, _cell(m, zero, zero, zero, m)).when(ref == hyp, _cell(zero, n, zero, zero, zero)).otherwise(full)


def _masks(ref: list) -> dict:
    """For each token, the bits of its places in ref."""
    at: dict = {}
    for i, t in enumerate(ref):
        at[t] = at.get(t, 0) | 1 << i
    return at


def _column(pv: int, nv: int, hit: int, all_: int) -> tuple[int, int, int]:
    """One column of the matrix as bits (Myers, Hyyro): (vertical +1, vertical -1, horizontal +1); bit i is row i + 1."""
    d = (((hit & pv) + pv) ^ pv) | hit | nv
    ph, nh = nv | (all_ & ~(d | pv)), d & pv
    down = ph << 1 | 1
    return (nh << 1 | (all_ & ~(d | down))) & all_, down & d & all_, ph


def distance(ref: list, hyp: list) -> int:
    """Edit distance of two token lists: all rows of a column in a few operations on long integers."""
    n = len(ref)
    if not n:
        return len(hyp)
    at, all_ = _masks(ref), (1 << n) - 1
    pv, nv = all_, 0
    for t in hyp:
        pv, nv, _ = _column(pv, nv, at.get(t, 0), all_)
    return len(hyp) + pv.bit_count() - nv.bit_count()


def align_ops(ref: list, hyp: list) -> list[tuple[str, str | None, str | None]]:
    """The alignment: (op, ref token, hyp token). Columns are kept every BLOCK hypothesis tokens and made again block by block from the end."""
    n, m = len(ref), len(hyp)
    at, all_ = _masks(ref), (1 << n) - 1
    pv, nv, kept = all_, 0, []
    for j, t in enumerate(hyp):
        if j % BLOCK == 0:
            kept.append((pv, nv))
        pv, nv, _ = _column(pv, nv, at.get(t, 0), all_)
    out, i, j, columns = [], n, m, []
    while i and j:
        if not columns:
            pv, nv = kept.pop()
            for t in hyp[len(kept) * BLOCK : j]:
                pv, nv, ph = _column(pv, nv, at.get(t, 0), all_)
                columns.append((pv, ph))
        vertical, horizontal = columns[-1]
        bit = i - 1
        if vertical >> bit & 1:
            i -= 1
            out.append(("del", ref[i], None))
            continue
        columns.pop()
        j -= 1
        if horizontal >> bit & 1:
            out.append(("ins", None, hyp[j]))
        else:
            i -= 1
            out.append(("cor" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
    out += [("del", ref[k], None) for k in range(i - 1, -1, -1)]
    out += [("ins", None, hyp[k]) for k in range(j - 1, -1, -1)]
    return out[::-1]


def align_counts(ref: list, hyp: list) -> tuple[int, int, int, int, int]:
    """(dist, cor, sub, del, ins) of two token lists."""
    if ref == hyp:
        return 0, len(ref), 0, 0, 0
    ops_ = [o for o, _, _ in align_ops(ref, hyp)]
    cor = ops_.count("cor")
    return len(ops_) - cor, cor, ops_.count("sub"), ops_.count("del"), ops_.count("ins")


def weighted_counts(ref: list, hyp: list, sub: int = 4, dele: int = 3, ins: int = 3) -> tuple[int, int, int, int, int]:
    """(errors, cor, sub, del, ins) of the alignment of least weighted cost; ties as for unit costs. A numpy row at a time, the path by its kinds."""
    n, m = len(ref), len(hyp)
    code = {t: i for i, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    h, j = np.array([code[t] for t in hyp], np.int64), np.arange(m + 1)
    cost, kind = ins * j, np.zeros((n + 1, m + 1), np.int8)  # 0 del, 1 ins, 2 sub, 3 cor
    kind[0] = 1
    for i, t in enumerate(ref, 1):
        hit = h == code[t]
        best = cost + dele
        np.minimum(best[1:], cost[:-1] + np.where(hit, 0, sub), out=best[1:])
        new = np.minimum.accumulate(best - ins * j) + ins * j
        kind[i, 1:] = np.where(new[1:] == cost[1:] + dele, 0, np.where(new[1:] == new[:-1] + ins, 1, np.where(hit, 3, 2)))
        cost = new
    count, i, k = [0] * 4, n, m
    while i or k:
        what = kind[i, k]
        count[what] += 1
        i, k = i - (what != 1), k - (what != 0)
    return sum(count[:3]), count[3], count[2], count[0], count[1]


@F.pandas_udf(COUNTS)
def _weighted_arrow(ref: pd.Series, hyp: pd.Series, weights: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 5 if r is None or h is None else weighted_counts(r.tolist(), h.tolist(), *map(int, w)) for r, h, w in zip(ref, hyp, weights)]
    return pd.DataFrame(rows, columns=["dist", "cor", "sub", "del", "ins"], dtype="Int32")


@F.pandas_udf(COUNTS)
def _counts_arrow(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 5 if r is None or h is None else align_counts(r.tolist(), h.tolist()) for r, h in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["dist", "cor", "sub", "del", "ins"], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _distance_arrow(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else distance(r.tolist(), h.tolist()) for r, h in zip(ref, hyp)], dtype="Int32")


def counts(ref: Column, hyp: Column, weights: tuple[int, int, int] | None = None) -> Column:
    """dist, cor, sub, del, ins of two token arrays of any length; `counts_native` suits pairs of a few tokens.

    weights: costs of a substitution, a deletion and an insertion where they differ (4, 3, 3 is usual); dist counts errors all the same.
    """
    return _counts_arrow(ref, hyp) if weights is None else _weighted_arrow(ref, hyp, F.array(*map(F.lit, weights)))


def distances(ref: Column, hyp: Column) -> Column:
    """The edit distance alone."""
    return _distance_arrow(ref, hyp)


def spread(pairs, *keys: str):
    """pairs over all shuffle partitions: alignment is much work for few bytes, which adaptive execution would put into one task."""
    ship(pairs.sparkSession)
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@F.pandas_udf(OPS)
def ops(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else [{"op": o, "ref": a, "hyp": b} for o, a, b in align_ops(r.tolist(), h.tolist())] for r, h in zip(ref, hyp)])
