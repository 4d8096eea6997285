"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(severity <= k) = logistic(theta_k - w.x): one weight vector for all grades, ordered thresholds. x holds log(1 + count) of the words
and word beginnings (of PREFIXES bytes) that the labels single out, so that families of inflected words count as one, and the logarithm
of the document's length, against which such counts are to be read. Labels say toxic or not; the grades of training are 0 for the others
and 1 to 3 for toxic ones, by terciles of their evidence under a fit of toxic or not (1 where they use no chosen word). Features are
chosen by the exact binomial tail of their document counts at a level of ALPHA over all that are tested, however many pass; the counts
are a distributed aggregate, and only chosen features come to the driver.

The model is fitted on at most `rows` labelled documents (TRAIN_ROWS), the first by a hash of doc_id: a documented bound. In it, near
copies (SimHash within its radius) of the same label carry one vote together, so that copies of a mislabelled document count once.
Scoring covers every row and whole texts, of any length.

Output: doc_id, grade (the likeliest), expected_severity (0 to 3), toxic_probability (of grade 1 or more), toxic (that is at least 1/2).

Defined results: null, empty and wordless texts have x = 0, so the baseline's grade and probability. Repeated rows and null doc_ids get a
row each. Labels that are null are ignored, repeated ones averaged (a mean of 1/2 is toxic). Ties between grades go to the lower one. Without
labels the baseline is not toxic. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, staged
from . import simhash
from . import textvec as tv
from .quality import labelled_sample

U = np.uint64
GRADES = 4
TRAIN_ROWS = 6_000
ALPHA = 0.01
LEAST_UNITS = 3
PREFIXES = (4, 5, 6, 7)


def _hashes(buf: np.ndarray, w: tv.Words):
    """(word numbers, 42-bit keys): of whole words, then of the beginnings of longer ones, by length."""
    yield np.arange(len(w.hash)), w.hash >> U(22)
    total, down = tv.sums(buf)
    for k in PREFIXES:
        at = np.flatnonzero(w.end - w.start > k)
        s = w.start[at]
        yield at, tv.mix((total[s + k] - total[s]) * down[s] + U(k * 0x9E3779B97F4A7C15 % 2**64)) >> U(22)


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count, words of each row) of the distinct features of each text, sorted by row and key."""
    rows, keys, times, sizes, first = [], [], [], [], 0
    for _, buf, off in tv.pieces(column, 1 << 20):
        w = tv.words(buf, off)
        owner = w.owner().astype(U)
        packed = np.sort(np.concatenate([(owner[at] << U(42)) | key for at, key in _hashes(buf, w)]))
        head = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))[: len(packed)])
        rows.append((packed[head] >> U(42)).astype(np.int64) + first)
        keys.append(packed[head] & U((1 << 42) - 1))
        times.append(np.diff(np.append(head, len(packed))))
        sizes.append(np.diff(w.row))
        first += len(off) - 1
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (rows, keys, times, sizes))


@dataclass
class Model:
    keys: np.ndarray  # sorted 42-bit keys of words and word beginnings
    weight: np.ndarray  # theirs, and that of the length
    theta: np.ndarray  # GRADES - 1 thresholds, rising

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.theta[None, :] - (x @ self.weight)[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], 1), axis=1)

    def features(self, column: pa.Array) -> np.ndarray:
        out, m = [], len(self.keys)
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.keys & U(0xFFFF)).astype(np.int64)] = True
        for _, buf, off in tv.pieces(column, 1 << 20):
            n, w = len(off) - 1, tv.words(buf, off)
            x = np.zeros(n * m, np.int64)
            for at, key in _hashes(buf, w) if m else ():
                some = np.flatnonzero(maybe[(key & U(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, key[some]), m - 1)
                hit = self.keys[place] == key[some]
                row = np.searchsorted(w.row, at[some[hit]], "right") - 1
                x += np.bincount(row * m + place[hit], minlength=n * m)
            out.append(np.log1p(np.column_stack([x.reshape(n, m), np.diff(w.row)])))
        return np.concatenate(out) if out else np.zeros((0, m + 1))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray | None = None, grades: int = GRADES, ridge: float = 1e-4, rounds: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the penalised likelihood; thresholds stay ordered as a first one and positive gaps."""
    weight = np.ones(len(grade)) if weight is None else weight
    n = max(1.0, weight.sum())
    share = np.array([(weight * (grade <= k)).sum() + 0.5 for k in range(grades - 1)]) / (weight.sum() + 1)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    z = np.concatenate([np.zeros(x.shape[1]), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(z), np.zeros_like(z)
    f = x.shape[1]
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([z[f : f + 1], np.exp(z[f + 1 :])]))
        edge = np.concatenate([[-500.0], theta, [500.0]])
        eta = x @ z[:f]
        hi = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - eta, -500, 500)))
        lo = 1 / (1 + np.exp(-np.clip(edge[grade] - eta, -500, 500)))
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        g_eta = dh - dl  # of the negative log likelihood
        g_theta = np.array([-(dh[grade == k]).sum() + (dl[grade == k + 1]).sum() for k in range(grades - 1)])
        g_gap = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([x.T @ g_eta, g_gap[:1], g_gap[1:] * np.exp(z[f + 1 :])]) / n
        g[:f] += ridge * z[:f]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return z[:f], np.cumsum(np.concatenate([z[f : f + 1], np.exp(z[f + 1 :])]))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if not 0 < p < 1:
        return float(p >= 1)
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
    total, ratio = 0.0, p / (1 - p)
    for i in range(k, n + 1):
        total += term
        term *= (n - i) / (i + 1) * ratio
        if i > n * p and term < total * 1e-12:  # terms fall from the mean on
            break
    return min(1.0, total)


def votes(fp: np.ndarray) -> np.ndarray:
    """The group of each row: its first earlier group head within SimHash's radius, or itself."""
    group, heads = np.arange(len(fp)), np.zeros(0, np.int64)
    for i in range(len(fp)):
        near = np.flatnonzero(simhash.distances(fp[heads], fp[i]) <= simhash.RADIUS) if len(heads) else ()
        if len(near):
            group[i] = heads[near[0]]
        else:
            heads = np.append(heads, i)
    return group


def train(keys: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """x: the features of each training row, of the keys and the length; y: toxic or not."""
    # severity of toxic rows: terciles of the evidence by a fit of toxic or not
    evidence = x @ fit_ordinal(x, y.astype(int), weight, grades=2)[0]
    told = y & (x[:, :-1].sum(1) > 0)
    cut = np.quantile(evidence[told], [1 / 3, 2 / 3]) if told.any() else np.array([np.inf, np.inf])
    grade = y.astype(int) + (told & (evidence > cut[0])) + (told & (evidence > cut[1]))
    return Model(keys, *fit_ordinal(x, grade, weight))


def _prints(batches):
    for b in batches:
        fp, _ = simhash.fingerprints(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))], ["row", "y", "h0", "h1"])


def _unit_keys(ids: np.ndarray, unit: np.ndarray, bad: np.ndarray):
    """Rows (key, unit, bad): the features of each vote."""

    def run(batches):
        for b in batches:
            of = unit[np.searchsorted(ids, b.column("row").to_numpy())]
            row, key, _, _ = sparse(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(of[row].astype(np.int32)), pa.array(bad[of[row]])], ["key", "unit", "bad"])

    return run


def _training_rows(model: Model):
    def run(batches):
        for b in batches:
            x = model.features(b.column("text"))
            row, place = np.nonzero(x)
            off = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (place.astype(np.int32), x[row, place])]
            yield pa.RecordBatch.from_arrays([b.column("row"), *lists], ["row", "place", "value"])

    return run


def chosen_keys(sample: DataFrame, ids: np.ndarray, unit: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The sorted keys that toxic units use more often than chance explains."""
    rate = float(bad.mean())
    # one exchange: units of a key are distinct, then counted, where the key is
    pairs = sample.select("row", "text").mapInArrow(_unit_keys(ids, unit, bad), "key long, unit int, bad boolean").repartition("key").distinct()
    tested = staged(pairs.groupBy("key").agg(F.count("*").alias("df"), F.count_if("bad").alias("toxic")).where(F.col("df") >= LEAST_UNITS), "toxicity-features")
    level = ALPHA / max(1, tested.count())

    @F.pandas_udf("boolean")
    def passes(df: pd.Series, toxic: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(k), int(n), rate) <= level for n, k in zip(df, toxic)])

    got = tested.where(F.col("toxic") > F.col("df") * rate).where(passes("df", "toxic")).select("key").toArrow()
    return np.sort(got.column("key").to_numpy().astype(np.int64)).view(U)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model for `labels.toxic`, from at most `rows` labelled documents of docs."""
    ship(docs.sparkSession)
    lower = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    sample = staged(labelled_sample(lower, labels, "toxic", rows).withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    t = sample.mapInArrow(_prints, "row long, y double, h0 long, h1 long").toArrow().sort_by([(c, "ascending") for c in ("h0", "h1", "y", "row")])
    if not len(t):
        return Model(np.zeros(0, U), np.zeros(1), np.array([30.0, 31.0, 32.0]))
    ids, y = t.column("row").to_numpy(), t.column("y").to_numpy() >= 0.5
    # near copies with the same label have one vote together
    group = votes(np.stack([t.column(c).to_numpy().astype(np.int64).view(U) for c in ("h0", "h1")], 1))
    _, unit, size = np.unique(group * 2 + y, return_inverse=True, return_counts=True)
    bad = np.zeros(len(size), bool)
    bad[unit] = y
    order = np.argsort(ids)
    ids, unit, y = ids[order], unit[order], y[order]
    keys = chosen_keys(sample, ids, unit, bad)
    model = Model(keys, np.zeros(len(keys) + 1), np.zeros(GRADES - 1))
    got = sample.select("row", "text").mapInArrow(_training_rows(model), "row long, place array<int>, value array<double>").toArrow().combine_chunks()
    x = np.zeros((len(ids), len(keys) + 1))
    at = np.searchsorted(ids, got.column("row").to_numpy())
    place, value = (got.column(c).combine_chunks() for c in ("place", "value"))
    x[np.repeat(at, np.diff(place.offsets.to_numpy())), place.flatten().to_numpy()] = value.flatten().to_numpy()
    return train(keys, x, y, 1 / size[unit])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The severity of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = model.probabilities(model.features(b.column("text")))
            risk = 1 - p[:, 0]
            out = [b.column("doc_id"), pa.array(p.argmax(1).astype(np.int32)), pa.array(p @ np.arange(GRADES)), pa.array(risk), pa.array(risk >= 0.5)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "grade", "expected_severity", "toxic_probability", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, grade int, expected_severity double, toxic_probability double, toxic boolean")
