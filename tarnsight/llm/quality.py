"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays, monotone in chosen features.

`statistics` computes FEATURES of every text from its bytes, vectorised. `train` fits boosted regression trees on the logistic loss over
binned statistics; in features listed in DECREASING the score never rises with the statistic. `Forest.score` walks all trees for all
rows at once through flat arrays. A document is kept when its probability of being good reaches KEEP_FROM.

The trees are fitted on at most TRAIN_ROWS labelled documents, the first by a hash of their doc_id: a documented bound. Repeated
training rows count once, with their mean label, so that many copies of one text carry one vote. Scoring covers every row.

Defined results: a null or empty text, or one without any word, has probability 0 and is rejected. Repeated rows each get a row. A
doc_id labelled more than once has the mean of its labels. Without labels of both kinds, every document that has words gets the share of
good labels (1 without labels). An empty table gives an empty result. In `keep_good`, all columns of documents stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textvec as tv

U = np.uint64
FEATURES = [
    "log_chars", "log_words", "mean_word", "longest_word", "distinct_share", "top_word_share", "upper_share", "digit_share", "symbol_share", "stop_share",
    "exclaim_share", "space_share", "log_lines", "log_line_length", "repeated_line_share", "adjacent_repeat_share", "repeated_five_share", "pipe_share",
]
DECREASING = ("top_word_share", "symbol_share", "exclaim_share", "repeated_line_share", "adjacent_repeat_share", "repeated_five_share", "pipe_share")
TRAIN_ROWS = 20_000
KEEP_FROM = 0.5

_CLASS = np.zeros((256, 6), bool)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = [_c.isupper(), _c.isdigit(), _c in "#$%&*+<=>@^~\\/_{}[]", _c in ".,;:?", _c == "!", _c.isspace()]


def _row_sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[off]).astype(float)


def _repeats(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """By row, the weight of items that are not the first of their key."""
    if not len(key):
        return np.zeros(n)
    packed = (owner.astype(U) << U(42)) | (key >> U(22))
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    again = np.concatenate(([False], packed[1:] == packed[:-1]))
    return np.bincount(owner[order][again], weight[order][again], n)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x FEATURES, n bool): statistics of each text, and which texts have words."""
    out, has = [], []
    for _, buf, off in tv.pieces(column, 1 << 18):
        n = len(off) - 1
        w = tv.words(buf, off)
        owner = w.owner()
        count = np.diff(w.row).astype(float)
        some = np.maximum(count, 1)
        x = np.zeros((n, len(FEATURES)))
        chars = _row_sums((buf & 0xC0) != 0x80, off)
        full = np.maximum(chars, 1)
        x[:, 0], x[:, 1] = np.log1p(chars), np.log1p(count)
        length = w.end - w.start
        x[:, 2] = np.bincount(owner, length, n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        x[:, 3] = np.log1p(longest)
        row, _, times = tv.distinct_per_row(w)
        x[:, 4] = np.bincount(row, minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, row, times)
        x[:, 5] = top / some
        for k, i in enumerate((6, 7, 8, 9, 10, 11)):
            x[:, i] = _row_sums(_CLASS[buf, k], off) / full
        x[:, 17] = _row_sums(buf == 124, off) / full
        # lines: each ends at a newline or at its text's end
        breaks = np.flatnonzero(buf == 10)
        start = np.union1d(off[:-1][np.diff(off) > 0], breaks + 1)
        start = start[start < len(buf)]
        of_line = np.searchsorted(off, start, "right") - 1
        lines = np.maximum(np.bincount(of_line, minlength=n), 1)
        x[:, 12], x[:, 13] = np.log1p(lines), np.log1p(chars / lines)
        total = np.zeros(len(w.hash) + 1, U)
        np.cumsum(w.hash, out=total[1:])
        cut = np.append(np.searchsorted(w.start, start), len(w.hash))
        words_in = np.diff(cut)
        key = tv.mix(total[cut[1:]] - total[cut[:-1]])
        real = words_in > 0
        x[:, 14] = _repeats(of_line[real], key[real], words_in[real], n) / some
        same = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        x[:, 15] = np.bincount(owner[1:][same], minlength=n) / some
        if len(w.hash) >= 5:
            five, inside = np.zeros(len(w.hash) - 4, U), owner[4:] == owner[:-4]
            for k in range(5):
                five = tv.mix(five + w.hash[k : len(w.hash) - 4 + k])
            x[:, 16] = _repeats(owner[:-4][inside], five[inside], np.ones(inside.sum()), n) / some
        out.append(x)
        has.append(count > 0)
    return (np.concatenate(out), np.concatenate(has)) if out else (np.zeros((0, len(FEATURES))), np.zeros(0, bool))


@dataclass
class Forest:
    """All trees in flat arrays: node i tests feature[i] <= threshold[i] and goes to left[i] or right[i]; a leaf goes to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.broadcast_to(self.root, (len(part), len(self.root)))
            each = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[each, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[lo : lo + 4096] += self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 1.0) -> Forest:
    """Boosted trees on the logistic loss; y in [0, 1]. `least` is the smallest hessian of a child."""
    weight = np.ones(len(y)) if weight is None else weight
    prior = (weight @ y) / max(weight.sum(), 1e-12) if len(y) else 1.0
    base = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add() -> int:
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", 0.0)):
            nodes[k].append(v)
        return i

    if len(y) and y.min() < y.max():
        width = x.shape[1]
        sign = np.array([-1 if f in DECREASING else 0 for f in FEATURES]) if width == len(FEATURES) else np.zeros(width, int)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), base)
        shift = np.arange(width) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            roots.append(add())
            todo = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
            while todo:
                i, rows, low, high, d = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes["value"][i] = float(np.clip(gs / (hs + ridge), low, high))
                best = None
                if d < depth and hs >= 2 * least:
                    flat = (binned[rows] + shift).ravel()
                    gl = np.bincount(flat, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(1)
                    hl = np.bincount(flat, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(1)
                    gr, hr = gs - gl, hs - hl
                    vl, vr = (np.clip(a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
                    gain = (gl * vl - (hl + ridge) * vl**2 / 2) + (gr * vr - (hr + ridge) * vr**2 / 2) - (gs * nodes["value"][i] - (hs + ridge) * nodes["value"][i] ** 2 / 2)
                    gain[(hl < least) | (hr < least) | (sign[:, None] * (vr - vl) < 0)] = -np.inf
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = (int(f), int(b), vl[f, b], vr[f, b])
                if best:
                    f, b, wl, wr = best
                    nodes["feature"][i], nodes["threshold"][i] = f, float(edges[f][b])
                    nodes["left"][i], nodes["right"][i] = add(), add()
                    goes, mid = binned[rows, f] <= b, (wl + wr) / 2
                    bounds = ((low, high), (low, high)) if not sign[f] else ((low, mid), (mid, high)) if sign[f] > 0 else ((mid, high), (low, mid))
                    todo.append((nodes["left"][i], rows[goes], *bounds[0], d + 1))
                    todo.append((nodes["right"][i], rows[~goes], *bounds[1], d + 1))
                else:
                    margin[rows] += rate * nodes["value"][i]
    a = {k: np.array(v) for k, v in nodes.items()}
    leaf = a["left"] == np.arange(len(a["left"]))
    return Forest(a["feature"].astype(np.int32), a["threshold"].astype(float), a["left"].astype(np.int32), a["right"].astype(np.int32), np.where(leaf, a["value"] * rate, 0.0), np.array(roots, np.int32), base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """(y, text): at most `rows` labelled documents, the first by a hash of doc_id; y is the mean of a document's labels."""
    some = (
        labels.where(f"doc_id is not null and `{target}` is not null").groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id__"), "y")
    )
    # at most `rows` pairs of numbers: small whatever the input
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("__id__")).select("y", "text")


def _training_rows(batches):
    for b in batches:
        x, has = statistics(b.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x[has].ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("y").filter(pa.array(has)), lists], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """The forest for `labels.quality`, from at most `rows` labelled documents of docs."""
    ship(docs.sparkSession)
    got = labelled_sample(docs, labels, "quality", rows).mapInArrow(_training_rows, "y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    x, back = np.unique(x, axis=0, return_inverse=True)
    back = back.ravel()
    y = np.bincount(back, got["y"].to_numpy(float), len(x)) / np.maximum(np.bincount(back, minlength=len(x)), 1)
    return train(x, y)


def _score(forest: Forest, column: pa.Array) -> np.ndarray:
    x, has = statistics(column)
    return np.where(has, forest.score(x), 0.0)


def score(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, quality_score, keep) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = _score(forest, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= keep_from)], ["doc_id", "quality_score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def keep_good(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that score at least keep_from, unchanged."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        return pd.Series(_score(forest, pa.Array.from_pandas(text, type=pa.string())) >= keep_from)

    return docs.where(good(F.col("text").cast("string")))
