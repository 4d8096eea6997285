"""Mixing sources to target weights by balanced sampling (cube method).

Every document has an inclusion probability: its source's target share of the tokens over the source's own tokens, scaled by one budget
and capped at 1. A source with fewer tokens than its target is taken whole, what it lacks goes to the others by their weights, and
`shortfalls` reports it. So no tiny source sets the size of the sample.
The flight phase moves the vector of probabilities through the null space of the balancing constraints (a source's documents and its
tokens), so that both totals stay what the probabilities promise, until every probability but a few is 0 or 1: first in blocks of a
source that run apart, then over what the blocks left of each source, at most two documents a block. The landing phase frees the last
two documents or fewer of a source from the token constraint, then from both.

Expected totals are exact for every document; realised documents of a source are within 1 of the promise, and tokens within the largest
document or two. All draws follow from the seed and the doc_id.

Unit: rows that share doc_id and source are one document, taken or left together, with the sum of their tokens. A null doc_id or null
source is a value like others. Tokens are white-space words of the whole text; a null, empty or blank text has none and takes part in the
document total alone. Sources without a weight are left out (probability 0); default weights are the sources' token shares to the power
TEMPERATURE, and the default budget under them is what the sources have
of their shares of all tokens: sources of like size stay whole. Weights given without a budget are met exactly, at the largest budget that
no source falls short of. Without tokens at all, every document has probability 1. An empty table gives an empty result. In `take`, all columns stay.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship, staged

TEMPERATURE = 0.5
BLOCK = 20_000
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, rng: random.Random) -> np.ndarray:
    """Probabilities moved until at most two are fractional, sums of p and of p * tokens kept."""
    p, t = p.tolist(), tokens.tolist()
    todo = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    window, at = todo[:3], 3
    while len(window) == 3:
        a, b, c = window
        u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, d in zip(window, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        stay = []
        for i, d in zip(window, u):
            x = p[i] + step * d
            p[i] = x = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            if 0 < x < 1:
                stay.append(i)
        while len(stay) < 3 and at < len(todo):
            stay.append(todo[at])
            at += 1
        window = stay
    return np.array(p)


def landing(p: np.ndarray, rng: random.Random) -> np.ndarray:
    """The last fractional probabilities to 0 or 1: pairs by the document total alone, the last one by a draw."""
    p = p.copy()
    left = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    while len(left) >= 2:
        a, b = left[0], left[1]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rng.random() * (up + down) < down else -down
        p[a], p[b] = p[a] + step, p[b] - step
        left = [i for i in left if _EPS < p[i] < 1 - _EPS]
    for i in left:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def _flown(seed: int, last: bool):
    def run(key, pdf):
        pdf = pdf.sort_values("h", kind="stable")
        rng = random.Random(f"{seed}|{last}|{key!r}")
        p = flight(pdf["p"].to_numpy(float), pdf["n_tokens"].to_numpy(np.int64), rng)
        if last:
            p = landing(p, rng)
        return pdf.assign(state=p)[["doc_id", "source", "n_tokens", "p", "h", "state"]]

    return run


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) by document."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("n_tokens"))
    return one.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))


def _targets(unit: DataFrame, weights: DataFrame | None, budget: float | None) -> DataFrame:
    """(source, all_tokens, n_docs, target, p) by source; target is in tokens and may exceed what the source has."""
    total = unit.groupBy("source").agg(F.sum("n_tokens").alias("all_tokens"), F.count("*").alias("n_docs"))
    if weights is None:
        total = total.withColumn("weight", F.pow(F.col("all_tokens").cast("double"), F.lit(TEMPERATURE)))
    else:
        w = weights.select(F.col("source").cast("string").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        total = total.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    every = Window.partitionBy()  # one row a source
    live = (F.col("weight") > 0) & (F.col("all_tokens") > 0)
    total = total.withColumn("full", F.when(live, F.col("all_tokens") / F.col("weight")))  # tokens a weight at which the source is used up
    if budget is not None:
        # sources are used up in the order of `full`; the first that isn't sets the tokens a weight
        order = every.orderBy(F.col("full").asc_nulls_last(), "source")
        before = F.coalesce(F.sum(F.when(live, F.col("all_tokens"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum(F.when(live, F.col("weight"))).over(order.rowsBetween(0, Window.unboundedFollowing))
        total = total.withColumn("place", F.row_number().over(order)).withColumn("rate", F.when(live, (F.lit(float(budget)) - before) / rest))
        rate = F.coalesce(F.min_by("rate", F.when(F.col("rate") < F.col("full"), F.col("place"))).over(every), F.max("full").over(every))
    elif weights is None:
        rate = F.sum("all_tokens").over(every) / F.sum("weight").over(every)
    else:
        rate = F.min("full").over(every)
    target = F.when(F.col("weight") > 0, rate * F.col("weight")).otherwise(0.0)
    p = F.when(F.sum("all_tokens").over(every) == 0, 1.0).when(F.col("weight") <= 0, 0.0)
    p = p.when(F.col("all_tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), target / F.col("all_tokens")))
    return total.select("source", "all_tokens", "n_docs", target.alias("target"), p.alias("p"))


def with_probability(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """`units` with p. weights: (source, weight). budget: tokens to aim at."""
    unit = units(docs)
    total = _targets(unit, weights, budget).select(F.col("source").alias("p_source"), "p", "n_docs")
    return unit.join(total, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


def shortfalls(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(source, all_tokens, target) of the sources that have fewer tokens than their target."""
    return _targets(units(docs), weights, budget).where(F.col("target") > F.col("all_tokens") * (1 + _EPS)).select("source", "all_tokens", "target")


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, inclusion_probability, selected) of every document."""
    ship(docs.sparkSession)
    unit = with_probability(docs, weights, budget).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    schema = "doc_id long, source string, n_tokens long, p double, h long, state double"
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.ceil(F.col("n_docs") / block)).alias("cell")
    first = staged(unit.groupBy("source", cell).applyInPandas(_flown(seed, False), schema), "cube-flight")
    open_ = f"state > {_EPS} and state < {1 - _EPS}"
    second = first.where(open_).groupBy("source").applyInPandas(_flown(seed, True), schema)
    done = first.where(f"not ({open_})").unionByName(second)
    return done.select("doc_id", "source", "n_tokens", F.col("p").alias("inclusion_probability"), (F.col("state") > 0.5).alias("selected"))


def take(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = 7) -> DataFrame:
    """The rows of docs that the sample holds."""
    some = mix(docs, weights, budget, seed).where("selected").select(F.col("doc_id").alias("__id__"), F.col("source").alias("__source__"))
    some = some.hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(some["__id__"]) & docs["source"].eqNullSafe(some["__source__"])
    return docs.join(some, same, "left_semi")
