"""Corpus metrics: every one is a lazily planned aggregate of partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align, tokens
from ..runtime import ship


def scored(pairs: DataFrame, tokenise=tokens.words, fold: bool = True, weights: tuple[int, int, int] | None = None) -> DataFrame:
    """pairs (ref, hyp) with columns n, dist, cor, sub, del, ins; weights: costs of substitution, deletion, insertion other than 1."""
    ship(pairs.sparkSession)
    prepare = (lambda c: tokens.fold_tokens(tokenise(c))) if fold else tokenise
    with_tokens = pairs.withColumn("ref_tokens", prepare(F.col("ref"))).withColumn("hyp_tokens", prepare(F.col("hyp")))
    return with_tokens.withColumn("a", align.counts(F.col("ref_tokens"), F.col("hyp_tokens"), weights)).withColumn("n", F.size("ref_tokens")).select(*pairs.columns, "n", "a.dist", "a.cor", "a.sub", "a.del", "a.ins")


def error_rate(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Micro-averaged error rate of `scored` rows: all errors over all reference tokens; null where there are none."""
    s = lambda c: F.sum(c).cast("long")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("num_pairs"), s("n").alias("num_tokens"), s("cor").alias("cor"), s("sub").alias("sub"), s("del").alias("del"), s("ins").alias("ins"), F.count_if(F.col("dist") > 0).alias("num_wrong")
    )
    errors = F.col("sub") + F.col("del") + F.col("ins")
    return out.withColumn("score", F.try_divide(errors.cast("double"), F.col("num_tokens"))).withColumn("sentence_error_rate", F.try_divide(F.col("num_wrong").cast("double"), F.col("num_pairs")))


def require_tokens(report: DataFrame) -> DataFrame:
    """The report, or an error where its references hold no token."""
    return report.withColumn("score", F.when(F.coalesce("num_tokens", F.lit(0)) == 0, F.raise_error(F.lit("the references hold no token")).cast("double")).otherwise(F.col("score")))


def code_switch_rates(pairs: DataFrame) -> DataFrame:
    """One row: the mixed error rate, that of Han characters alone and that of other words alone; a side without tokens has 0."""
    r, h = tokens.code_switch(F.col("ref")), tokens.code_switch(F.col("hyp"))
    t = pairs.select(r.alias("r"), h.alias("h"))
    part = lambda pick, name: F.struct(F.size(pick(F.col("r"))).alias("n"), align.counts(pick(F.col("r")), pick(F.col("h"))).alias("a")).alias(name)
    t = t.select(part(lambda c: c, "mix"), part(tokens.han_tokens, "zh"), part(tokens.other_tokens, "en"))
    rate = lambda p: F.coalesce(F.try_divide(F.sum(f"{p}.a.dist").cast("double"), F.sum(f"{p}.n")), F.lit(0.0))
    return t.agg(rate("mix").alias("mer"), rate("zh").alias("cer"), rate("en").alias("wer"), F.sum("mix.n").alias("num_tokens"))


def spacing_repaired(pairs: DataFrame, tokenise=tokens.canonical) -> DataFrame:
    """Canonical-token rows with word spacing repaired in both directions: n, dist, cor, sub, del, ins, repairs."""
    t = pairs.withColumn("r0", tokenise(F.col("ref"))).withColumn("h0", tokenise(F.col("hyp")))
    t = t.withColumn("r", tokens.repair_spacing(F.col("r0"), F.col("h0"))).withColumn("h", tokens.repair_spacing(F.col("h0"), F.col("r0")))
    cut = lambda a, b: F.size(F.filter(F.col(a), lambda x: ~F.array_contains(F.col(b), x)))
    t = t.withColumn("repairs", cut("r0", "r") + cut("h0", "h")).withColumn("a", align.counts(F.col("r"), F.col("h")))
    return t.select(*pairs.columns, F.size("r").alias("n"), "a.dist", "a.cor", "a.sub", "a.del", "a.ins", "repairs")


def token_confusion(pairs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(token, all, cor, sub, ins, del): what became of each token, by the alignment."""
    ops = pairs.select(F.explode(align.ops(F.col("ref_tokens"), F.col("hyp_tokens"))).alias("x"))
    named = ops.select(F.coalesce("x.ref", "x.hyp").alias("token"), "x.op")
    if only is not None:
        named = named.where(F.col("token").isin(only))
    n = lambda o: F.count_if(F.col("op") == o).alias(o)
    return named.groupBy("token").agg(F.count_if(F.col("op") != "ins").alias("all"), n("cor"), n("sub"), n("ins"), n("del"))


def accuracy(rows: DataFrame, truth: str, said: str, by: list[str] = ()) -> DataFrame:
    """Accuracy over all references; an absent or unknown answer is wrong."""
    right = F.coalesce(F.col(truth) == F.col(said), F.lit(False))
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count(said).alias("num_valid"), F.count_if(F.col(said).isNull()).alias("num_invalid"))
    return out.withColumn("score", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0)))


def detected_at(threshold: Column) -> Column:
    """A sample's verdict at a threshold: detected, and its score (else its best frame, else 0) reaches it."""
    return F.col("detected") & (detection_score() >= threshold)


def detection_score() -> Column:
    return F.coalesce("score", F.array_max("scores"), F.lit(0.0))


def right_at(threshold: Column) -> Column:
    hit = detected_at(threshold)
    keyword = F.col("expected_keyword").isNull() | F.coalesce(F.col("predicted_keyword") == F.col("expected_keyword"), F.lit(False))
    return F.when(F.col("expected_detected"), hit & keyword).otherwise(~hit)


def error_type(threshold: Column) -> Column:
    hit = detected_at(threshold)
    return F.when(right_at(threshold), None).when(~F.col("expected_detected"), "false_alarm").when(hit, "wrong_keyword").otherwise("false_reject")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def kws_report(samples: DataFrame, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Confusion counts and rates at one threshold; any rate over nothing is 0. Hours are those of negatives."""
    pos, ok = F.col("expected_detected"), right_at(F.lit(threshold))
    c = samples.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(pos).alias("positives"), F.count_if(~pos).alias("negatives"), F.count_if(pos & ok).alias("true_positives"),
        F.count_if(pos & ~ok).alias("false_rejects"), F.count_if(~pos & ~ok).alias("false_alarms"), (F.sum(F.when(~pos, F.coalesce("duration", F.lit(0.0))).otherwise(0.0)) / 3600).alias("filler_hours"),
    )
    tp, fa, fr = F.col("true_positives"), F.col("false_alarms"), F.col("false_rejects")
    c = c.withColumn("accuracy", _ratio(F.col("correct"), F.col("total"))).withColumn("precision", _ratio(tp, tp + fa)).withColumn("recall", _ratio(tp, F.col("positives")))
    c = c.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("false_reject_rate", _ratio(fr, F.col("positives"))).withColumn("false_alarm_rate", _ratio(fa, F.col("negatives"))).withColumn("false_alarm_per_hour", _ratio(fa, F.col("filler_hours")))


def det_curve(samples: DataFrame, step: float = 0.01, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, false_rejects, false_alarms, rates, per hour, true_detect_rate) on a grid from 0 to 1.

    One pass: a sample says detected up to its score, so each adds 1 to the last grid point that it reaches, and running totals from the
    top give the counts of every point. Work is samples plus points, not their product.
    """
    spark = samples.sparkSession
    grid = thresholds if thresholds is not None else [round(i * step, 6) for i in range(int(round(1 / step)) + 1)]
    grid = sorted(grid)
    pos, score = F.col("expected_detected"), detection_score()
    keyword = F.col("expected_keyword").isNull() | F.coalesce(F.col("predicted_keyword") == F.col("expected_keyword"), F.lit(False))
    counts_if = F.col("detected") & (~pos | keyword)
    # the number of grid points that the score reaches
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= score))
    binned = samples.groupBy(F.when(counts_if, reach).otherwise(0).alias("reach")).agg(
        F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"), F.sum(F.when(~pos, F.coalesce("duration", F.lit(0.0))).otherwise(0.0)).alias("s")
    )
    points = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, threshold double")
    # at most one row for each point: a product of two short tables
    crossed = points.crossJoin(F.broadcast(binned)).groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("reach") >= F.col("i"), F.col("p")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("reach") >= F.col("i"), F.col("q")).otherwise(0)).alias("false_alarms"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"), (F.sum("s") / 3600).alias("hours")
    )
    fr = F.col("positives") - F.col("hits")
    return crossed.select(
        "threshold", _ratio(F.col("false_alarms"), F.col("hours")).alias("false_alarm_per_hour"), _ratio(fr, F.col("positives")).alias("false_reject_rate"), _ratio(F.col("false_alarms"), F.col("negatives")).alias("false_alarm_rate"),
        _ratio(F.col("hits"), F.col("positives")).alias("true_detect_rate"), F.col("false_alarms").cast("long").alias("false_alarms"), fr.cast("long").alias("false_rejects"),
    )


def best_recall(points: DataFrame, budget: int = 0) -> DataFrame:
    """The point of most recall within a budget of false alarms, ties to fewer alarms, fewer an hour, nearest to 0.5; one row, infeasible scores 0."""
    if budget < 0:
        raise ValueError("the false alarm budget is negative")
    rank = F.struct(F.col("true_detect_rate"), -F.col("false_alarms"), -F.col("false_alarm_per_hour"), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    best = points.where(F.col("false_alarms") <= budget).agg(F.max_by(F.struct("threshold", "true_detect_rate", "false_alarms", "false_alarm_per_hour", "false_reject_rate"), rank).alias("b"))
    return best.select(F.lit(budget).alias("false_alarm_budget"), F.coalesce("b.true_detect_rate", F.lit(0.0)).alias("score"), "b.threshold", F.col("b.false_alarms").alias("achieved_false_alarms"), "b.false_reject_rate", F.col("b").isNotNull().alias("feasible"))


def least_error(points: DataFrame) -> DataFrame:
    """The point of least false-reject plus false-alarm rate, ties to fewer alarms an hour, nearest to 0.5, then the lowest."""
    rank = F.struct(F.col("false_reject_rate") + F.col("false_alarm_rate"), "false_alarm_per_hour", F.abs(F.col("threshold") - 0.5), "threshold")
    return points.agg(F.min_by(F.struct(*points.columns), rank).alias("b")).select("b.*")


def ngram_counts(pairs: DataFrame, tokenise, orders: int = 4) -> DataFrame:
    """(order, matched, total, ref_total) of clipped n-gram counts over all pairs, for pairs with an `id`.

    Pairs are exchanged once, by id; their n-grams are counted where they arise.
    """
    t = align.spread(pairs.select("id", "ref", "hyp"), "id").select("id", tokenise(F.col("ref")).alias("r"), tokenise(F.col("hyp")).alias("h"))
    grams = F.array(*[F.struct(F.lit(n).alias("order"), F.lit(s).alias("side"), tokens.ngrams(F.col(c), n).alias("g")) for n in range(1, orders + 1) for s, c in ((0, "h"), (1, "r"))])
    each = t.select("id", F.explode(grams).alias("x")).select("id", "x.order", "x.side", F.explode("x.g").alias("gram"))
    rows = each.groupBy("id", "order", "gram").agg(F.count_if(F.col("side") == 0).alias("nh"), F.count_if(F.col("side") == 1).alias("nr"))
    return rows.groupBy("order").agg(F.sum(F.least("nh", "nr")).cast("long").alias("matched"), F.sum("nh").cast("long").alias("total"), F.sum("nr").cast("long").alias("ref_total"))


def bleu(pairs: DataFrame, tokenise=tokens.bleu_13a) -> DataFrame:
    """Corpus BLEU-4 with exponential smoothing of orders without a match, 0 to 100; needs (id, ref, hyp)."""
    c = ngram_counts(pairs, tokenise).agg(*[F.max(F.when(F.col("order") == n, F.col(k))).alias(f"{k}_{n}") for n in range(1, 5) for k in ("matched", "total", "ref_total")])
    m = [F.coalesce(F.col(f"matched_{n}"), F.lit(0)).cast("double") for n in range(1, 5)]
    t = [F.coalesce(F.col(f"total_{n}"), F.lit(0)).cast("double") for n in range(1, 5)]
    zeros = F.lit(0)
    logs, used = F.lit(0.0), F.lit(0)
    for a, b in zip(m, t):
        zeros = zeros + F.when((b > 0) & (a == 0), 1).otherwise(0)
        p = F.when(a > 0, a / b).otherwise(F.try_divide(1.0 / F.pow(F.lit(2.0), zeros), b))
        logs, used = logs + F.when(b > 0, F.log(p)).otherwise(0.0), used + F.when(b > 0, 1).otherwise(0)
    ref_len = F.coalesce(F.col("ref_total_1"), F.lit(0)).cast("double")
    brevity = F.when(t[0] >= ref_len, 1.0).otherwise(F.exp(1 - F.try_divide(ref_len, t[0])))
    score = F.when((m[0] == 0) | (used < 4), 0.0).otherwise(100 * brevity * F.exp(logs / 4))
    return c.select(score.alias("score"), brevity.alias("brevity_penalty"), t[0].cast("long").alias("hyp_length"), ref_len.cast("long").alias("ref_length"))


def chrf(pairs: DataFrame, char_order: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """chrF++ over the corpus, 0 to 100: mean F-beta of character n-grams to 6 and word n-grams to 2; needs (id, ref, hyp)."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), ""), lambda x: x != "")
    spaced = lambda c: tokens.words(F.regexp_replace(F.coalesce(c, F.lit("")), r"(^|\s)([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])(?=\S)|(?<=\S)([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])(?=\s|$)", "$1$2 $3"))
    both = ngram_counts(pairs, chars, char_order).unionByName(ngram_counts(pairs, spaced, word_order))
    p, r = F.try_divide(F.col("matched").cast("double"), F.col("total")), F.try_divide(F.col("matched").cast("double"), F.col("ref_total"))
    f = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    return both.where("total > 0 and ref_total > 0").agg(F.coalesce(100 * F.avg(f), F.lit(0.0)).alias("score"))


def segment_mean(rows: DataFrame, score: str = "score", by: list[str] = ()) -> DataFrame:
    """Mean of segment scores; no segment raises."""
    out = rows.groupBy(*by).agg(F.avg(score).alias("score"), F.count(score).alias("num_segments"))
    return out.withColumn("score", F.when(F.col("num_segments") == 0, F.raise_error(F.lit("no segment score")).cast("double")).otherwise(F.col("score")))


def provider_summary(rows: DataFrame, score: str, extra: list[str] = (), complete: list[str] = ()) -> DataFrame:
    """Mean of a score and of extra columns; those in `complete` only where every row has them."""
    return rows.agg(F.avg(score).alias("score"), F.count("*").alias("num_rows"), *[F.avg(c).alias(f"mean_{c}") for c in extra], *[F.when(F.count_if(F.col(c).isNull()) == 0, F.avg(c)).alias(f"mean_{c}") for c in complete])
