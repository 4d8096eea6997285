"""Joins of references with hypotheses, and what is missing on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import staged, unused


def places(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their number in a global order, from 1, without one task for all of them.

    They are sorted by ranges and written with their partition and number in it; a partition's offset comes from a table of a row each.
    """
    part, at, of, offset = unused(rows, "_part", "_at", "_of", "_offset")
    mask = F.lit((1 << 33) - 1).cast("long")  # the row's part of monotonically_increasing_id
    done = staged(rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(mask)), "places")
    counts = done.groupBy(F.col(part).alias(of)).agg(F.count("*").alias(offset))
    before = F.coalesce(F.sum(offset).over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.join(counts.withColumn(offset, before), F.col(part) == F.col(of)).withColumn(name, F.col(offset) + F.col(at) + 1).select(*rows.columns, name)


def successors(rows: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """Each row but the last with a column of the row after it in a global order."""
    at = unused(rows, "_place")[0]
    numbered = places(rows, order, at)
    return numbered.join(numbered.select((F.col(at) - 1).alias(at), F.col(column).alias(name)), at).drop(at)


def last_wins(rows: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """One row a key, the last by the columns of `order`."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def left_pairs(ref: DataFrame, hyp: DataFrame, key: str = "key", text: str = "text", order: str = "line_at") -> DataFrame:
    """(key, ref, hyp, missing) of every reference row, repeated ones too; a repeated hypothesis counts once, its last row; none is empty text."""
    one = hyp.groupBy(key).agg(F.max_by(text, order).alias("hyp"))
    joined = ref.select(key, F.col(text).alias("ref")).join(one.withColumn("found", F.lit(True)), key, "left")
    return joined.select(key, "ref", F.coalesce("hyp", F.lit("")).alias("hyp"), F.col("found").isNull().alias("missing"))


def inner_pairs(ref: DataFrame, hyp: DataFrame, key: str = "key", text: str = "text", order: str = "line_at") -> DataFrame:
    """(key, ref, hyp) of shared keys only."""
    return left_pairs(ref, hyp, key, text, order).where("not missing").drop("missing")


def coverage(ref: DataFrame, hyp: DataFrame, key: str = "key", sample: int = 10) -> DataFrame:
    """One row: counts of keys only in ref and only in hyp, and the first few of either in key order."""
    r, h = ref.select(key).distinct().withColumn("in_ref", F.lit(True)), hyp.select(key).distinct().withColumn("in_hyp", F.lit(True))
    both = r.join(h, key, "full")
    missing, extra = F.col("in_hyp").isNull(), F.col("in_ref").isNull()
    counted = both.agg(F.count_if(F.col("in_ref")).alias("num_ref"), F.count_if(F.col("in_hyp")).alias("num_hyp"), F.count_if(missing).alias("num_missing"), F.count_if(extra).alias("num_extra"))
    # the samples come from a bounded top-k, not from a set of all keys
    first = lambda cond, name: both.where(cond).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(key)).alias(name))
    return counted.crossJoin(first(missing, "missing_keys")).crossJoin(first(extra, "extra_keys"))


def require_same_keys(*tables: DataFrame, key: str = "key") -> None:
    """Raise unless all tables have the same set of keys."""
    tagged = [t.select(F.col(key).alias("key")).distinct().withColumn("n", F.lit(1)) for t in tables]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    odd = every.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") < len(tables)).orderBy("key").limit(5).collect()
    if odd:
        raise ValueError(f"key sets differ, first at {[r['key'] for r in odd]}")


def triples(src: DataFrame, ref: DataFrame, hyp: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, src, ref, hyp) of three tables."""
    s, r, h = (t.select(key, F.col(text).alias(n)) for t, n in ((src, "src"), (ref, "ref"), (hyp, "hyp")))
    return s.join(r, key).join(h, key)


def positional(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows paired by place in either order, from 1."""
    return places(left, left_order).join(places(right, right_order), "place")


def with_baseline(scores: DataFrame, baselines: DataFrame, key: str = "dataset", separator: str = "__") -> DataFrame:
    """scores with baseline columns of the exact key, else of the part before the separator."""
    b = baselines.select(F.col(key).alias("b_key"), F.struct(*[c for c in baselines.columns if c != key]).alias("b"))
    exact = scores.join(b.withColumnRenamed("b", "b1"), F.col(key) == F.col("b_key"), "left").drop("b_key")
    base = exact.join(b.withColumnRenamed("b", "b2"), F.split(F.col(key), separator)[0] == F.col("b_key"), "left").drop("b_key")
    best = F.coalesce("b1", "b2")
    return base.select(*scores.columns, *[best[c].alias(f"baseline_{c}") for c in baselines.columns if c != key])


def matches(raw, choices):
    """Choices that an answer names: by id, alone or as a word of its own; only if none, by text or alias, equal or contained. One a choice id."""
    from ..functions.text import label_value

    low = label_value(raw)
    is_id = F.filter(choices, lambda c: (low == F.lower(c["id"])) | F.rlike(F.lower(raw), F.concat(F.lit(r"(^|[^\p{L}\p{N}])"), F.regexp_replace(F.lower(c["id"]), r"([^\p{L}\p{N}])", r"\\$1"), F.lit(r"($|[^\p{L}\p{N}])"))))
    names = lambda c: F.concat(F.array(c["text"]), F.coalesce(c["aliases"], F.array().cast("array<string>")))
    by_text = F.filter(choices, lambda c: F.exists(names(c), lambda t: (label_value(t) != "") & ((label_value(t) == low) | F.contains(low, label_value(t)))))
    found = F.when(F.size(is_id) > 0, is_id).otherwise(by_text)
    return F.filter(found, lambda c, i: (i == 0) | ~F.exists(F.slice(found, F.lit(1), i), lambda d: d["id"] == c["id"]))


def option_answer(raw, prompt):
    """An answer read against the options A to D in a prompt's text: a lone letter, else an option's exact text, else the answer itself."""
    from ..functions.text import label_value
    from ..sources.structured import choices_of_prompt

    options = F.filter(choices_of_prompt(prompt), lambda c: F.upper(c["id"]).isin("A", "B", "C", "D"))
    letter = F.upper(F.regexp_extract(raw, r"(?i)(?:^|[^\p{L}\p{N}])([A-D])(?:$|[^\p{L}\p{N}])", 1))
    by_letter = F.get(F.filter(options, lambda c: F.upper(c["id"]) == letter), F.lit(0))["text"]
    by_text = F.get(F.filter(options, lambda c: label_value(c["text"]) == label_value(raw)), F.lit(0))["text"]
    return F.coalesce(by_letter, by_text, F.trim(raw))


def choice_answer(raw, choices, output: str = "id", ambiguous: str = "unresolved"):
    """(answer, status): the id or text of the choice that an answer names; itself where none or several do, unless the first shall do."""
    m = matches(raw, choices)
    none = choices.isNull() | (F.size(choices) == 0) | (F.size(m) == 0)
    several = (F.size(m) > 1) & F.lit(ambiguous == "unresolved")
    answer = F.when(none | several, F.trim(raw)).otherwise(F.get(m, F.lit(0))[output])
    return F.struct(answer.alias("answer"), F.when(none, "fallback_raw").when(several, "ambiguous").otherwise("matched_choice").alias("status"))
