"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged
from . import bpe, credentials, crossparse, dac, decontaminate, mixing, quality, rollup, sharding, simhash, toxicity

MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with its likeliest format and its odds against ordinary text."""
    docs = table(spark, sf_dir, "documents")
    return credentials.scan(docs, credentials.fit(docs))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a uniform random order, as shards of exact sizes."""
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with each benchmark item it holds, the longest verbatim match and its places."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loads under two tokenizers, the removal of documents labelled bad, a revision of white space, and a replayed load."""
    docs = table(spark, sf_dir, "documents")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    totals = rollup.Rollup.scratch(spark)
    first = {"byte_bpe@1": bpe.VOCABULARY, "byte_bpe_multi@1": MULTILINGUAL}
    for version, path in first.items():
        counts = staged(rollup.count_tokens(docs, vocabulary=path), "token-counts")
        totals.commit(f"load-{version.replace('@', '-')}", rollup.inserts(counts, version))
        totals.commit(f"drop-{version.replace('@', '-')}", rollup.deletes(counts.join(bad, "doc_id", "left_semi"), version))
        if path == bpe.VOCABULARY:
            spaced = docs.where(F.col("text").rlike(r"\s{2,}")).withColumn("text", F.regexp_replace("text", r"\s+", " "))
            totals.commit("white-space", rollup.revisions(counts.join(bad, "doc_id", "left_anti"), rollup.count_tokens(spaced, vocabulary=path), version))
        totals.commit(f"load-{version.replace('@', '-')}", rollup.inserts(counts, version))  # a retry: no effect
    totals.compact()
    return totals.totals()


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document as directly addressable codes."""
    return dac.encode(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative entropy of every document against good text of its language."""
    return crossparse.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy of another, with the one of its group that stays."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its inclusion probability and whether the balanced sample holds it."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_sharding, op3_decontaminate, op4_token_counts, op5_token_codes, op6_quality, op7_cross_parse, op8_simhash, op9_mixing, op10_toxicity)
}

#: None of them is within SQL's reach: automata, suffix arrays, trained models, seeded draws, BPE. tests/llm holds each against a
#: brute-force version, an exact round trip or held-out labels.
ORACLES: dict[str, str] = {}
