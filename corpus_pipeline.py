"""From raw documents to addressable token ids: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnsight.llm import dac, decontaminate, mixing, quality, simhash
from tarnsight.runtime import staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept, with all their columns.

    Null, empty and wordless texts are rejected, texts of any length are read whole, repeated rows are judged alike, null doc_ids by
    their texts; without usable labels every document with words stays. An empty table gives an empty one; names of other columns
    don't matter.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id, with all its columns.

    Rows of a null doc_id all stay, and null, empty and wordless texts, which are copies of nothing; of rows that share a doc_id one
    stays, by its text, then by a hash. An empty table gives an empty one; names of other columns don't matter.
    """
    return simhash.drop_near_duplicates(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, with all their columns.

    Null, empty and wordless texts and null doc_ids stay unless they hold one; repeated rows go or stay together; very long texts are
    searched whole. An empty table, or an empty benchmark, removes nothing; names of other columns don't matter.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The balanced sample that brings the sources to their target shares, with all its columns.

    A null source or doc_id is a value like others; rows that share both are taken or left together; texts without words count as
    documents of no token. Ties are broken by seeded draws. An empty table gives an empty one; names of other columns don't matter.
    """
    return mixing.take(docs)


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids as directly addressable codes, a row for each row.

    A null text has null codes, an empty one none; texts of any length are encoded whole, repeated rows each. An empty table gives an
    empty one; columns other than those of the result are left out.
    """
    return dac.encode(docs)


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources", mixed_documents),
    ("token codes", token_codes),
]

#: Trained trees, fingerprints and suffix arrays are beyond SQL; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
