"""The pipeline's stages, each against what its operator says of the same input."""

from pyspark.sql import functions as F

import corpus_pipeline
from tarnsight.llm import dac, decontaminate, mixing, quality, simhash
from tarnsight.runtime import staged

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, now, SF), "test")
        assert out.columns == docs.columns
        if name == "quality rules":
            want = ids(quality.score(now, quality.fit(now, labels)).where("keep"))
        elif name == "simhash near-dedup":
            want = ids(now) - ids(simhash.near_duplicates(now))
        elif name == "benchmark decontamination":
            want = ids(now) - ids(decontaminate.matches(now, bench))
        else:
            want = ids(mixing.mix(now).where("selected"))
        assert ids(out) == want and want
        now = out
    codes = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert ids(codes) == ids(now)
    assert sorted(ids(corpus_pipeline.run(spark, SF))) == sorted(ids(now))
    row = codes.orderBy("doc_id").first().asDict()
    assert len(dac.decode_row(row)) == row["n_tokens"]


def test_awkward_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names: stage by stage what the docstrings say."""
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_text_operators import AWKWARD, CLASHING, SCHEMA

    item = " ".join(f"bench{i}" for i in range(20))
    rows = AWKWARD + [(9, f"some words before {item} and some behind", "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("c").alias(c) for c in CLASHING])
    docs = staged(docs, "awkward")
    good = spark.createDataFrame([(i, 1, 0) for i in range(4, 10)] + [(1, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    kept = staged(quality.keep_good(docs, quality.fit(docs, good)), "awkward")
    assert kept.columns == docs.columns and not {"1", "2", "3"} & set(ids(kept)) and kept.where("text is null").isEmpty()
    once = staged(simhash.drop_near_duplicates(docs), "awkward")
    assert once.columns == docs.columns and ids(once) == sorted(["1", "2", "3", "None", "None", "4", "6", "7", "8", "9"])
    clean = staged(decontaminate.remove_contaminated(once, spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")), "awkward")
    assert clean.columns == docs.columns and ids(clean) == [i for i in ids(once) if i != "9"]
    mixed = staged(mixing.take(clean), "awkward")
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    assert ids(dac.encode(clean)) == ids(clean)


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
