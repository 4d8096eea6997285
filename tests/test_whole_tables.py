"""Queries over whole turns, documents and tables."""

import duckdb
import pytest
from test_queries import SF, TABLES, rows

from tarnsight.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_no_text_is_cut_but_as_the_survey_says():
    import re

    assert {n for n, q in catalog.ORACLES.items() if re.search(r"\[1:\d+\]", q)} == {"wer_by_lang"}


def test_error_rate_of_whole_documents(spark):
    from tarnsight.functions.align import distance

    got = {r.lang: (r.pairs, r.num_tokens, r.errors) for r in catalog.QUERIES["wer_by_lang_whole"](spark, SF).collect()}
    by, want = {}, {}
    for d, lang, t in duckdb.sql(f"select doc_id, lang, text from '{SF}/documents.parquet' order by doc_id").fetchall():
        by.setdefault(lang, []).append(t.split())
    for lang, texts in by.items():
        pairs = list(zip(texts, texts[1:]))
        want[lang] = (len(pairs), sum(len(a) for a, _ in pairs), sum(distance(a, b) for a, b in pairs))
    assert got == want


def test_diarisation_of_all_users(spark, monkeypatch):
    from tarnsight.operators import diarization

    seen, big = {}, SF.replace("sf0.001", "sf0.01")
    real = diarization.der
    monkeypatch.setattr(diarization, "der", lambda ref, hyp, **k: real(seen.setdefault("ref", ref), hyp, **k))
    catalog.QUERIES["diarization_error"](spark, big)
    events = spark.read.parquet(f"{big}/events.parquet").where("event_type in ('click', 'view', 'signup')")
    assert seen["ref"].count() == events.count() > events.where("user_id < 20").count()


def test_whole_turns_in_cpwer(spark, monkeypatch):
    from tarnsight.operators import diarization

    seen = {}
    monkeypatch.setattr(diarization, "cpwer", lambda ref, hyp: seen.setdefault("ref", ref))
    catalog.QUERIES["cp_error_rate"](spark, SF)
    want = sum(len(r.text.split()) for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role <> 'system'").collect())
    assert sum(len(r.words.split()) for r in seen["ref"].collect()) == want


def test_turns_have_the_upper_case_and_the_words_of_their_sql(spark, tmp_path):
    """A capital sharp s is one letter and no SS; ligatures, Greek with iota, tags and unusual blanks are as in SQL."""
    turns = ["stra\u00DFe \u00DF \uFB01n \u1F80 <b>x</b> a\u00A0b", "strasse ss fin \u1F88 x a b", "ss \u00DFa\tb", "\u00DF SSA b \r\n c", "\u00DF <unk>", "\u1E9E ", None, "x", "y", None]
    made = spark.createDataFrame([(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("wer_conversation_turns", "wer_decomposed", "session_macro_vs_micro"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalog.ORACLES[name])
        order = [c[0] for c in want.description]
        assert [tuple(r[c] for c in order) for r in got.collect()] == want.fetchall(), name


def test_cosine_pairs_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of 7 vectors in pieces of a few rows, a missing vector: all pairs of SQL, by matrix products and no join of vectors."""
    from tarnsight.operators import predicates

    monkeypatch.setattr(predicates, "BLOCK", 7)
    monkeypatch.setattr(predicates, "PIECE", 20)
    con = duckdb.connect()
    con.execute(f"copy (select case when vec_id % 31 = 0 then null else embedding end as embedding, vec_id, label from read_parquet('{SF}/embeddings.parquet')) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = catalog.QUERIES["embedding_cosine_pairs"](spark, str(tmp_path))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = con.execute(catalog.ORACLES["embedding_cosine_pairs"]).fetchall()
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and any(r[2] is None for r in want)


def test_no_task_reads_a_language_for_its_neighbours(spark, duck):
    """Documents are ranged over tasks, and the pairs at the ranges' ends count too."""
    bound = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        q = catalog.QUERIES["wer_by_lang"](spark, SF)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(lang" in plan and plan.index("MapInArrow") < plan.index("rangepartitioning(lang")
        got = sorted(map(tuple, q.select("lang", "pairs", "num_tokens", "errors", "score").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", bound)
    assert got == sorted(duck.execute(f"select lang, pairs, num_tokens, errors, score from ({catalog.ORACLES['wer_by_lang']})").fetchall())
