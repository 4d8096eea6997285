"""The ten operators against brute force, exact round trips and held-out labels, and on awkward tables."""

import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsight.llm import bpe, credentials, crossparse, dac, decontaminate, mixing, queries, quality, rollup, sharding, simhash, toxicity
from tarnsight.llm import textvec as tv

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (None, "some words without an id here", "en", None, 30),
    (4, "the same text as the next row, word for word", "en", "b", 44),
    (4, "the same text as the next row, word for word", "en", "b", 44),
    (5, "the same text as the next row, word for word", "en", "b", 44),
    (6, "x" * 300_000, "de", "b", 300_000),
    (7, "word " * 60_000, None, None, 300_000),
    (8, "日本語 émigré \U0001f600 it's a\x00b", "ja", "c", 20),
]

#: Names that operators give to columns of their own.
CLASHING = ["__rank__", "__gone__", "__twice__", "__words__", "__place__", "__key__", "__id__", "__source__", "__good__", "__lang__", "bucket", "h0", "h1", "a", "b", "n", "cell", "own", "sig", "position", "score", "quality", "toxic", "n_tokens", "count"]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).select("*", F.lit(1).alias("shard"), F.lit("k").alias("keep"), F.lit(2.0).alias("p"), F.lit(0).alias("y"), *[F.lit("c").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_words_agree_with_a_plain_split():
    texts = ["", "One two,two", None, "é-a  b1", "a"]
    for _, buf, off in tv.pieces(pa.array(texts)):
        w = tv.words(buf, off)
        got = [[buf[s:e].tobytes().decode().lower() for s, e in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.row[:-1], w.row[1:])]
    assert got == [[], ["one", "two", "two"], [], ["é", "a", "b1"], ["a"]]
    assert w.hash[1] == w.hash[2] and len(set(w.hash.tolist())) == 5


# --- secrets


def test_inference_accepts_its_language_only():
    rng = random.Random(1)
    words = tuple(sorted("ab" + "".join(rng.choice("01") for _ in range(6)) + "z" for _ in range(200)))
    move, bits = credentials.infer(words)

    def score(s):
        q, total = 0, 0.0
        for c in s:
            i = credentials._INDEX[c]
            if q < 0:
                return -99.0
            total += bits[q, i]
            q = move[q, i]
        return total / len(s)

    assert score("ab010101z") > -2 > score("zz010101b")
    assert len(move) < 12  # a prefix tree of the same words has hundreds of states


def _plain_score(g, s):
    codes = [credentials._INDEX[c] for c in s]
    best = None
    for k, start in enumerate(g.start):
        q, t = start, 0.0
        for c in codes:
            t += g.bits[q, c]
            q = g.move[q, c]
        t += credentials._length_bits(g.lengths[k], np.array([len(s)]))[0]
        if best is None or t > best[0] + 1e-9:
            best = (t, k)
    plain = sum(g.pairs[p, c] for p, c in zip([credentials._N, *codes[:-1]], codes)) + credentials._length_bits(g.other_lengths, np.array([len(s)]))[0]
    return g.names[best[1]], best[0] / len(s), plain / len(s)


@pytest.fixture(scope="module")
def grammar(docs):
    return credentials.fit(docs)


def test_scan_equals_a_plain_walk_and_finds_planted_secrets(spark, docs, rows, grammar):
    import re

    found = credentials.scan(docs, grammar).collect()
    text = {r[0]: r[1] for r in rows}
    want = sorted((d, m.start(), len(m[0])) for d, t in text.items() for m in re.finditer(r"[A-Za-z0-9+/_.\-]{16,}", t))
    assert sorted((r.doc_id, r.start, r.length) for r in found) == want
    for r in found[:60]:
        name, own, plain = _plain_score(grammar, text[r.doc_id][r.start : r.start + r.length])
        assert (r.format, round(r.format_bits, 6), round(r.background_bits, 6)) == (name, round(own, 6), round(plain, 6))
    secrets = {(r.doc_id, r.start) for r in found if r.is_secret}
    planted = {(d, m.start(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    assert planted <= secrets
    fresh = [v[0] for v in credentials.public_examples(1, 99).values()]
    plain = ["internationalisation", "some-hyphenated-words-here", "mail7.example.com"]
    df = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(fresh + plain)], "doc_id long, text string")
    flags = {r.doc_id: r.is_secret for r in credentials.scan(df, grammar).collect()}
    assert sum(flags[i] for i in range(len(fresh))) >= len(fresh) - 1
    assert not any(flags[i] for i in range(len(fresh), len(fresh) + len(plain)))


def test_long_candidates_equal_a_plain_walk_and_are_quick(grammar):
    import time

    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in ((credentials.SYMBOLS, 900), (credentials.SYMBOLS[:62], 1500), ("0123456789abcdef", 257), ("x", 5000), ("ab", 256))]
    codes = np.array([credentials._INDEX[c] for t in texts for c in t])
    for t, best, own, plain in zip(texts, *grammar.score(codes, np.array([len(t) for t in texts]))):
        assert (grammar.names[best], round(own, 6), round(plain, 6)) == (lambda a, b, c: (a, round(b, 6), round(c, 6)))(*_plain_score(grammar, t))
    long = np.array(rng.choices(range(64), k=1_000_000))
    began = time.process_time()
    grammar.score(long, np.array([len(long)]))
    assert time.process_time() - began < 2


def test_inference_keeps_what_a_prefix_tree_counts():
    rng = random.Random(6)
    words = tuple(sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(300)))
    move, bits = credentials.infer(words, alpha=1 - 1e-12)  # hardly anything merges
    for w in set(words):
        q = 0
        for i, c in enumerate(w):
            n = sum(x[: i + 1] == w[: i + 1] for x in words) / sum(x[:i] == w[:i] and len(x) > i for x in words)
            if len(move) > 20:  # still the tree: shares are those of the words themselves
                assert np.isclose(bits[q, credentials._INDEX[c]], np.log2((1 - credentials.SMOOTH) * n + credentials.SMOOTH / credentials._N))
            q = move[q, credentials._INDEX[c]]
    one, _ = credentials.infer(words, alpha=1e-300)  # everything is compatible
    assert len(one) == 1


def test_secrets_of_awkward_rows(awkward, empty):
    g = credentials.fit(awkward)
    out = credentials.scan(awkward, g).collect()
    assert [(r.doc_id, r.start, r.length) for r in out] == [(6, 0, 300_000)]
    assert credentials.scan(empty, credentials.fit(empty)).count() == 0
    twice = credentials.scan(awkward.where("doc_id = 6").union(awkward.where("doc_id = 6")), g)
    assert twice.count() == 2 and twice.distinct().count() == 1


# --- sharding


def test_matrix_has_exact_sums_and_the_right_law():
    before, sizes = np.concatenate(([0], np.cumsum([5, 0, 9, 13, 7]))), np.array([10, 20, 4])
    def row(i, seed):
        shard, n = sharding.matrix_row(i, before, sizes, seed)
        return np.bincount(shard, n, 3).astype(int)

    m = np.array([row(i, 3) for i in range(5)])
    assert m.sum(0).tolist() == sizes.tolist() and m.sum(1).tolist() == [5, 0, 9, 13, 7]
    draws = np.array([row(2, s)[1] for s in range(3000)])
    assert abs(draws.mean() - 9 * 20 / 34) < 0.1
    var = 9 * (20 / 34) * (14 / 34) * (25 / 33)
    assert abs(draws.var() - var) < 0.25


def test_big_populations_follow_the_law():
    rng = np.random.default_rng(0)
    x = np.array([sharding._hypergeometric(3 * 10**9, 7 * 10**9, 1000, rng) for _ in range(400)])
    assert abs(x.mean() - 300) < 3 and abs(x.std() - 14.5) < 2.5


def test_draws_by_halves_follow_the_law():
    columns = np.array([2 * 10**9, 10**9, 0, 10**9])
    x = np.array([sharding.draw(400, columns, np.random.default_rng(i)) for i in range(500)])
    assert (x.sum(1) == 400).all() and (x[:, 2] == 0).all() and np.abs(x.mean(0) - [200, 100, 0, 100]).max() < 2.5


def test_a_row_of_very_many_shards_is_quick():
    import time

    before, sizes = np.arange(1001) * 8192, np.full(1_024_000, 8)
    began = time.process_time()
    shard, n = sharding.matrix_row(500, before, sizes, 1)
    assert n.sum() == 8192 and (np.diff(shard) > 0).all() and time.process_time() - began < 3


def test_tasks_do_not_change_the_layout(spark, docs):
    out = lambda **k: sorted((r.doc_id, r.shard, r.position) for r in sharding.shuffle(docs, shard_rows=20, **k).select("doc_id", "shard", "position").collect())
    assert out() == out(most_tasks=3)


def test_shuffle_is_a_permutation_with_exact_sizes(spark, docs, awkward, empty):
    out = sharding.shuffle(docs, shard_rows=60).select("doc_id", "shard", "position").collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(Counter(r.shard for r in out).values()) == [50, 50, 50, 50]
    for s in range(4):
        assert sorted(r.position for r in out if r.shard == s) == list(range(50))
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.position))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25
    a = sharding.shuffle(awkward, sizes=[3, 7], fixed_splits=False)
    assert "shard_in" in a.columns and sorted(Counter(r.shard for r in a.collect()).values()) == [3, 7]
    assert sharding.shuffle(empty, fixed_splits=False).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle(docs, sizes=[1, 2])


def test_every_place_is_equally_likely(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(8).repartition(3).write.parquet(path)
    t = spark.read.parquet(path)
    first = Counter()
    for s in range(40):
        r = sharding.shuffle(t, sizes=[4, 4], seed=s).where("shard = 0").select("id").collect()
        first.update(x.id for x in r)
    assert all(8 <= first[i] <= 32 for i in range(8))


# --- decontamination


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 5, 400).astype(np.uint64) << np.uint64(40)
    order = decontaminate.suffix_array(w, 400)
    assert sorted(order.tolist()) == list(range(400))
    keys = [w[i:].tolist() for i in order]
    assert keys == sorted(keys)


def _plain_words(t):
    import re

    return re.findall(r"[^\W_]+|[^\x00-\x7f]+", t.lower()) if t.isascii() else [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", t.lower()) if w]


def test_matches_equal_a_plain_search(spark, docs, rows, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: _plain_words(r.text) for r in bench.collect()}
    want = {}
    for d, t, *_ in rows:
        w = _plain_words(t)
        for i, b in items.items():
            grams = {}
            for j in range(len(b) - 12):
                grams.setdefault(tuple(b[j : j + 13]), []).append(j)
            best = (0,)
            for k in range(len(w) - 12):
                for j in grams.get(tuple(w[k : k + 13]), ()):
                    n = 13
                    while k + n < len(w) and j + n < len(b) and w[k + n] == b[j + n]:
                        n += 1
                    best = max(best, (n, -k, -j))
            if best[0]:
                want[(d, i)] = (best[0], -best[1], -best[2])
    found = lambda **k: {(r.doc_id, r.item_id): (r.match_words, r.doc_word, r.item_word) for r in decontaminate.matches(docs, bench, **k).collect()}
    assert want and found() == want
    assert found(block=200) == want  # many blocks in a pass
    monkeypatch.setattr(decontaminate, "PASS", 2000)
    assert found(block=200) == want  # and several passes
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()}
    assert kept == {d for d, *_ in rows} - {d for d, _ in want}


def test_shards_overlap(monkeypatch):
    rng = np.random.default_rng(1)
    word = rng.integers(1, 2**63, 5000, dtype=np.int64).astype(np.uint64)
    block = decontaminate.Block([(0, word[990:1030]), (1, word[2000:2020])], 13)
    whole = {(int(a), int(b), int(c)) for a, b, c in zip(*decontaminate.stream_matches(word, [block])[0])}
    monkeypatch.setattr(decontaminate, "SHARD", 200)
    assert whole == {(int(a), int(b), int(c)) for a, b, c in zip(*decontaminate.stream_matches(word, [block])[0])}


def test_awkward_rows_stay(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "the same text as the next row word for word")], "item_id long, text string")
    out = decontaminate.remove_contaminated(awkward, bench)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD) - 3
    m = decontaminate.matches(awkward, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.match_words) for r in m) == [(4, None, 10), (5, None, 10)]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(awkward, bench.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(awkward.where("doc_id = 8"), bench, shortest=1).collect()} == {(8, 3)}


# --- rollups


def test_rollup_equals_a_recount_and_commits_once(spark):
    r = rollup.Rollup.scratch(spark)
    one = spark.createDataFrame([(1, "a", "en", 5), (2, "a", "en", 7), (3, None, "de", 4), (4, None, "de", 0)], "doc_id long, source string, lang string, n_tokens long")
    two = spark.createDataFrame([(1, "a", "en", 6), (2, "b", "en", 7), (3, None, "de", 4)], one.schema)
    assert r.commit("b1", rollup.inserts(one, "v1")) and not r.commit("b1", rollup.inserts(one, "v1"))
    assert r.commit("b2", rollup.revisions(one, two, "v1"))
    assert r.commit("b3", rollup.deletes(one.where("doc_id = 4"), "v1")) and r.commit("b4", rollup.inserts(one.limit(0), "v1"))
    want = {("a", "en", "v1", 1, 6), ("b", "en", "v1", 1, 7), (None, "de", "v1", 1, 4)}
    assert {tuple(x) for x in r.totals().collect()} == want
    assert r.compact() and {tuple(x) for x in r.totals().collect()} == want
    assert not r.commit("b2", rollup.inserts(one, "v1"))  # also after it was folded into a base
    assert r.commit("b5", rollup.deletes(two, "v1")) and r.totals().count() == 0
    with pytest.raises(ValueError):
        r.commit("../x", rollup.inserts(one, "v1"))


def test_compactors_at_the_same_time_change_no_total(spark):
    r = rollup.Rollup.scratch(spark)
    one = spark.createDataFrame([(1, "a", "en", 5), (2, "a", "en", 7)], "doc_id long, source string, lang string, n_tokens long")
    total = lambda: [(x.documents, x.tokens) for x in r.totals().collect()]
    for b in ("b1", "b2"):
        r.commit(b, rollup.inserts(one, "v1"))
    old = r._live()
    assert r._compact(old) and not r._compact(old) and total() == [(4, 24)]  # the same batches: the same base
    r.commit("b3", rollup.inserts(one, "v1"))
    assert total() == [(6, 36)] and r.compact() and total() == [(6, 36)]
    assert r._compact({"b2": old["b2"], "b3": r._commits()["b3"]}) and total() == [(6, 36)]  # overlaps a larger base
    r.commit("b4", rollup.deletes(one, "v1"))
    assert total() == [(4, 24)] and not r.commit("b1", rollup.inserts(one, "v1"))


def test_token_counts_of_awkward_rows(spark, awkward, empty):
    got = rollup.count_tokens(awkward)
    enc = bpe.engine(bpe.read_vocabulary(bpe.VOCABULARY)).encoding
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.where("doc_id is null or doc_id <> 6").collect()) == sorted((str(d), len(enc.encode_ordinary(t or ""))) for d, t, *_ in AWKWARD if d != 6)
    assert got.where("doc_id = 6").first().n_tokens > 0 and got.columns == ["doc_id", "source", "lang", "n_tokens"]
    r = rollup.Rollup.scratch(spark)
    assert r.commit("all", rollup.inserts(got, "v")) and r.commit("none", rollup.inserts(rollup.count_tokens(empty), "v"))
    assert r.totals().agg(F.sum("documents")).first()[0] == len(AWKWARD)
    assert rollup.revisions(got, rollup.count_tokens(awkward.withColumn("lang", F.lit("zz"))), "v").where("old_lang is null and new_tokens is null").count() == 0


def test_token_counts_query_equals_a_recount(spark, rows):
    import re

    import tiktoken

    got = {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in queries.op4_token_counts(spark, SF).collect()}
    bad = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 0").fetchall()}
    want = Counter()
    docs_ = Counter()
    for version, path in (("byte_bpe@1", bpe.VOCABULARY), ("byte_bpe_multi@1", queries.MULTILINGUAL)):
        enc = bpe.engine(bpe.read_vocabulary(path)).encoding
        assert isinstance(enc, tiktoken.Encoding)
        for d, t, lang, source in rows:
            if d not in bad:
                t = re.sub(r"\s+", " ", t) if version == "byte_bpe@1" and re.search(r"\s{2,}", t) else t
                want[(source, lang, version)] += len(enc.encode_ordinary(t))
                docs_[(source, lang, version)] += 1
    assert got == {k: (docs_[k], want[k]) for k in want}


# --- token codes


def test_ids_are_the_tokenizers_own(rows):
    v = bpe.read_vocabulary(bpe.VOCABULARY)
    texts = [r[1] for r in rows[:80]] + [a[1] for a in AWKWARD if a[1] != "x" * 300_000] + ["it's  a\n\n b\r\n x  ", " 'tis don't 12a3", "'s", "a 's b 're", "͸ new", "x\n", " a  b"]
    ids, off = bpe.encode_column(pa.array(texts, pa.string()), v)
    enc = bpe.engine(v).encoding
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == enc.encode_ordinary(t or ""), t[:50]


def test_cache_overflow_changes_nothing(rows, monkeypatch):
    v = bpe.read_vocabulary(bpe.VOCABULARY)
    texts = pa.array([r[1] for r in rows[:30]])
    want = bpe.encode_column(texts, v)
    monkeypatch.setattr(bpe, "CACHE", 512)
    bpe._ENGINES.clear()
    got = bpe.encode_column(texts, v)
    bpe._ENGINES.clear()
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("widths", [(9, 3, 4), (8, 8), (16,), (3, 3, 3, 3, 4)])
def test_codes_round_trip(widths):
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 7, 64, 0, 513, 2000])
    ids = (rng.pareto(0.4, counts.sum()) % 50257).astype(np.int32)
    cols = dict(zip(dac.columns(widths), dac.levels(ids, counts, widths)))
    at = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        row = {"n_tokens": int(n), "widths": widths} | {k: d[o[i] : o[i + 1]].tobytes() for k, (d, o) in cols.items()}
        assert dac.decode_row(row) == ids[at[i] : at[i] + n].tolist()
        assert dac.token_at(row, -1) is None and dac.token_at(row, int(n)) is None
    with pytest.raises(ValueError):
        dac.levels(np.array([70000]), np.array([1]), widths[:1])


def test_codes_of_documents(spark, awkward, empty):
    out = dac.encode(awkward).collect()
    assert len(out) == len(AWKWARD) and sum(r.n_tokens is None for r in out) == 1
    enc = bpe.engine(bpe.read_vocabulary(bpe.VOCABULARY)).encoding
    by = {r.doc_id: r for r in out}
    for d, t, *_ in AWKWARD:
        if t is not None and len(t) < 1000:
            assert dac.decode_row(by[d].asDict()) == enc.encode_ordinary(t)
    long = by[7].asDict()
    ids = enc.encode_ordinary("word " * 60_000)
    assert long["n_tokens"] == len(ids) and all(dac.token_at(long, i) == ids[i] for i in (0, 1, 511, 512, 30_000, len(ids) - 1))
    asked = spark.createDataFrame([(5, 0), (5, 3), (5, 999), (1, 0)], "doc_id long, position long")
    got = {(r.doc_id, r.position): r.token for r in dac.fetch(dac.encode(awkward.where("doc_id in (1, 5)")), asked).collect()}
    ids = enc.encode_ordinary(AWKWARD[6][1])
    assert got == {(5, 0): ids[0], (5, 3): ids[3], (5, 999): None, (1, 0): None}
    assert dac.encode(empty).count() == 0


# --- quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    forest = quality.fit(d, l.where(half))
    j = quality.score(d, forest).join(l.where(~half), "doc_id").select("keep", "quality").collect()
    wrong_drop = sum(not r.keep and r.quality == 1 for r in j) / sum(r.quality == 1 for r in j)
    wrong_keep = sum(r.keep and r.quality == 0 for r in j) / sum(r.quality == 0 for r in j)
    assert wrong_drop < 0.01 and wrong_keep < 0.02


def test_forest_equals_a_plain_walk_and_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.FEATURES)))
    k = quality.FEATURES.index("symbol_share")
    y = ((x[:, k] + 0.3 * np.sin(9 * x[:, 0])) < 0.5).astype(float)
    f = quality.train(x, y, trees=25)

    def walk(row):
        total = f.base
        for n in f.root:
            while f.left[n] != n:
                n = f.left[n] if row[f.feature[n]] <= f.threshold[n] else f.right[n]
            total += f.value[n]
        return total

    assert np.allclose(f.margin(x), [walk(r) for r in x])
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    for row in x[:30]:
        line = np.repeat(row[None], 50, 0)
        line[:, k] = np.linspace(0, 1, 50)
        assert (np.diff(f.margin(line)) <= 1e-12).all()


def _plain_statistics(t):
    import re
    from math import log1p

    t = (t or "").encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", t)]
    n, chars = max(len(words), 1), len(t.decode())
    per = lambda signs: sum(c in signs for c in t.decode() if c.isascii()) / max(chars, 1)
    lines = [x for x in t.split(b"\n")]
    if lines and not lines[-1]:
        lines.pop()
    seen, again = set(), 0
    for line in lines:
        w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", line.lower())
        key = tuple(sorted(w))  # a line's words in any order
        again += len(w) * (key in seen)
        seen.add(key) if w else None
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = max(len(lines), 1)
    upper, digit, white = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
    return [
        log1p(chars), log1p(len(words)), sum(map(len, words)) / n, log1p(max(map(len, words), default=0)), len(set(words)) / n, max(Counter(words).values(), default=0) / n, per(upper), per(digit), per("#$%&*+<=>@^~\\/_{}[]"), per(".,;:?"), per("!"), per(white),
        log1p(count), log1p(chars / count), again / n, sum(a == b for a, b in zip(words, words[1:])) / n, (len(fives) - len(set(fives))) / n, per("|"),
    ]


def test_statistics_equal_plain_ones(rows):
    texts = [r[1] for r in rows] + [a[1] for a in AWKWARD] + ["a b c d e a b c d e\n\nx y\ny x\n", "!!|| Tab\there 12 no no no", "\n\n", "one line\r\nand one\r\n"]
    x, has = quality.statistics(pa.array(texts, pa.string()))
    want = np.array([_plain_statistics(t) for t in texts])
    assert np.allclose(x, want), [(i, quality.FEATURES[j]) for i, j in np.argwhere(~np.isclose(x, want))[:5]]
    assert has.tolist() == [w[1] > 0 for w in want]


def test_quality_of_awkward_rows(spark, awkward, empty, labels):
    none = labels.limit(0)
    flat = quality.fit(awkward, none)
    got = {r.doc_id: (r.quality_score, r.keep) for r in quality.score(awkward, flat).collect()}
    assert got[1] == got[2] == got[3] == (0.0, False) and got[8][1]
    assert quality.keep_good(awkward, flat).count() == 7 and quality.keep_good(awkward, flat).columns == awkward.columns
    assert quality.score(empty, flat).count() == 0


# --- cross-parsing


def _automaton(text):
    """A suffix automaton as dicts."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def _walk(nxt, z):
    n, state = 0, 0
    for c in z:
        to = nxt[state].get(c)
        if to is None:
            n += state != 0
            to = nxt[0].get(c)
            n += to is None
        state = to or 0
    return n + (state != 0)


def test_parses_equal_a_suffix_automaton(rows):
    ref = rows[0][1][:3000]
    known, nxt = crossparse.Reference([ref], [None], [False]), _automaton(ref)
    texts = [r[1] for r in rows[1:40] if r[1]] + [ref, "\x00", "語"]
    assert known.phrases([None] * len(texts), texts) == [_walk(nxt, z) for z in texts]
    for z in texts[:12]:
        seen, part, own = set(), "", 0
        for c in z:
            part += c
            if part not in seen:
                seen.add(part)
                part, own = "", own + 1
        assert crossparse.self_phrases(z) == own + bool(part)


def _greedy(z, texts):
    i = n = 0
    while i < len(z):
        m = 0
        for t in texts:
            while i + m < len(z) and z[i : i + m + 1] in t:
                m += 1
        i, n = i + max(1, m), n + 1
    return n


def test_parses_of_texts_with_owners_in_parts_and_segments(monkeypatch):
    rng = random.Random(1)
    for _ in range(40):
        alphabet = rng.choice(["ab", "abc\0", "abcdefghij é日", "".join(chr(300 + i) for i in range(400))])
        texts = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(1, 12))})
        owners = [None if rng.random() < 0.2 else i for i in range(len(texts))]
        monkeypatch.setattr(crossparse, "PART", rng.choice([250, 700, (1 << 21) - 2]))
        monkeypatch.setattr(crossparse, "SEGMENT", rng.choice([7, 50, 2048]))
        asked = list(enumerate(texts)) + [(99, "".join(rng.choice(alphabet + "Z") for _ in range(rng.randint(1, 300)))) for _ in range(8)] + [(98, texts[0])]
        got = crossparse.Reference(texts, owners, [False] * len(texts)).phrases([d for d, _ in asked], [z for _, z in asked])
        for (d, z), n in zip(asked, got):
            others = [t for t, o in zip(texts, owners) if o is None or o != d or t != z]
            assert n == (_greedy(z, others) if others else None)


def _expected(rows, good, cells=lambda lang: 1):
    """Greedy phrases of each row against all other good texts of its language in its cell."""
    sig = crossparse.signature(pa.array([r[1] for r in rows], pa.string())).tolist()
    place = [(r[2], s % cells(r[2])) for r, s in zip(rows, sig)]
    out = {}
    for i, (d, z, *_) in enumerate(rows):
        others = [r[1] for j, r in enumerate(rows) if r[0] in good and r[1] and place[j] == place[i] and not (r[0] == d and r[1] == z)]
        out[d] = _greedy(z, others) if z and others else None
    return out


def test_cross_parse_equals_brute_force_over_cells(spark, docs, labels, rows, monkeypatch):
    some = [(d, t[:1500], lang) for d, t, lang, _ in rows] + [(10**6 + i, rows[i][1][:1500], rows[i][2]) for i in range(5)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string")
    good = {r.doc_id for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    score = lambda **k: {r.doc_id: r.cross_phrases for r in crossparse.score(df, labels, **k).collect()}
    want = _expected(some, good)
    assert score() == want
    monkeypatch.setattr(crossparse, "LEAST_TEXTS", 4)
    monkeypatch.setattr(crossparse, "GROUP", 5_000)  # several groups share a cell
    used = {}
    for (d, t, lang), s in zip(some, crossparse.signature(pa.array([r[1] for r in some])).tolist()):
        if d in good and t:
            sizes = used.setdefault(lang, {})
            sizes[s] = max(sizes.get(s, 0), len(t))
    cells = lambda lang: max(1, min(-(-sum(used.get(lang, {}).values()) // 4000), len(used.get(lang, ())) // 4))
    assert max(map(cells, used)) > 1 and score(cell=4000) == _expected(some, good, cells)


def test_long_reference_texts_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(crossparse, "PIECE", 500)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(n))
    rows = [(1, text(600), "en"), (2, text(50), "en"), (3, text(700), "en"), (4, "only its own " * 100, "de"), (5, None, None)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in (1, 2, 4)], "doc_id long, quality int, toxic int")
    cut = [rows[0][1][i : i + 500] for i in range(0, len(rows[0][1]), 500)]
    got = {r.doc_id: r.cross_phrases for r in crossparse.score(df, labels).collect()}
    assert got == {1: _greedy(rows[0][1], [rows[1][1]]), 2: _greedy(rows[1][1], cut), 3: _greedy(rows[2][1], [*cut, rows[1][1]]), 4: None, 5: None}


def test_copies_share_a_cell():
    a = " ".join(f"w{i % 37} v{i}" for i in range(300))
    s = crossparse.signature(pa.array([a, a, a + " and a little more", "other", None, ""]))
    assert s[0] == s[1] == s[2] and s[3] not in (0, s[0]) and s[4] == s[5] == 0


def test_cross_parse_streams_documents_in_bounded_batches(spark, docs, labels, tmp_path, monkeypatch):
    # no group of documents is gathered in a worker, nor are their texts exchanged
    plan = crossparse.score(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Exchange hash" not in plan
    # near copies, which share a min-hash and so a cell, however many they are
    texts = [f"the same long passage of words that all of these begin with, and then {i} of its own" for i in range(400)]
    assert len(set(crossparse.signature(pa.array(texts)).tolist())) < 200
    monkeypatch.setattr(crossparse, "CHUNK", 500)
    monkeypatch.setattr(crossparse, "BATCH", 2000)
    to = crossparse.Writer(str(tmp_path))
    for i, t in enumerate(texts):
        to.add(t, i, False)
    to.close()
    taken, most, seen = [0], [0], {}

    def batches():
        for i, t in enumerate(texts):
            taken[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array(["en"]), pa.array([t]), pa.array([0], pa.int64())], ["doc_id", "lang", "text", "cell"])

    given = 0
    for out in crossparse._score(batches(), {("en", 0): str(tmp_path)}, 4000):
        most[0] = max(most[0], taken[0] - given)
        given += out.num_rows
        seen |= dict(zip(out["doc_id"].to_pylist(), out["cross_phrases"].to_pylist()))
    assert most[0] < 30 and seen == {i: _greedy(t, texts[:i] + texts[i + 1 :]) for i, t in enumerate(texts)}


def test_cross_parse_meets_all_reference_text_at_any_size(spark):
    # 1.4 million characters of one language, more than a cell
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    texts = [" ".join(word() for _ in range(1000)) for _ in range(200)]
    asked = ["".join(t[k : k + 50] for t in rng.sample(texts, 6) for k in [rng.randrange(4000)]) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + asked)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert sum(map(len, texts)) > 1 << 20
    got = {r.doc_id: r.cross_phrases for r in crossparse.score(df, labels).where("doc_id >= 200").collect()}
    assert got == {200 + i: _greedy(z, texts) for i, z in enumerate(asked)}


def test_cross_parse_tells_languages_and_junk_apart(spark, docs, labels, awkward, empty):
    junk = spark.createDataFrame([(10**9 + i, "".join(random.Random(i).choice("qwxzkj#@") for _ in range(2000)), "en", "z", 2000) for i in range(5)], SCHEMA)
    both = crossparse.score(docs.unionByName(junk), labels).collect()
    assert len(both) == docs.count() + 5
    good = [r.relative_entropy for r in both if r.lang == "en" and r.doc_id < 10**9 and r.n_chars > 500]
    bad = [r.relative_entropy for r in both if r.doc_id >= 10**9]
    assert min(bad) > np.median(good)
    odd = {r.doc_id: r for r in crossparse.score(awkward, labels).collect()}
    assert len(crossparse.score(awkward, labels).collect()) == len(AWKWARD) and odd[1].n_chars is None and odd[2].n_chars == 0
    assert crossparse.score(empty, labels).count() == 0


def test_cross_parse_counts_in_the_jvm(spark, docs, labels, tmp_path, monkeypatch):
    # texts aren't sent to Python
    plan = crossparse.score(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow \w+\(doc_id#\w+, lang#\w+, counts#\w+\)", plan)
    scorer = crossparse.scorer(spark)
    rng = random.Random(4)
    for k in range(25):
        alphabet = rng.choice(["ab", "abc\0", "abcdefghij é日🙂", "".join(chr(300 + i) for i in range(400))])
        texts = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(1, 12))})
        owners = [None if rng.random() < 0.2 else i // 2 for i in range(len(texts))]
        pieces = [rng.random() < 0.3 for _ in texts]
        monkeypatch.setattr(crossparse, "PART", rng.choice([250, 700, (1 << 21) - 2]))
        to = crossparse.Writer(f"{tmp_path}/{k}")
        for text in zip(texts, owners, pieces):
            to.add(*text)
        to.close()
        scorer.add(None, k, f"{tmp_path}/{k}")
        asked = [(o, t) for o, t in zip(owners, texts)] + [(0, "".join(rng.choice(alphabet + "Z") for _ in range(rng.randint(1, 300)))) for _ in range(6)]
        for d, z in asked:
            others = [t for t, o, p in zip(texts, owners, pieces) if o is None or o != d or not p and t != z]
            got = scorer.call(d, None, k, z.encode())
            want = _greedy(z, others) if others else None
            assert (got.get(0), got.get(1), got.get(2)) == (len(z), want, None if want is None else crossparse.self_phrases(z))
    # a long run of its own text, piece by piece, isn't compared at every place
    monkeypatch.setattr(crossparse, "PART", 1 << 30)
    to = crossparse.Writer(f"{tmp_path}/run")
    for n in (100_000, 100_001):
        to.add("a" * n, 1, True)
    to.add("b aa aaa b", 2, False)
    to.close()
    scorer.add("en", 0, f"{tmp_path}/run")
    began = time.time()
    assert scorer.call(1, "en", 0, b"a" * 200_001).get(1) == 66_667 and time.time() - began < 30


# --- near duplicates


def _components(ids, fp, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(simhash.distances(fp[k + 1 :], fp[k]) <= radius) + k + 1:
            a, b = find(ids[k]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


def test_groups_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pdf = d.select("doc_id", "text").toPandas().sort_values("doc_id")
    fp, has = simhash.fingerprints(pa.array(pdf.text.str.lower()))
    want = _components(pdf.doc_id[has].tolist(), fp[has], simhash.RADIUS)
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(d).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    # exactly the components of the pairs that share a bucket and are near
    ids, fp = pdf.doc_id[has].to_numpy(), fp[has]
    first = np.unique(fp, axis=0, return_index=True)[1]
    bits, tables = simhash.sampling(len(first))
    root = {}
    for where in simhash._coordinates(20240517, tables, bits):
        key = simhash._bit_columns(fp, where)
        for k in np.unique(key):
            root.setdefault("edges", set()).update(
                (int(ids[i]), int(ids[j])) for at in [np.flatnonzero(key == k)] for x, i in enumerate(at) for j in at[x + 1 :][simhash.distances(fp[at[x + 1 :]], fp[i]) <= simhash.RADIUS]
            )
    near = root["edges"] | {(int(ids[f]), int(i)) for f, g in zip(first, fp[first]) for i in ids[(fp == g).all(1)] if i != ids[f]}
    up = {int(i): int(i) for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in up if find(i) != i}
    assert simhash.drop_near_duplicates(d).count() == len(pdf) - len(got)


def test_recall_at_the_radius_itself():
    rng = np.random.default_rng(5)
    n = 20_000
    bits, tables = simhash.sampling(n)
    where = simhash._coordinates(1, tables, bits)
    a = rng.integers(0, 2**64, (2000, 2), dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.permutation(128)[: simhash.RADIUS]:
            b[i, p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
    hit = np.zeros(len(a), bool)
    for w in where:
        hit |= simhash._bit_columns(a, w) == simhash._bit_columns(b, w)
    assert hit.mean() > 0.9


def test_oversized_buckets_keep_their_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (900, 2), dtype=np.uint64)
    near = base[:150].copy()
    near[:, 0] ^= np.uint64(0b111)
    fp, ids = np.concatenate([base, near]), np.arange(1050)
    monkeypatch.setattr(simhash, "OVERSIZED", 64)
    edges = simhash.bucket_edges(ids, fp, 24, np.zeros(0, int))
    got = {(min(a, b), max(a, b)) for x, y in edges for a, b in zip(x.tolist(), y.tolist())}
    assert sum((i, 900 + i) in got for i in range(150)) >= 148


def test_chains_settle(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.doc_id: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_near_duplicates_of_awkward_rows(awkward, empty):
    assert [(r.doc_id, r.duplicate_of, r.group_size) for r in simhash.near_duplicates(awkward).collect()] == [(5, 4, 2)]
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "4", "6", "7", "8"])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


# --- mixing


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(7)
    t, p = rng.integers(1, 500, 5000), np.full(5000, 0.37)
    out = mixing.flight(p, t, random.Random(1))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ t - p @ t) < 1e-3
    p, t = np.array([0.2, 0.5, 0.9, 0.3, 0.6]), np.array([3, 5, 5, 9, 0])
    many = np.mean([mixing.landing(mixing.flight(p, t, random.Random(i)), random.Random(i + 0.5)) for i in range(6000)], axis=0)
    assert np.abs(many - p).max() < 0.03


def test_mix_meets_its_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w = spark.createDataFrame([("src0", 2.0), ("src1", 1.0), ("src2", 1.0)], "source string, weight double")
    out = mixing.mix(d, w, block=100).toPandas()
    assert len(out) == 1000 and not out[out.inclusion_probability == 0].selected.any()
    g = out[out.inclusion_probability > 0].assign(want=lambda x: x.inclusion_probability * x.n_tokens, got=lambda x: x.selected * x.n_tokens).groupby("source").agg({"want": "sum", "got": "sum", "selected": "sum", "inclusion_probability": "sum", "n_tokens": "max"})
    assert (abs(g.selected - g.inclusion_probability) <= 1.0001).all() and (abs(g.want - g.got) <= 2 * g.n_tokens).all()
    assert abs(g.want["src0"] / g.want["src1"] - 2) < 1e-6
    taken = mixing.take(d, w)
    assert taken.columns == d.columns and taken.count() == int(mixing.mix(d, w).where("selected").count())


def test_mix_of_awkward_rows(spark, awkward, empty):
    out = mixing.mix(awkward).collect()
    assert len(out) == 9 and sum(r.doc_id == 4 for r in out) == 1
    assert set(mixing.take(awkward).columns) == set(awkward.columns) and mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


# --- toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit_on = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)) < 7
    held = l.where(~fit_on).select("doc_id", F.col("toxic").alias("truth"))
    out = toxicity.score(d, toxicity.fit(d, l.where(fit_on))).join(held, "doc_id").collect()
    assert np.mean([r.toxic for r in out if r.truth == 1]) > 0.85
    assert np.mean([r.toxic for r in out if r.truth == 0]) < 0.005
    assert all(0 <= r.expected_severity <= 3 for r in out)


def _plain_features(text):
    """Words and beginnings of longer words, by count."""
    import re

    c = Counter()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        c[(0, w)] += 1
        for k in toxicity.PREFIXES:
            if len(w) > k:
                c[(k, w[:k])] += 1
    return c


def test_features_equal_plain_counts():
    rng = random.Random(4)
    vocabulary = ["hate", "hateful", "hatefully", "kills", "killing", "émigré", "a", "x1", "日本語の文"]
    texts = [None, ""] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(50)]
    col = pa.array(texts, pa.string())
    row, key, times, size = toxicity.sparse(col)
    want = [_plain_features(t) for t in texts]
    assert size.tolist() == [sum(n for (k, _), n in c.items() if not k) for c in want]
    for i, c in enumerate(want):
        assert sorted(times[row == i].tolist()) == sorted(c.values())
    keys = np.unique(key)
    assert len(keys) == len({f for c in want for f in c})
    x = toxicity.Model(keys, np.zeros(len(keys) + 1), np.zeros(3)).features(col)
    for i in range(len(texts)):
        assert np.allclose(x[i, np.searchsorted(keys, key[row == i])], np.log1p(times[row == i])) and np.isclose(x[i, -1], np.log1p(size[i]))
        assert (x[i, :-1] > 0).sum() == (row == i).sum()


def test_chosen_features_equal_a_plain_count(spark):
    from fractions import Fraction
    from math import comb

    rng = random.Random(5)
    filler = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(30))
    texts = [(i, t, y) for i, (t, y) in enumerate([(f"plain words {filler()}", 0) for i in range(60)] + [(f"awful words {filler()} awfully", 1) for i in range(20)])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    pdf = spark.createDataFrame([(t,) for _, t, _ in texts], "text string").toPandas()
    fp, _ = simhash.fingerprints(pa.array(pdf.text))
    order = sorted(range(len(texts)), key=lambda i: (*fp[i].view(np.int64).tolist(), texts[i][2]))
    group = dict(zip(order, toxicity.votes(fp[order]).tolist()))
    unit = {i: (group[i], texts[i][2]) for i in group}
    seen = {}
    for i, t, _ in texts:
        for f in _plain_features(t):
            seen.setdefault(f, set()).add(unit[i])
    all_units = set(unit.values())
    rate = Fraction(sum(y for _, y in all_units), len(all_units))
    tested = {f: (len(u), sum(y for _, y in u)) for f, u in seen.items() if len(u) >= 3}
    tail = lambda n, k: sum(comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(k, n + 1))
    want = {f for f, (n, k) in tested.items() if k > n * rate and tail(n, k) <= toxicity.ALPHA / len(tested)}
    assert want and len(model.keys) == len(want)
    probe = [w.decode() for k, w in want if not k]
    x = model.features(pa.array(probe))
    assert (x[:, :-1].sum(1) > 0).all()


def test_scores_equal_plain_ones():
    rng = np.random.default_rng(9)
    x, w, theta = rng.random((20, 4)), rng.normal(size=4), np.array([-0.5, 0.2, 1.0])
    p = toxicity.Model(np.zeros(3, np.uint64), w, theta).probabilities(x)
    for row, got in zip(x, p):
        below = [1 / (1 + np.exp(-(t - sum(a * b for a, b in zip(row, w))))) for t in theta] + [1.0]
        assert np.allclose(got, np.diff([0.0, *below]))


def test_ordinal_fit_recovers_order_and_shares_weights():
    rng = np.random.default_rng(8)
    x = rng.poisson(1.0, (4000, 3)).astype(float)
    eta = x @ np.array([1.5, -1.0, 0.0])
    u = rng.logistic(size=4000) + eta
    grade = np.digitize(u, [0.0, 1.5, 3.0])
    w, theta = toxicity.fit_ordinal(x, grade)
    assert np.abs(w - [1.5, -1, 0]).max() < 0.2 and (np.diff(theta) > 0).all() and np.abs(theta - [0, 1.5, 3]).max() < 0.3
    m = toxicity.Model(np.zeros(3, np.uint64), w, theta)
    assert np.allclose(m.probabilities(x).sum(1), 1)


def test_toxicity_of_awkward_rows(awkward, empty, docs, labels):
    model = toxicity.fit(awkward, labels.limit(0))
    out = toxicity.score(awkward, model).collect()
    assert len(out) == len(AWKWARD) and not any(r.toxic for r in out)
    assert toxicity.score(empty, model).count() == 0


def test_a_tiny_source_does_not_shrink_the_mix(spark):
    def kept(sources, budget=None):
        rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, (k, n) in sources.items() for _ in range(k))]
        d = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix(d, budget=budget).toPandas()
        short = {r.source for r in mixing.shortfalls(d, budget=budget).collect()}
        return (out.inclusion_probability * out.n_tokens).sum(), out[out.selected].n_tokens.sum(), out.n_tokens.sum(), short

    even = {f"s{i}": (10, 50) for i in range(5)}
    assert kept(even)[1] == kept(even)[2]
    hot = even | {"hot": (500, 50)}
    want, got, total, _ = kept(hot)
    want2, got2, total2, short = kept(hot | {"tiny": (1, 3), None: (1, 1)})
    assert got > 0.3 * total and got2 > 0.3 * total2 and want2 > 0.9 * want and {"tiny", None} <= short and "hot" not in short
    want, got, *_, short = kept(hot | {"tiny": (1, 3)}, budget=4000)
    assert abs(want - 4000) < 1e-6 and abs(got - 4000) <= 150 and "tiny" in short


def test_several_threads_sort_one_reference(tmp_path, monkeypatch):
    """The same files however many threads sort, over many chunks with long repeats across them."""
    from tarnsight.llm import crossparse

    rng, made = np.random.default_rng(5), {}
    monkeypatch.setattr(crossparse, "CHUNK", 64)
    long = "".join(rng.choice(list("abc"), 700))
    texts = [long, long[:650] + "x", "ab" * 300, "a" * 200, *("".join(rng.choice(list("ab "), n)) for n in rng.integers(1, 60, 40))]
    for threads in (1, 3, 5):
        to = crossparse.Writer(f"{tmp_path}/{threads}", threads)
        for i, t in enumerate(texts):
            to.add(t, i, False)
        to.close()
        made[threads] = {n: (tmp_path / str(threads) / "0" / n).read_bytes() for n in ("sa", "head", "start", "run", "until", "words")}
    assert made[1] == made[3] == made[5]
    s = "".join(t + "\0" for t in texts)
    sa = [p for p in np.frombuffer(made[3]["sa"], np.int32).tolist() if p < len(s) and s[p] != "\0"]
    cut = [s[p : s.index("\0", p)] for p in sa]
    assert cut == sorted(cut)


def test_cores_of_an_executor(spark, monkeypatch):
    from types import SimpleNamespace

    from tarnsight.llm import crossparse

    def cores(**conf):
        got = {f"spark.{k.replace('_', '.')}": v for k, v in conf.items()}
        return crossparse._cores(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: got)))

    assert cores(master="local-cluster[3,2,3000]") == 2 and cores(master="local[4]") == 4 and cores(master="local") == 1
    assert cores(master="yarn", executor_cores="4") == 4 and cores(master="yarn") == 1 and cores(master="local[400]") == crossparse.THREADS
