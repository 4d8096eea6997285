"""Metric registry, suites, histories, rule files, verbalising normalisers, small readers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsight.functions import align, signal, verbal
from tarnsight.operators import alignment, metrics
from tarnsight.plans import evaluation
from tarnsight.sources import imports, keytext, sinks, structured


def keyed(spark, rows):
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "line_at int, key string, text string")


def _weighted(r, h):
    cost = {(0, 0): (0, 0, 0, 0, 0)}
    for i in range(len(r) + 1):
        for j in range(len(h) + 1):
            tries = []
            if i:
                c = cost[i - 1, j]
                tries.append((c[0] + 3, c[1], c[2], c[3] + 1, c[4]))
            if j:
                c = cost[i, j - 1]
                tries.append((c[0] + 3, c[1], c[2], c[3], c[4] + 1))
            if i and j:
                c, s = cost[i - 1, j - 1], int(r[i - 1] != h[j - 1])
                tries.append((c[0] + 4 * s, c[1] + 1 - s, c[2] + s, c[3], c[4]))
            if tries:
                cost[i, j] = min(tries, key=lambda t: t[0])
    return cost[len(r), len(h)]


def test_weighted_alignment_and_totals(spark):
    rng = random.Random(1)
    for _ in range(150):
        r, h = [rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        got, want = align.weighted_counts(r, h), _weighted(r, h)
        assert got[1:] == want[1:] and got[0] == sum(want[2:])
    pairs = spark.createDataFrame([("a b c d", "a x c"), ("e f", "e f")], "ref string, hyp string")
    t = evaluation.sclite_totals(metrics.scored(pairs, weights=(4, 3, 3))).first()
    assert (t.sentences, t.words, t.cor, t.sub, t["del"], t.ins, t.err, t.s_err) == (2, 6, 66.7, 16.7, 16.7, 0.0, 33.3, 50.0)


def test_metrics_by_name_and_suites(spark):
    ref, hyp = keyed(spark, [("1", "a b"), ("2", "c d")]), keyed(spark, [("1", "a b"), ("2", "c x")])
    assert {r.metric: r.score for r in evaluation.calculate_batch(["wer", "sclite_wer", "accuracy"], ref=ref, hyp=hyp).collect()} == {"wer": 0.25, "sclite_wer": 0.25, "accuracy": 0.5}
    with pytest.raises(LookupError):
        evaluation.calculate("nothing", ref=ref, hyp=hyp)
    suite = {"one": {"metric": "wer", "ref": ref, "hyp": hyp}, "two": {"metric": "utmos", "samples": ref.withColumnRenamed("key", "sample_id")}}
    out = {r.dataset: r for r in evaluation.evaluate_all(suite).collect()}
    assert out["one"].score == 25.0 and out["one"].error is None and out["two"].score is None and "provider" in out["two"].error
    ref, hyp = keyed(spark, [("1", "happy"), ("2", "sad"), ("3", "none")]), keyed(spark, [("9", "hap"), ("8", "what"), ("7", "neu")])
    assert evaluation.strict_accuracy(ref, hyp).first().asDict() == {"total": 1, "correct": 1, "num_valid": 1, "num_invalid": 0, "score": 1.0}


def test_histories_and_recommendations(spark, tmp_path):
    base = structured.read_baselines(spark, 'baselines:\n  "x":\n    metric: "wer"\n    score: 10.0\n    higher_is_better: false\n  y:  # no score\n    metric: "wer"\n')
    assert [tuple(r)[:4] for r in base.collect()] == [("x", "wer", 10.0, False)]
    assert structured.read_baselines(spark, sinks.baseline_yaml(base)).collect() == base.collect()
    rows = spark.createDataFrame([("t1", "x__a", "wer", 20.0, "1"), ("t2", "x__a", "wer", 5.0, "1"), ("t2", "x__a", "wer", 8.0, "2"), ("t3", "z_kws", "wer", 1.0, "1")], "tool_name string, dataset string, metric string, score double, timestamp string")
    evaluation.record(rows, base, str(tmp_path / "store"))
    got = evaluation.recommend(structured.read_records(spark, str(tmp_path / "store")))
    assert [tuple(r) for r in got.orderBy("dataset", "rank").collect()] == [("x__a", "asr", 1, "t2", 1.25, 8.0), ("x__a", "asr", 2, "t1", 0.5, 20.0), ("z_kws", "kws", 1, "t3", None, 1.0)]


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, float("nan"), None), (4, 1.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "a"), (2, 2.1, "b"), (3, float("nan"), None), (5, 1.0, "x")], "k int, v double, s string")
    assert sorted((r.k, r.column) for r in evaluation.differences(a, b, ["k"]).collect()) == [(2, "v"), (4, "s"), (4, "v"), (5, "s"), (5, "v")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "ref.txt").write_text("1\ta b\n2\tc d\n")
    (tmp_path / "hyp.txt").write_text("1\ta b\n2\tc\n")
    evaluation.main(["--metric", "wer", "--ref", str(tmp_path / "ref.txt"), "--hyp", str(tmp_path / "hyp.txt"), "--out", str(tmp_path / "out.json")])
    assert '"score": 0.25' in capsys.readouterr().out and '"num_tokens": 4' in (tmp_path / "out.json").read_text()


@pytest.mark.parametrize(
    "language, text, said",
    [
        ("en", "6' and the 21st of the 1990s", "six feet and the twenty-first of the nineteen nineties"), ("en", "$12.50 or $190", "twelve dollars, fifty cents or one hundred and ninety dollars"), ("en", "call 555-0199", "call five five five zero one nine nine"),
        ("en", "-5 1,234 3.14 1905s", "minus five one thousand, two hundred and thirty-four three point one four nineteen oh-fives"), ("en", "1234567890123", "1234567890123"),
        ("zh", "一五岁25人", "十五岁二十五人"), ("zh", "100kg 120m2", "一百千克 一百二十米二"), ("zh", "150% 100/200 -500 20°C", "百分之一百五十 二百分之一百 负五百 二十摄氏度"), ("zh", "123456", "十二万三千四百五十六"),
    ],
)
def test_recognisers_texts(language, text, said):
    assert " ".join(verbal.recogniser(text, language).split()) == said


def test_rules_sets_and_cleaning():
    rules = verbal.read_rules(["a|b # c", "# x", "foo bar", r"\bcat dog"], "en")
    assert rules == [("\\bcat", " dog "), ("foo", " bar "), ("a", " b ")] and verbal.apply("cat foo", rules[:2]) == " dog   bar "
    assert verbal.read_rules(["零 0"], "zh") == [("零", "0")]
    with pytest.raises(ValueError):
        verbal.read_rules(["a b c"], "en")
    digits = [(str(d), w) for d, w in enumerate("零一二三四五六七八九")]
    assert verbal.recogniser("12345 007 100000", "zh", digits=digits) == "一二三四五 零零七 十万"
    assert verbal.code_points("c-a0b\\u0064") == [(48, 48), (97, 100)]
    assert verbal.char_class(verbal.without(verbal.code_points("a-z"), verbal.code_points("c-e")), True) == "a-bf-z"
    assert verbal.clean("Don’t — re‑use (x) ٣ cats") == "don't re-use three cats" and verbal.clean("Café!", alphabet="a-zA-Z", fold=True) == "cafe"
    assert verbal.code_switched("我有25个apple和3") == "我有二十五个apple和三"


def test_small_readers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"key":"a","v":1}\nnonsense\n{"v":2}\n\n{"key":"a","v":3}\n')
    good, bad = structured.read_predictions(spark, str(tmp_path / "p.jsonl"))
    assert [(r.key, r.value) for r in good.collect()] == [("a", '{"key":"a","v":3}')]
    assert sorted((r.problem, r.key) for r in bad.collect()) == [("duplicate", "a"), ("line:2", None), ("line:3:missing_key", None)]
    (tmp_path / "k.txt").write_text("a\t1\na\t2\n\nb\t3\n")
    read = keytext.read(spark, str(tmp_path / "k.txt"), "scorer")
    assert {r.key: r.text for r in keytext.last_by_key(read).collect()} == {"a": "2", "b": "3"}
    (tmp_path / "bad.txt").write_text("a 1\n")
    with pytest.raises(Exception, match="no TAB"):
        keytext.read(spark, str(tmp_path / "bad.txt"), "scorer").collect()
    (tmp_path / "c.csv").write_text("wav,sentence\nx/one.wav, hi \n,none\ny/two.wav,ho\n")
    raw = imports.raw_json_from_csv(spark, str(tmp_path / "c.csv"), "wav", "sentence", "en")
    assert sorted((r.id, r.text) for r in raw.collect()) == [("one", "hi"), ("two", "ho")]
    assert imports.raw_json_from_csv(spark, str(tmp_path / "c.csv"), "wav", "sentence", "en", limit=1).count() == 1
    with pytest.raises(ValueError):
        imports.raw_json_from_csv(spark, str(tmp_path / "c.csv"), "wav", "nothing", "en")
    nested = spark.createDataFrame([([1.0, float("nan")], {"x": float("inf")})], "a array<double>, m map<string,double>")
    sinks.json_lines(nested, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).first()[0] == '{"a":[1.0,null],"m":{}}' or "null" in spark.read.text(str(tmp_path / "n")).first()[0]
    assert "first 2 rows" in sinks.markdown(spark.range(5).toDF("n"), 2) and "first" not in sinks.markdown(spark.range(2).toDF("n"), 2)


def test_options_of_a_prompt(spark):
    prompt = "Which?\nA. red wine\nB. blue sky"
    df = spark.createDataFrame([("it is B", prompt), ("Red Wine.", prompt), ("neither", prompt)], "raw string, prompt string")
    assert [r[0] for r in df.select(alignment.option_answer(F.col("raw"), F.col("prompt"))).collect()] == ["blue sky", "red wine", "neither"]


def test_frames_and_scores_follow_the_labels(spark):
    labels = keyed(spark, [("a", "hey you"), ("b", "other")]).select("key", "text")
    lines = spark.createDataFrame([(0, "a heyyou 0.9"), (1, "a heyyou 0.1 0.2"), (2, "b heyyou 0.7")], "line_at int, value string")
    got = {r.key: (r.detected, r.score) for r in structured.kws_from_frames(labels, lines, "heyyou").collect()}
    assert got == {"a": (False, 0.2), "b": (True, 0.7)}
    with pytest.raises(Exception, match="no frames"):
        structured.kws_from_frames(labels, lines.where("line_at < 2"), "heyyou").collect()
    scores = spark.createDataFrame([(0, "a detected heyyou 0.9"), (1, "a rejected"), (2, "b rejected")], "line_at int, value string")
    assert {r.key: r.detected for r in structured.kws_from_ctc(labels, scores, "heyyou").collect()} == {"a": False, "b": False}


def test_polyphase_keeps_a_tone(spark):
    t = np.arange(1600) / 16000
    x = np.sin(2 * np.pi * 440 * t)
    y = signal.polyphase(x, 1, 2)
    assert len(y) == 800 and np.abs(y[50:-50] - np.sin(2 * np.pi * 440 * np.arange(800) / 8000)[50:-50]).max() < 1e-2
    z = signal.polyphase(x, 3, 2)
    assert len(z) == 2400 and np.abs(z[60:-60] - np.sin(2 * np.pi * 440 * np.arange(2400) / 24000)[60:-60]).max() < 1e-2
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    assert np.allclose(df.select(signal.resample_polyphase(F.col("x"), F.lit(16000), F.lit(8000))).first()[0], y)


def test_a_missing_translation_lowers_bleu(spark):
    from tarnsight.plans import pipelines

    ref = keyed(spark, [(str(i), "one two three four five six") for i in range(4)])
    whole, part = (pipelines.s2tt(ref, h).first() for h in (ref, ref.where("line_at < 3")))
    assert whole.score > 99.9 and part.score < 80 and part.hyp_length == 18


def test_intelligibility_falls_with_noise(spark):
    from tarnsight.plans import pipelines

    rng = np.random.default_rng(0)
    t = np.arange(32_000) / 16_000
    clean = sum(np.sin(2 * np.pi * f * t) * (1 + np.sin(2 * np.pi * m * t)) for f, m in ((300, 3), (900, 4), (2200, 5)))
    scores = [signal.intelligibility(clean, clean + a * rng.normal(size=len(t)), 16_000) for a in (0, 0.3, 1, 3, 10)]
    assert scores[0] > 0.999 and all(a > b for a, b in zip(scores, scores[1:])) and signal.intelligibility(clean[:1000], clean[:1000], 16_000) == 1e-5
    assert abs(signal.intelligibility(clean, 7 * clean, 16_000) - 1) < 1e-6
    df = spark.createDataFrame([("a", clean.tolist(), clean.tolist(), 16_000)], "sample_id string, prediction array<double>, reference array<double>, rate int")
    assert pipelines.run("se", {"samples": df}, metric="stoi").first().score > 0.999


def test_providers(spark):
    import http.server
    import json
    import sys
    import threading

    from tarnsight.plans import providers

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(7)], "sample_id string, path string").coalesce(1)
    schema = "sample_id string, transcript string"
    script = "import sys, json\nfor x in sys.stdin: print(json.dumps({'transcript': json.loads(x)['path'] + '!'}))"
    want = {str(i): f"p{i}!" for i in range(7)}
    got = lambda p: {r.sample_id: r.transcript for r in p(df).collect()}
    assert got(providers.subprocess_provider([sys.executable, "-c", script], ["path"], schema, batch=3)) == want
    with pytest.raises(Exception, match="0 answers for 3"):
        got(providers.subprocess_provider([sys.executable, "-c", "pass"], ["path"], schema, batch=3))
    assert got(providers.function_provider(["path"], schema, each=lambda r: {"transcript": r["path"] + "!"})) == want
    assert got(providers.function_provider(["path"], schema, whole=lambda rows: [{"transcript": r["path"] + "!"} for r in rows])) == want

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["samples"]
            body = json.dumps({"results": [{"transcript": r["path"] + "!"} for r in rows]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert got(providers.server_provider(f"http://127.0.0.1:{server.server_port}/", ["path"], schema, batch=2)) == want
    server.shutdown()


def test_places_are_a_global_order(spark):
    df = spark.range(100, 0, -1, 5).withColumnRenamed("id", "k").withColumn("_part", F.lit(1))
    got = alignment.places(df, ["k"]).collect()
    assert sorted((r.k, r.place) for r in got) == [(i, i) for i in range(1, 101)] and set(got[0].asDict()) == {"k", "_part", "place"}
    assert sorted((r.k, r.after) for r in alignment.successors(df, ["k"], "k", "after").collect()) == [(i, i + 1) for i in range(1, 100)]
    assert alignment.places(df.limit(0), ["k"]).count() == 0


def test_a_huge_array_is_read_in_pieces(spark, tmp_path):
    import json

    audios = [{"aid": f"a{i}", "path": f"p {i} {{x}}", "segments": [{"sid": f"s{i}{j}", "begin_time": 1.0 * j, "end_time": 1.0 * j, "text": 't "x", {', "subsets": ["L"] if j else ["S", "L"]} for j in range(2)]} for i in range(40)]
    for name, indent in (("flat", None), ("pretty", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"set": "x", "audios": audios}, indent=indent))
        got = imports.nested_segments(spark, str(tmp_path / f"{name}.json"), "S").collect()
        assert sorted((r.key, r.path, r.target, r.duration_ms) for r in got) == sorted((f"s{i}0", f"p {i} {{x}}", 't "x", {', 10) for i in range(40))
    (tmp_path / "bad.json").write_text(json.dumps({"audios": [{"path": "p", "aid": "a"}, {"path": "p", "aid": "a"}]}))
    with pytest.raises(Exception, match="begin with aid"):
        imports.nested_segments(spark, str(tmp_path / "bad.json"), "S").collect()
