"""Readers, writers, joins, metrics, rankings, segments, routes, pipelines, streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tarnsight.operators import alignment, diarization, metrics, ranking
from tarnsight.plans import pipelines, routes
from tarnsight.sources import keytext, sinks, structured
from tarnsight.streaming import running


def kt(spark, *pairs):
    return spark.createDataFrame([((f"f{i:03}",), k, t) for i, (k, t) in enumerate(pairs)], "line_at struct<file:string>, key string, text string")


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body, encoding="utf-8")
    return str(p)


def test_dialects(spark, tmp_path):
    p = write(tmp_path, "a.txt", "u1\thello  world \nu2\t\n\nbad line\n\tno key\nu1\tagain\r\n")
    rows = keytext.parse(keytext.lines(spark, p))
    assert tuple(keytext.statistics(rows).first()) == (3, 1, 2)
    with pytest.raises(ValueError, match="not key"):
        keytext.checked(rows)
    get = lambda d: [(r.key, r.text) for r in keytext.read(spark, p, d).orderBy("line_at").collect()]
    assert get("counted") == [("u1", "hello  world"), ("u2", ""), ("u1", "again")]
    assert get("lenient") == [("u1", "hello  world "), ("u2", ""), ("", "no key"), ("u1", "again")]
    assert get("columns") == [("u1", "hello  world"), ("u1", "again")]
    assert get("whitespace")[3] == ("bad", "line") or ("bad", "line") in get("whitespace")
    assert ("bad", "line") in get("prediction")
    good = keytext.read(spark, p)
    assert {r.key: r.text for r in keytext.last_by_key(good).collect()} == {"u1": "again", "u2": ""}
    assert {r.key: r.text for r in keytext.joined_by_key(good).collect()}["u1"] == "hello  world again"
    with pytest.raises(ValueError, match="repeated"):
        keytext.checked(keytext.parse(keytext.lines(spark, write(tmp_path, "b.txt", "a\t1\na\t2\n")), "strict"))
    with pytest.raises(ValueError):
        keytext.parse(keytext.lines(spark, p), "nope")


def test_missing_and_repeated_keys(spark):
    ref, hyp = kt(spark, ("utt1", "a b c d e f"), ("utt2", "g h i j k l m"), ("utt1", "x")), kt(spark, ("utt1", "z"), ("utt1", "a b c d e f"), ("new", "q"))
    rows = metrics.scored(alignment.left_pairs(ref, hyp))
    r = metrics.error_rate(rows).first()
    assert (r.num_tokens, r["del"], r.sub, r.ins) == (14, 7, 1, 5)
    c = alignment.coverage(ref, hyp).first()
    assert (c.num_missing, c.num_extra, c.missing_keys, c.extra_keys) == (1, 1, ["utt2"], ["new"])
    assert alignment.inner_pairs(ref, hyp).count() == 2
    with pytest.raises(ValueError, match="differ"):
        alignment.require_same_keys(ref, hyp)
    alignment.require_same_keys(ref, ref)


@pytest.mark.parametrize("parts", [1, 5])
def test_long_and_short_rows_add_up(spark, parts):
    rows = [("long", " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300)))] + [(f"s{i}", "a b c d", "a b c x") for i in range(50)]
    r = metrics.error_rate(metrics.scored(spark.createDataFrame(rows, "key string, ref string, hyp string").repartition(parts))).first()
    assert (r.num_tokens, r.sub, r["del"], r.ins) == (500, 50, 0, 0) and r.sentence_error_rate == 50 / 51


def test_asr_routes(spark):
    ref = kt(spark, ("a", "twenty twenty four was good"), ("b", "it is fine"))
    hyp = kt(spark, ("a", "2024 was good"), ("b", "it's fine"))
    r = pipelines.run("asr", {"ref": ref, "hyp": hyp}, "en", "wer").first()
    assert r.score == 0 and r.pipeline_id == "asr.en.wer.whisper_norm_v1.wenet_wer_v1"
    assert pipelines.asr(ref, hyp, "en", normalizer="canonical").first().score == 0
    zh = pipelines.asr(kt(spark, ("a", "今年是二零二四年")), kt(spark, ("a", "今年是2024年")), "zh", "wer").first()
    assert zh.metric == "cer" and zh.score == 0
    assert pipelines.asr(kt(spark, ("a", "你好 world")), kt(spark, ("a", "")), "cs").first().score == 1.0
    with pytest.raises(Exception, match="no token"):
        pipelines.asr(kt(spark, ("a", "")), kt(spark, ("a", "x")), "en").collect()
    with pytest.raises(ValueError, match="hyp"):
        pipelines.run("asr", {"ref": ref}, "en")


def test_labels_and_choices(spark):
    ref, hyp = kt(spark, ("1", "hap"), ("2", "woman"), ("3", "ang")), kt(spark, ("1", "Happy"), ("2", "female"), ("3", "2"))
    assert abs(pipelines.classification(ref, hyp, "SER").first().score - 2 / 3) < 1e-9
    assert pipelines.classification(kt(spark, ("1", "hap"), ("2", "sad")), kt(spark, ("1", "happy")), "SER").first().score == 0.5
    lines = ['{"key":"q1","choices":{"A":"turn on","B":"turn off"}}', '{"key":"q2","prompt":"Pick:\\nA. cat\\nB) dog"}', '{"key":"q3","options":[{"id":"x","text":"one","aliases":["uno"]},"two"]}']
    ch = spark.createDataFrame([(x,) for x in lines], "value string").select(F.get_json_object("value", "$.key").alias("key"), structured.choices_of(F.col("value")).alias("choices"))
    got = {r.key: [(c.id, c.text) for c in r.choices] for r in ch.collect()}
    assert got == {"q1": [("A", "turn on"), ("B", "turn off")], "q2": [("A", "cat"), ("B", "dog")], "q3": [("x", "one"), ("2", "two")]}
    ref, hyp = kt(spark, ("q1", "A"), ("q2", "dog"), ("q3", "uno")), kt(spark, ("q1", "Answer: turn on"), ("q2", "A"), ("q3", "x"))
    assert abs(pipelines.slu(ref, hyp, ch).first().score - 2 / 3) < 1e-9


def test_keyword_spotting(spark):
    rows = [("p1", True, None, True, None, 0.85, None, 0.0), ("p2", True, None, True, None, 0.6, None, 0.0), ("n1", False, None, True, None, 0.75, None, 1800.0), ("n2", False, None, True, None, 0.2, None, 1800.0)]
    s = spark.createDataFrame(rows, structured.KWS)
    points = metrics.det_curve(s, thresholds=[0.5, 0.75, 0.85])
    assert [(r.threshold, r.false_rejects, r.false_alarms) for r in points.orderBy("threshold").collect()] == [(0.5, 0, 1), (0.75, 1, 1), (0.85, 1, 0)]
    assert metrics.best_recall(points, 0).first().score == 0.5 and metrics.best_recall(points, 1).first().score == 1.0
    r = metrics.kws_report(s).first()
    assert (r.accuracy, r.recall, r.false_alarm_per_hour) == (0.75, 1.0, 1.0)
    with pytest.raises(ValueError):
        metrics.best_recall(points, -1)
    labels = kt(spark, ("a", "hey you"), ("b", "no"))
    ctc = spark.createDataFrame([("a detected HEY 0.93",), ("b rejected",)], "value string")
    got = {r.key: (r.expected_detected, r.detected, r.score) for r in structured.kws_from_ctc(labels, ctc, "hey").collect()}
    assert got == {"a": (True, True, 0.93), "b": (False, False, None)}
    with pytest.raises(Exception, match="no score"):
        structured.kws_from_ctc(labels, ctc.limit(1), "hey").collect()
    frames = spark.createDataFrame([("a hey 0.1 0.8",), ("b hey 0.2",), ("b other 0.9",)], "value string")
    assert {r.key: r.detected for r in structured.kws_from_frames(labels, frames, "hey").collect()} == {"a": True, "b": False}
    ref = spark.createDataFrame([('{"key":"a","expected":true}',), ('{"key":"b","text":""}',)], "value string")
    out = spark.createDataFrame([('{"key":"a","result":{"detected":true,"score":0.9}}',), ('{"key":"b","detected":false}',)], "value string")
    assert pipelines.kws(structured.kws_from_json(ref, out)).first().score == 1.0
    with pytest.raises(Exception, match="no reference"):
        structured.kws_from_json(ref.limit(1), out).collect()


def test_translation(spark):
    ref = kt(spark, ("1", "the cat sat on the mat today ."), ("2", "a b c d e"))
    assert abs(pipelines.s2tt(ref, ref).first().score - 100) < 1e-9 and abs(pipelines.s2tt(ref, ref, metric="chrf").first().score - 100) < 1e-9
    worse = kt(spark, ("1", "the cat sat on a mat today ."), ("2", "a b c d e"))
    b = pipelines.s2tt(ref, worse).first().score
    # 7+5 of 13, 5+4 of 11, 3+3 of 9, 1+2 of 7 n-grams match
    assert abs(b - 100 * (12 / 13 * 9 / 11 * 6 / 9 * 3 / 7) ** 0.25) < 1e-6
    given = spark.createDataFrame([("1", 0.9), ("2", 0.7)], "key string, score double")
    assert abs(pipelines.s2tt(ref, worse, metric="bleurt_20", provider=given).first().score - 0.8) < 1e-9
    with pytest.raises(Exception, match="provider"):
        pipelines.s2tt(ref, worse, metric="bleurt_20", provider=given.limit(1)).collect()


def test_segments(spark, tmp_path):
    seg = "session string, speaker string, start double, end double"
    ref = spark.createDataFrame([("s", "A", 0.0, 10.0), ("s", "B", 10.0, 20.0)], seg)
    hyp = spark.createDataFrame([("s", "x", 0.0, 12.0), ("s", "y", 12.0, 20.0)], seg)
    assert abs(diarization.der(ref, hyp, 0.0).first().der - 0.1) < 1e-9
    assert diarization.der(ref, ref.withColumn("speaker", F.lower("speaker"))).first().der == 0
    assert abs(diarization.der(ref, hyp.where("speaker = 'x'"), 0.0).first().der - 0.5) < 1e-9
    words = spark.createDataFrame([("s", "A", 0.0, 1.0, "a b c"), ("s", "B", 1.0, 2.0, "d e"), ("s", "A", 2.0, 3.0, "f")], seg + ", words string")
    other = words.withColumn("speaker", F.when(F.col("speaker") == "A", "2").otherwise("1"))
    r = diarization.combined(diarization.cpwer(words, other.withColumn("words", F.when(F.col("words") == "f", "g").otherwise(F.col("words"))))).first()
    assert (r.errors, r.length) == (1, 6)
    stm = write(tmp_path, "a.stm", "s1 1 spk 0.00 1.50 hello there\ns1 1 spk 2.00 3.00\njunk\n")
    rows = structured.parse_segments(keytext.lines(spark, stm), "stm")
    assert [(x.start, x.end, x.words) for x in rows.orderBy("line_at").collect()] == [(0.0, 1.5, "hello there"), (2.0, 3.0, "")]
    sinks.stm(rows, str(tmp_path / "out"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "out")).collect()) == ["s1 1 spk 0.00 1.50 hello there", "s1 1 spk 2.00 3.00"]
    rttm = write(tmp_path, "a.rttm", "SPEAKER s 1 0.5 2.0 <NA> <NA> A <NA> <NA>\n")
    assert structured.parse_segments(keytext.lines(spark, rttm), "rttm").first().end == 2.5
    o = diarization.overlaps(spark.createDataFrame([("k", 0.0, 5.0), ("k", 7.0, 30.0)], "k string, start double, end double"), spark.createDataFrame([("k", 4.0, 9.0)], "k string, start double, end double"), "k", 3.0)
    assert sorted(r.overlap for r in o.collect()) == [1.0, 2.0]


def test_history(spark):
    rec = spark.createDataFrame([("tool_a", "d", 0.2, "2024-01-01", 1), ("tool_a", "d", 0.4, "2024-01-02", 2), ("tool_b", "d", 0.7, "2024-01-01", 3), ("tool_b", "d", 0.1, "2024-01-01", 4)], "tool string, dataset string, rps double, timestamp string, seq int")
    now = ranking.latest(rec, ["tool"], "timestamp", "seq")
    got = [(r.tool, r.rps) for r in ranking.ranked(now, "rps", ["seq"]).orderBy("rank").collect()]
    assert got == [("tool_b", 0.7), ("tool_a", 0.4)]
    scores = spark.createDataFrame([("aishell__x", 1.0), ("other", 2.0)], "dataset string, score double")
    base = structured.baselines(spark, [{"dataset": "aishell", "metric": "cer", "score": 80}, {"dataset": "bad"}])
    assert {r.dataset: r.baseline_score for r in alignment.with_baseline(scores, base).collect()} == {"aishell__x": 80.0, "other": None}
    p = spark.createDataFrame([("d", "m", 1.0)], "dataset string, metric string, score double")
    with pytest.raises(Exception, match="repeated"):
        ranking.merged(p, p).collect()
    assert ranking.merged(p, p.withColumn("score", F.lit(2.0)), override=True).first().score == 2.0
    res = spark.createDataFrame([("m1", "a", 0.5), ("m2", "a", 0.9), ("m1", "b", 0.8)], "model string, dataset string, rps double")
    assert [(r.model, r.num_best) for r in ranking.leaderboard(res).orderBy("rank").collect()] == [("m2", 1), ("m1", 1)]
    assert [r.status for r in ranking.compared(res, ["m1", "m3"], "a").orderBy("model").collect()] == ["ok", "no result"]


def test_stores(spark, tmp_path):
    at = str(tmp_path / "store")
    assert structured.read_records(spark, at).count() == 0
    rec = spark.createDataFrame([("t", None, "d", "cer", 1.0, 0.5, "2024", None)], structured.RECORD)
    sinks.append_records(rec, at)
    sinks.append_records(rec, at)
    assert structured.read_records(spark, at).count() == 2
    up = sinks.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3)], "k string, v int"), ["k"])
    assert {r.k: r.v for r in up.collect()} == {"a": 1, "b": 3}
    sinks.run_artifacts(spark.range(1).select(F.lit(float("inf")).alias("score")), {"id": "x"}, str(tmp_path / "run"))
    assert json.loads((tmp_path / "run/report.json").read_text()) == {"score": None}
    rep = write(tmp_path, "r.json", json.dumps({"models": {"m": {"track_i": {"d": {"metric": "cer", "score": 1.0, "rps": 0.5}}, "track_ii": {"d": {"metric": "acc", "score": 2.0, "rps": 0.7, "task": "SER"}}}}}))
    assert [(r.task, r.score) for r in structured.read_reports(spark, rep).collect()] == [("SER", 2.0)]
    assert "| a |" in sinks.markdown(spark.createDataFrame([("x", 1.0)], "a string, b double")).splitlines()[0]


def test_audio(spark, tmp_path):
    def wav(bits, values, channels=1):
        size = bits // 8
        data = b"".join(v.to_bytes(size, "little", signed=bits > 8) for v in values)
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 8000, 8000 * size * channels, size * channels, bits) + b"data" + struct.pack("<I", len(data)) + data

    for bits, values, want in ((16, [0, 16384, -32768], [0, 0.5, -1]), (8, [128, 192, 0], [0, 0.5, -1]), (24, [0, 1 << 22, -(1 << 23)], [0, 0.5, -1]), (32, [0, 1 << 30, -(1 << 31)], [0, 0.5, -1])):
        rate, x = structured.decode_wav(wav(bits, values))
        assert rate == 8000 and x.tolist() == want
    assert structured.decode_wav(wav(16, [0, 16384], 2))[1].tolist() == [0.25]
    assert structured.decode_wav(b"nonsense") is None
    (tmp_path / "a.wav").write_bytes(wav(16, [0, 16384]))
    assert structured.read_wav(spark, str(tmp_path)).first().samples == [0.0, 0.5]
    jl = write(tmp_path, "s.jsonl", '{"sample_id":"1","prediction_audio":"a.wav","language":"en"}\n')
    assert structured.read_samples(spark, jl, "tts").first().prediction_audio == f"{tmp_path}/a.wav"
    with pytest.raises(ValueError, match="reference_text"):
        structured.read_samples(spark, jl, "tts", ["wer"])
    s = spark.createDataFrame([("1", "hi there", [1.0, -1.0, 2.0], [1.0, -1.0, 2.0])], "sample_id string, reference_text string, prediction array<double>, reference array<double>")
    given = {"transcripts": spark.createDataFrame([("1", "hi their")], "sample_id string, transcript string"), "dnsmos": spark.createDataFrame([("1", 3.5)], "sample_id string, score double")}
    got = [(r.metric, r.score) for r in pipelines.audio(s, "tts", ["tts_wer", "dnsmos"], "en", given).collect()]
    assert sorted(got) == [("dnsmos", 3.5), ("wer", 0.5)]
    assert pipelines.audio(s, "se", ["si-sdr"]).first().score == 100.0 and pipelines.audio(s, "tse", ["si_sdr"]).first().score == float("inf")


def test_routes(spark):
    d = routes.describe("tts", "zh", ("tts_cer", "sim/wavlm-large", "dnsmos"))
    assert d["pipeline_id"] == "tts.zh.multi.cer.paraformer_zh_v1.wetext_norm_zh_itn_v1.wenet_cer_v1__wavlm_large_sim.wavlm_large_sim_v1__dnsmos.dnsmos_v1"
    assert routes.find("asr", "cs", "mer").chain == ("aispeech_norm_v1", "wenet_mer_v1")
    assert routes.find("asr", pipeline_id="asr.zh.cer.canonical_itn_zh_v1.token_cer_v1").language == "zh"
    for mode in ("json_pair", "wekws_score_ctc", "wekws_frame_score"):
        assert routes.find("kws", None, "macro-recall", input_mode=mode).chain[0] == mode + "_v1"
    with pytest.raises(LookupError):
        routes.find("asr", "en", "nothing")
    ids = [r.pipeline_id for r in routes.catalog(spark).collect()]
    assert len(ids) == len(set(ids)) >= 55


def test_running_rate_over_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:01", 1, 4), ("2024-01-01 00:00:59", 1, 4), ("2024-01-01 00:02:00", 3, 4)], "t string, dist int, n int").selectExpr("cast(t as timestamp) t", "dist", "n").write.parquet(path)
    stream = spark.readStream.schema("t timestamp, dist int, n int").parquet(path)
    q = running.running_error_rate(stream, "t", "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.score for r in spark.table("rates").collect()) == [0.25, 0.75]


def test_sessions_pass_in_batches_however_many(spark):
    """No call of Python a session, and the same errors where a session comes in several Arrow batches."""
    from tarnsight.operators import diarization

    made = [(f"s{i % 7}", "ab"[k % 2], float(3 * k), 3.0 * k + 2, f"w{k} v{i}") for i in range(7) for k in range(i + 1)]
    ref = spark.createDataFrame(made + [("alone", "a", 0.0, 2.0, "one two")], "session string, speaker string, start double, end double, words string")
    hyp = spark.createDataFrame([(s, {"a": "y", "b": "x"}[w], a + 0.5, b + 0.5, t + " z") for s, w, a, b, t in made] + [("extra", "a", 0.0, 1.0, "x")], ref.schema)
    bound = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        d, c = diarization.der(ref, hyp, 0.0), diarization.cpwer(ref, hyp)
        assert not any("CoGroup" in x._jdf.queryExecution().executedPlan().toString() for x in (d, c))
        got = {r.session: (r.scored, r.missed, r.false_alarm, r.confusion) for r in d.collect()}
        words = {r.session: (r.errors, r.length) for r in c.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", bound)
    assert got == {f"s{i}": (2.0 * (i + 1), 0.5 * (i + 1), 0.5 * (i + 1), 0.0) for i in range(7)} | {"alone": (2.0, 2.0, 0.0, 0.0)}
    assert words == {f"s{i}": (i + 1, 2 * (i + 1)) for i in range(7)} | {"alone": (2, 2)}
