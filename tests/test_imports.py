import json

import pytest
from pyspark.sql import functions as F

from tarnsight.operators import predicates
from tarnsight.sources import imports


def test_nested_and_kaldi(spark, tmp_path):
    seg = lambda i, b, e, s: {"sid": i, "begin_time": b, "end_time": e, "text": "t", "subsets": s}
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"audios": [{"aid": "a", "path": "p", "segments": [seg("1", 0.0, 1.5, ["NET"]), seg("2", 2.0, 2.0, ["NET", "X"]), seg("3", 0.0, 1.0, ["X"])]}]}))
    got = {r.key: r.duration_ms for r in imports.nested_segments(spark, str(p), "NET").collect()}
    assert got == {"1": 1500, "2": 10}
    (tmp_path / "text").write_text("u1 hello there\nu2 x\nu1 again\n")
    (tmp_path / "wav").write_text("u1 /a/u1.wav\n")
    assert [tuple(r) for r in imports.kaldi(spark, str(tmp_path / "text"), str(tmp_path / "wav")).collect()] == [("u1", "again", "/a/u1.wav")]


def test_candidates_and_lookup(spark, tmp_path):
    p = tmp_path / "c.json"
    for body in ('[{"id":"1","name":"Big ASR","task":"asr"}]', '{"items":[{"id":"1","name":"Big ASR","task":"asr"}]}'):
        p.write_text(body)
        c = imports.candidates(spark, str(p))
        assert c.where(predicates.names("Asr", "task", "id", "name")).count() == 1 and c.where(predicates.names("tts", "task", "name")).count() == 0
    s = spark.createDataFrame([("k", "a.wav"), ("l", "b.wav")], "key string, path string")
    f = spark.createDataFrame([("file:/y/a.wav",), ("file:/x/a.wav",)], "path string")
    assert {r.key: r.audio for r in imports.found_audio(s, f, ["/x", "/y"]).collect()} == {"k": "/x/a.wav", "l": None}
    pq = str(tmp_path / "pq")
    spark.createDataFrame([("漢字",), ("abc",)], "text string").write.parquet(pq)
    assert sorted(r.dataset for r in imports.parquet_split(spark, pq, "cv").collect()) == ["cv_en", "cv_zh"]
    assert spark.createDataFrame([(bytearray(b"abcdef"),)], "c binary").select(imports.ark_slice(F.col("c"), F.lit(2), F.lit(3))).first()[0] == b"cde"


def test_predicates(spark):
    m = spark.createDataFrame([("m", ["asr", "tts"]), ("n", ["vc"])], "model string, supported_tasks array<string>")
    assert [r.model for r in predicates.with_task(m, "tts").collect()] == ["m"]
    p = spark.createDataFrame([("b", '{"text":"x"}'), ("c", "{}"), ("a", '{"text":""}')], "key string, value string")
    assert predicates.contract_violations(p, "asr").first()["keys"] == ["a", "c"]
    v = spark.createDataFrame([({"dnsmos": "3.5", "elapsed": "1", "sig": "4"},)], "v map<string,string>")
    r = v.select(predicates.provider_row(F.col("v"), "dnsmos").alias("x")).first()["x"]
    assert r["score"] == 3.5 and r["rest"] == {"sig": "4"}
    with pytest.raises(Exception, match="no utmos score"):
        spark.createDataFrame([({"a": "b"},)], "v map<string,string>").select(predicates.provider_row(F.col("v"), "utmos")).collect()
    x = spark.createDataFrame([("/a/f", bytearray(b"1")), ("/a/g", bytearray(b"2"))], "path string, content binary")
    y = spark.createDataFrame([("/b/f", bytearray(b"1")), ("/b/g", bytearray(b"3"))], "path string, content binary")
    assert {r.name: r.same for r in predicates.same_content(x, y).collect()} == {"f": True, "g": False}
    s = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], 2)], "s array<double>, r int").select(predicates.fixed_segments(F.col("s"), F.col("r"), 1.0)).first()[0]
    assert s == [[1.0, 2.0], [3.0, 4.0], [5.0]]
    e = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "k string, embedding array<double>")
    assert predicates.mean_vector(e, ["k"]).first()["mean"] == [2.0, 4.0]


def test_an_objects_end_is_found_without_its_values():
    """Memory is a few times less than the values of the object would take."""
    import json
    import tracemalloc

    from tarnsight.sources.imports import object_end

    one = {"aid": "x", "s": [{"k": i, "t": 'a "quoted" } ] \\ text', "n": [[], {}]} for i in range(20000)]}
    text = json.dumps(one)[len('{"aid"') :]
    for after in (", {", "]}", "\n]"):
        assert object_end(text + after) == len(text)
    whole = text + ", {"
    tracemalloc.start()
    object_end(whole)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(text) / 10
    with pytest.raises(ValueError, match="doesn't end"):
        object_end(text[:-1])
