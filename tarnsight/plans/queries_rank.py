"""Histories, baselines, leaderboards, summaries and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..operators import alignment, diarization, metrics, ranking
from ..sources import keytext
from .catalog import query, table


@query("select lang, source, count(*) as n_docs, sum(n_chars)::bigint as n_chars from documents group by lang, source")
def lang_source_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as k from events) where k = 1")
def latest_event_per_user(spark, sf_dir):
    return ranking.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """with l as (select * from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id) as k from events) where k = 1)
    select event_type, user_id, value, row_number() over (partition by event_type order by value desc, event_id)::int as "rank" from l"""
)
def tool_ranking(spark, sf_dir):
    """Users by the value of their latest event of each type."""
    now = ranking.latest(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id")
    return ranking.ranked(now, "value", ["event_id"], ["event_type"]).select("event_type", "user_id", "value", "rank")


def _results(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    s = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("model"), F.col("c_mktsegment").alias("dataset")).agg(F.avg("c_acctbal").alias("score"))
    best = s.groupBy("dataset").agg(F.max("score").alias("baseline"))
    return s.join(best, "dataset").withColumn("rps", F.round(F.try_divide("score", "baseline"), 9))


_RES = """with s as (select n_name as model, c_mktsegment as dataset, avg(c_acctbal) as score from customer join nation on c_nationkey = n_nationkey group by 1, 2), r as (select *, round(score / max(score) over (partition by dataset), 9) as rps from s)"""


@query(
    _RES
    + """, f as (select *, row_number() over (partition by dataset order by rps desc, model) = 1 as best from r), g as (select model, avg(rps) as a, count(*) as num_datasets, count(*) filter (where best) as num_best from f group by model)
    select model, round(a, 6) as average_rps, num_datasets, num_best, row_number() over (order by a desc, model)::int as "rank" from g"""
)
def leaderboard_avg_rps(spark, sf_dir):
    return ranking.leaderboard(_results(spark, sf_dir)).withColumn("average_rps", F.round("average_rps", 6))


@query(_RES + " select dataset, model, row_number() over (partition by dataset order by rps desc, model)::int as \"rank\" from r")
def dataset_leaderboard(spark, sf_dir):
    return ranking.ranked(_results(spark, sf_dir), "rps", ["model"], ["dataset"]).select("dataset", "model", "rank")


@query(_RES + " select dataset, model, case when rps < 0.5 then 'low relative score' when score < 20 then 'low accuracy' end as anomaly from r")
def anomaly_flags(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("dataset", "model", ranking.anomaly(F.lit("accuracy"), F.col("score"), F.col("rps")).alias("anomaly"))


@query(
    """select s_suppkey, case when s_nationkey % 2 = 0 then round(s / 5000, 6) when s = 0 then null else round(5000 / s, 6) end as rps, case when s_nationkey % 2 <> 0 and s = 0 then 'infinite' else 'ok' end as status
    from (select s_suppkey, s_nationkey, greatest(round(s_acctbal, 0), 0) as s from supplier)"""
)
def rps_two_directions(spark, sf_dir):
    """Relative scores where more and where less is better; an infinite one is null with a status."""
    s = table(spark, sf_dir, "supplier").withColumn("s", F.greatest(F.round("s_acctbal", 0), F.lit(0.0)))
    r = s.withColumn("r", signal.relative_score(F.col("s"), F.lit(5000.0), F.col("s_nationkey") % 2 == 0, F.lit(False)))
    return r.select("s_suppkey", F.when(F.col("r") < float("inf"), F.round("r", 6)).alias("rps"), F.when(F.col("r") == float("inf"), "infinite").otherwise("ok").alias("status"))


@query(
    """with b as (select p_brand as dataset, max(p_retailprice) as score from part where p_size <= 10 group by 1), e as (select p_brand || '__' || p_type as dataset, max(p_retailprice) as score from part where p_size = 1 group by 1), a as (select * from b union all select * from e),
    s as (select p_partkey, p_brand || '__' || p_type as dataset from part)
    select p_partkey, s.dataset, round(coalesce(x.score, y.score), 6) as baseline_score from s left join a x on x.dataset = s.dataset left join a y on y.dataset = string_split(s.dataset, '__')[1]"""
)
def baseline_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    full = F.concat(F.col("p_brand"), F.lit("__"), F.col("p_type"))
    b = p.where("p_size <= 10").groupBy(F.col("p_brand").alias("dataset")).agg(F.max("p_retailprice").alias("score"))
    e = p.where("p_size = 1").groupBy(full.alias("dataset")).agg(F.max("p_retailprice").alias("score"))
    out = alignment.with_baseline(p.select("p_partkey", full.alias("dataset")), b.unionByName(e))
    return out.withColumn("baseline_score", F.round("baseline_score", 6))


@query("select p_brand, p_partkey, k::int as \"rank\" from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 3")
def topk_per_group(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"], ["p_brand"], k=3).select("p_brand", "p_partkey", "rank")


@query("select o_orderkey from orders order by o_orderkey limit 10")
def sample_first_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(10)


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('1|' || doc_id), doc_id) as k from documents) where k <= 5")
def random_sample_per_group(spark, sf_dir):
    """Five seeded random documents a language."""
    return ranking.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 5, 1, "doc_id")


@query(
    """select count(distinct d.doc_id) as expected, (select count(distinct doc_id) from labels) as provided, count(*) filter (where l.doc_id is null) as missing, (select count(*) from (select doc_id from labels group by doc_id having count(*) > 1)) as repeated, count(*) filter (where l.doc_id is null) = 0 as complete
    from documents d left join (select distinct doc_id from labels) l using (doc_id)"""
)
def validation_summary(spark, sf_dir):
    """Labels as predictions for documents."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    j = d.distinct().join(l, "doc_id", "left")
    a = j.agg(F.count("*").alias("expected"), F.count_if(F.col("n").isNull()).alias("missing"))
    b = l.agg(F.count("*").alias("provided"), F.count_if(F.col("n") > 1).alias("repeated"))
    return a.crossJoin(b).withColumn("complete", F.col("missing") == 0).select("expected", "provided", "missing", "repeated", "complete")


@query("select count(*) filter (where turn % 5 <> 0) as num_rows, count(*) filter (where turn % 5 <> 0 and trim(coalesce(text, '')) = '') as num_empty_text_rows, count(*) filter (where turn % 5 = 0) as num_malformed_rows from conversations")
def row_stats(spark, sf_dir):
    value = F.concat(F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.concat_ws("|", "conv_id", "turn")), F.lit("\t"), F.coalesce(F.regexp_replace("text", r"\s+", " "), F.lit("")))
    return keytext.statistics(keytext.parse(table(spark, sf_dir, "conversations").select(F.lit(0).alias("line_at"), value.alias("value"))))


@query("select l_returnflag as dataset, count(*) as num_segments, round(avg(l_discount), 6) as score from lineitem group by 1")
def segment_mean(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_discount").alias("score"))
    return metrics.segment_mean(l, by=["dataset"]).select("dataset", "num_segments", F.round("score", 6).alias("score"))


@query("select dataset, metric, score from (select p_brand as dataset, 'price' as metric, round(avg(p_retailprice), 6) as score from part group by 1 union all select p_brand, 'size', round(avg(p_size), 6) from part group by 1)")
def report_merge(spark, sf_dir):
    """Two payloads under one key, repeated keys refused."""
    p = table(spark, sf_dir, "part")
    one = lambda m, c: p.groupBy(F.col("p_brand").alias("dataset")).agg(F.round(F.avg(c), 6).alias("score")).withColumn("metric", F.lit(m))
    return ranking.merged(one("price", "p_retailprice"), one("size", "p_size")).select("dataset", "metric", "score")


@query("select p_brand as dataset, max(p_size) as score from part group by 1")
def report_override(spark, sf_dir):
    """Two payloads under one key, the later counts."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset"))
    return ranking.merged(p.agg(F.min("p_size").alias("score")), p.agg(F.max("p_size").alias("score")), keys=["dataset"], override=True)


@query(
    """with e as (select user_id, event_type, epoch_us(ts) / 1e6 as a, least(epoch_us(ts) / 1e6 + 7200, epoch_us(lead(ts) over (partition by user_id, event_type order by ts, event_id)) / 1e6) as b0, epoch_us(ts) / 1e6 + 7200 as b1 from events where event_type in ('click', 'view')),
    s as (select user_id, event_type, a, coalesce(b0, b1) as b from e), o as (select x.user_id, greatest(x.a, y.a) as a, least(x.b, y.b) as b from s x join s y on x.user_id = y.user_id and x.event_type = 'click' and y.event_type = 'view' and x.a < y.b and y.a < x.b)
    select user_id, round(sum(b - a), 3) as overlap from o group by user_id"""
)
def per_session_der_like(spark, sf_dir):
    """Time that two event types overlap, by user: an interval join in buckets of time."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    after = F.lead("a").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    s = e.withColumn("b", F.least(F.col("a") + 7200, F.coalesce(after, F.col("a") + 7200))).select("user_id", "event_type", "a", "b")
    x = s.where("event_type = 'click'").select("user_id", F.col("a").alias("start"), F.col("b").alias("end"))
    y = s.where("event_type = 'view'").select("user_id", F.col("a").alias("start"), F.col("b").alias("end"))
    o = diarization.overlaps(x, y, "user_id", 7200.0)
    return o.groupBy("user_id").agg(F.round(F.sum("overlap"), 3).alias("overlap"))


@query(
    """with e as (select user_id::varchar as session, list_position(['click', 'signup', 'view'], event_type) as k, epoch_us(ts) / 1e6 as a from events where event_type in ('click', 'view', 'signup')),
    r as (select session, k, a, a + 600 as b from e), h as (select session, k, a + 60 as a, b + 60 as b from r), m as (select distinct session, unnest([a, b]) as t from r),
    t as (select distinct session, x from (select session, unnest([t, t - 0.25, t + 0.25]) as x from m union all select session, unnest([a, b]) from h)),
    i as (select session, x as lo, lead(x) over (partition by session order by x) as hi from t),
    w as (select i.session, lo, hi, (lo + hi) / 2 as mid, hi - lo as width from i where hi is not null and not exists (select 1 from m where m.session = i.session and abs((i.lo + i.hi) / 2 - m.t) < 0.25)),
    x as (select w.session, w.mid, w.width, [bool_or(r.k = 1), bool_or(r.k = 2), bool_or(r.k = 3)] as r from w left join r on r.session = w.session and r.a <= w.mid and w.mid < r.b group by all),
    y as (select w.session, w.mid, [bool_or(h.k = 1), bool_or(h.k = 2), bool_or(h.k = 3)] as h from w left join h on h.session = w.session and h.a <= w.mid and w.mid < h.b group by all),
    z as (select session, width, list_transform(r, lambda v: coalesce(v, false)::int) as r, list_transform(h, lambda v: coalesce(v, false)::int) as h from x join y using (session, mid)),
    s as (select session, sum(list_sum(r) * width) as scored, sum(greatest(list_sum(r) - list_sum(h), 0) * width) as missed, sum(greatest(list_sum(h) - list_sum(r), 0) * width) as fa, sum(least(list_sum(r), list_sum(h)) * width) as shared_time,
      greatest(sum((r[1] * h[1] + r[2] * h[2] + r[3] * h[3]) * width), sum((r[1] * h[1] + r[2] * h[3] + r[3] * h[2]) * width), sum((r[1] * h[2] + r[2] * h[1] + r[3] * h[3]) * width), sum((r[1] * h[2] + r[2] * h[3] + r[3] * h[1]) * width), sum((r[1] * h[3] + r[2] * h[1] + r[3] * h[2]) * width), sum((r[1] * h[3] + r[2] * h[2] + r[3] * h[1]) * width)) as agreed from z group by session)
    select session, round(scored, 2) as scored, round(missed, 2) as missed, round(fa, 2) as false_alarm, abs(round(shared_time - agreed, 2)) as confusion, round((missed + fa + shared_time - agreed) / scored, 4) as der from s"""
)
def diarization_error(spark, sf_dir):
    """Diarisation error of users' event types as speakers, shifted by a minute."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'signup')")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ref = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("speaker"), start.alias("start"), (start + 600).alias("end"))
    hyp = ref.select("session", F.upper("speaker").alias("speaker"), (F.col("start") + 60).alias("start"), (F.col("end") + 60).alias("end"))
    d = diarization.der(ref, hyp, collar=0.25)
    return d.select("session", *[F.abs(F.round(c, 2)).alias(c) for c in ("scored", "missed", "false_alarm", "confusion")], F.round("der", 4).alias("der"))


@query()
def cp_error_rate(spark, sf_dir):
    """Concatenated minimum-permutation error rate of the turns, with the roles renamed."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    whole = F.array_join(F.split(F.trim("text"), r"\s+"), " ")
    ref = c.select(F.col("conv_id").cast("string").alias("session"), F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start"), whole.alias("words"))
    hyp = ref.withColumn("speaker", F.when(F.col("speaker") == "user", "s2").otherwise("s1")).withColumn("words", F.regexp_replace("words", "^[^ ]+ ", ""))
    return diarization.cpwer(ref, hyp)


@query(
    """with l(lang, metric, normal, scorer, canon) as (values ('zh', 'cer', 'wetext_norm_zh_itn_v1', 'wenet_cer_v1', 'token_cer_v1'), ('en', 'wer', 'whisper_norm_v1', 'wenet_wer_v1', 'token_mer_v1'), ('cs', 'mer', 'aispeech_norm_v1', 'wenet_mer_v1', 'token_mer_v1')),
    m(name) as (values ('wavlm_large_sim'), ('ecapa_tdnn_sim'), ('eres2net_sim'), ('dnsmos'), ('wv_mos'), ('utmos')), speech(task) as (values ('tts'), ('vc'), ('tse')),
    r(task, "language", metric, nodes, roles, selectors, is_default) as (
      select 'asr', lang, metric, normal || '.' || scorer, 'ref,hyp', '', true from l
      union all select 'asr', lang, metric, 'aispeech_norm_v1.' || scorer, 'ref,hyp', 'normalizer=aispeech', false from l where lang <> 'cs'
      union all select 'asr', lang, metric, 'canonical_itn_' || lang || '_v1.' || canon, 'ref,hyp', 'normalizer=canonical', false from l
      union all select 's2tt', lang, x.metric, x.node || '_v1', case when x.metric = 'xcomet_xl' then 'src,ref,hyp' else 'ref,hyp' end, '', true from l, (values ('bleu', 'sacrebleu'), ('bleu_char', 'sacrebleu'), ('chrf', 'sacrebleu'), ('xcomet_xl', 'xcomet_xl'), ('bleurt_20', 'bleurt_20')) as x(metric, node) where lang <> 'cs'
      union all values ('sd', 'any', 'der', 'meeteval_v1', 'ref_segments,hyp_segments', '', true), ('sa_asr', 'any', 'cpwer', 'stm_to_txt_v1.gstar_norm_v1.txt_to_stm_v1.meeteval_v1', 'ref_segments,hyp_segments', '', true)
      union all select task, lang, metric, case lang when 'zh' then 'paraformer_zh_v1.' else 'whisper_large_v3_v1.' end || normal || '.' || scorer, 'samples,transcripts', '', true from speech, l where lang <> 'cs'
      union all select task, 'any', name, name || '_v1', 'samples,provider', '', true from speech, m
      union all values ('vc', 'any', 'cer_two_pass', 'paraformer_zh_v1.paraformer_zh_v1.wenet_cer_v1', 'samples,transcripts', '', false), ('se', 'any', 'si_sdr', 'si_sdr_v1', 'signals', '', true), ('tse', 'any', 'si_sdr', 'si_sdr_v1', 'signals', '', true), ('tse', 'any', 'si_sdri', 'si_sdr_v1', 'signals', '', true)
      union all select 'se', 'any', x, x || '_v1', 'samples,provider', '', true from (select unnest(['stoi', 'pesq', 'dnsmos', 'wv_mos', 'utmos']) as x)
      union all select x, 'any', 'accuracy', 'classify_v1', 'ref,hyp', '', true from (select unnest(['classification', 'ser', 'gr']) as x)
      union all values ('slu', 'any', 'accuracy', 'prompt_norm_v1.classify_v1', 'ref,hyp,choices', '', true)
      union all select 'kws', 'any', y, x || '_v1.wekws_det_v1', 'samples', 'input_mode=' || x, x = 'json_pair' from (select unnest(['json_pair', 'wekws_score_ctc', 'wekws_frame_score']) as x), (select unnest(['accuracy', 'macro_recall']) as y))
    select *, task || '.' || "language" || '.' || metric || '.' || nodes as pipeline_id from r"""
)
def route_catalog(spark, sf_dir):
    """Every evaluation route with its identity."""
    from .routes import catalog

    c = catalog(spark)
    chosen = F.array_join(F.transform(F.map_entries("selectors"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return c.select("task", "language", "metric", F.array_join("nodes", ".").alias("nodes"), F.array_join("roles", ",").alias("roles"), chosen.alias("selectors"), "is_default", "pipeline_id")


@query(
    """select * from (values ('今年是二零二四年', '今年是2024年', '今年是2024年'), ('增长百分之十五', '增长15%', '增长15%'), ('4500亿元', '450000000000元', '450000000000元'), ('我们一起去三十二号', '我们一起去32号', '我们一起去32号'), ('我有Five apples', '我有five apples', '我有 5 apples')) as t("text", zh, mixed)"""
)
def canonical_itn_text(spark, sf_dir):
    """Spoken numbers and signs under the canonical chains."""
    from ..functions.spoken import chain

    rows = spark.createDataFrame([("今年是二零二四年",), ("增长百分之十五",), ("4500亿元",), ("我们一起去三十二号",), ("我有Five apples",)], "text string")
    return rows.select("text", chain("canonical")("text").alias("zh"), chain("canonical_mixed")("text").alias("mixed"))


@query(
    """select * from (values ('twenty twenty four', '2024', 'two thousand and twenty-four'), ('one hundred and five dollars', '$105', '$one hundred and five'), ('three point one four', '3.14', 'three.fourteen'), ('twenty first', '21st', 'twenty-onest'), ('double five six', '556', 'five hundred and fifty-six'), ('two and a half', '2.5', 'two.five')) as t("text", written, again)"""
)
def english_numbers(spark, sf_dir):
    """Spelled English numbers."""
    from ..functions.spoken import chain

    rows = spark.createDataFrame([("twenty twenty four",), ("one hundred and five dollars",), ("three point one four",), ("twenty first",), ("double five six",), ("two and a half",)], "text string")
    return rows.select("text", chain("english_numbers")("text").alias("written"), chain("verbalise_en")(chain("english_numbers")("text")).alias("again"))
