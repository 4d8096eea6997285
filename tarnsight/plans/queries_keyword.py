"""Keyword spotting and labels over events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics
from ..sources import structured
from .catalog import query, table


def samples(spark, sf_dir):
    """Events as samples: a purchase should be detected, a positive value is, its score is a hundredth of it, its length the time to the user's next event."""
    e = table(spark, sf_dir, "events")
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").alias("key"), "user_id", (F.col("event_type") == "purchase").alias("expected_detected"), F.lit(None).cast("string").alias("expected_keyword"), (F.col("value") > 0).alias("detected"),
        F.lit(None).cast("string").alias("predicted_keyword"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), F.lit(None).cast("array<double>").alias("scores"),
        (F.unix_micros(after.cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("duration"),
    )


_S = """with s as (select event_id as key, user_id, event_type = 'purchase' as pos, value > 0 as det, least(value / 100, 1.0) as score,
  epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 as dur from events)"""


@query(
    _S
    + """, r as (select *, det and score >= 0.5 as hit from s), c as (select count(*) as total, count(*) filter (where pos) as p, count(*) filter (where not pos) as n, count(*) filter (where pos and hit) as tp, count(*) filter (where pos and not hit) as fr, count(*) filter (where not pos and hit) as fa, coalesce(sum(dur) filter (where not pos), 0) / 3600 as hours from r)
    select total, p as positives, n as negatives, tp as true_positives, fr as false_rejects, fa as false_alarms, round((tp + n - fa)::double / total, 6) as accuracy, round(tp::double / (tp + fa), 6) as "precision", round(tp::double / p, 6) as recall, round(2.0 * tp / (2 * tp + fa + fr), 6) as f1, round(fr::double / p, 6) as false_reject_rate, round(fa::double / n, 6) as false_alarm_rate, round(fa / hours, 6) as false_alarm_per_hour from c"""
)
def kws_confusion(spark, sf_dir):
    r = metrics.kws_report(samples(spark, sf_dir))
    keep = ("total", "positives", "negatives", "true_positives", "false_rejects", "false_alarms")
    return r.select(*keep, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "false_reject_rate", "false_alarm_rate", "false_alarm_per_hour")])


_CURVE = (
    _S
    + """, g as (select round(i * 0.01, 6)::double as threshold from range(101) t(i)),
  c as (select threshold, count(*) filter (where pos) as p, count(*) filter (where not pos) as n, count(*) filter (where pos and not (det and score >= threshold)) as fr, count(*) filter (where not pos and det and score >= threshold) as fa, coalesce(sum(dur) filter (where not pos), 0) / 3600 as hours from s, g group by threshold),
  curve as (select threshold, fa / hours as false_alarm_per_hour, fr::double / p as false_reject_rate, fa::double / n as false_alarm_rate, (p - fr)::double / p as true_detect_rate, fa as false_alarms, fr as false_rejects from c)"""
)


@query(_CURVE + " select threshold, round(false_alarm_per_hour, 6) as false_alarm_per_hour, round(false_reject_rate, 6) as false_reject_rate, round(false_alarm_rate, 6) as false_alarm_rate, round(true_detect_rate, 6) as true_detect_rate, false_alarms, false_rejects from curve")
def kws_det_curve(spark, sf_dir):
    c = metrics.det_curve(samples(spark, sf_dir))
    return c.select("threshold", *[F.round(x, 6).alias(x) for x in ("false_alarm_per_hour", "false_reject_rate", "false_alarm_rate", "true_detect_rate")], "false_alarms", "false_rejects")


@query(
    _CURVE
    + """, b as (select unnest([0, 10, 100]) as budget), k as (select budget, threshold, true_detect_rate, false_alarms, row_number() over (partition by budget order by true_detect_rate desc, false_alarms, false_alarm_per_hour, abs(threshold - 0.5), threshold) as r from b left join curve on false_alarms <= budget)
    select budget::int as false_alarm_budget, round(coalesce(true_detect_rate, 0), 6) as score, threshold, false_alarms as achieved_false_alarms, threshold is not null as feasible from k where r = 1"""
)
def kws_macro_recall_fa_budget(spark, sf_dir):
    points = metrics.det_curve(samples(spark, sf_dir))
    out = None
    for budget in (0, 10, 100):
        one = metrics.best_recall(points, budget)
        out = one if out is None else out.unionByName(one)
    return out.select("false_alarm_budget", F.round("score", 6).alias("score"), "threshold", "achieved_false_alarms", "feasible")


@query(_CURVE + " select threshold, round(false_reject_rate, 6) as false_reject_rate, round(false_alarm_rate, 6) as false_alarm_rate from curve order by curve.false_reject_rate + curve.false_alarm_rate, curve.false_alarm_per_hour, abs(threshold - 0.5), threshold limit 1")
def kws_min_frr_far(spark, sf_dir):
    return metrics.least_error(metrics.det_curve(samples(spark, sf_dir))).select("threshold", F.round("false_reject_rate", 6).alias("false_reject_rate"), F.round("false_alarm_rate", 6).alias("false_alarm_rate"))


@query(_S + " select user_id, round(sum(coalesce(dur, 0)) / 3600, 6) as hours from s where not pos group by user_id")
def kws_filler_hours(spark, sf_dir):
    r = metrics.kws_report(samples(spark, sf_dir), by=["user_id"]).where("negatives > 0")
    return r.select("user_id", F.round("filler_hours", 6).alias("hours"))


@query(_S + " select round(avg(score), 6) as mean_score, count(score) as num_scored from s")
def kws_mean_score(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("x", metrics.detection_score())
    return s.agg(F.round(F.avg("x"), 6).alias("mean_score"), F.count("x").alias("num_scored"))


@query(_S + " select case when pos then 'false_reject' else 'false_alarm' end as error_type, count(*) as n from s where (pos and not (det and score >= 0.5)) or (not pos and det and score >= 0.5) group by 1")
def kws_error_types(spark, sf_dir):
    s = samples(spark, sf_dir).select(metrics.error_type(F.lit(0.5)).alias("error_type")).where("error_type is not null")
    return s.groupBy("error_type").agg(F.count("*").alias("n"))


_SPEC = {"id": "events", "unknown_policy": "invalid", "labels": [{"id": "good", "aliases": ["purchase", "signup"]}, {"id": "bad", "aliases": ["error"]}]}


@query("select label, count(*) as n from (select case when event_type in ('purchase', 'signup') then 'good' when event_type = 'error' then 'bad' end as label from events) group by label")
def label_alias_accuracy(spark, sf_dir):
    """Labels through an alias table; unknown ones are null."""
    spec = structured.label_spec(_SPEC)
    return table(spark, sf_dir, "events").select(structured.label_of(F.col("event_type"), spec).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
