"""Queries over the event log: a job is a user, a kind an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import ids
from evigraph.operators import analytics
from evigraph.sources import read_table
from evigraph.streaming import events as E


def log(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "value", "props")


LOG = "(SELECT event_id, ts, user_id AS job, event_type AS kind, value, props FROM events)"


def job_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_status(log(spark, d)).select("job", "status", "n_events")


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """History of each job up to its first purchase."""
    return E.replay(log(spark, d), ("purchase",)).select("job", "event_id", "kind")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Charges by an estimate from each event's text, with a limit per job."""
    return E.budget(log(spark, d), ids.token_estimate(F.concat("kind", "props")), 200)


def ttl_events(spark: SparkSession, d: str) -> DataFrame:
    return E.live(log(spark, d), F.to_timestamp(F.lit("2024-01-30 12:00:00")), 86_400).groupBy("job").agg(F.count(F.lit(1)).alias("n"))


def queue_admission(spark: SparkSession, d: str) -> DataFrame:
    """Signups as job starts and purchases or errors as ends, at most three open."""
    return E.admission(log(spark, d), "signup", ("purchase", "error"), 3)


def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """Event types as stages of a job's trials, values as milliseconds."""
    t = log(spark, d).select(F.col("job").alias("paper"), F.col("kind").alias("stage"), F.col("value").alias("ms"))
    return analytics.stage_summary(t, 120.0)


def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    t = log(spark, d).select(F.col("job").alias("paper"), F.when(F.col("kind") == "error", "failed").otherwise("complete").alias("status"), F.col("value").alias("ms"))
    return analytics.suite(t, 250.0)


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    w = E.windows(log(spark, d))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n", F.round("total", 2).alias("total"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = E.sessions(log(spark, d), "12 hours")
    return s.select("job", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(ids.score_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (job_latest_status, event_replay, token_budget, ttl_events, queue_admission, stage_timings, suite_summary, hourly_windows, session_windows, score_buckets)}


def oracle_sql() -> dict:
    run = "OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    return {
        "job_latest_status": f"SELECT job, arg_max(kind, (ts, event_id)) AS status, count(*) AS n_events FROM {LOG} GROUP BY 1",
        "event_replay": f"SELECT job, event_id, kind FROM (SELECT *, coalesce(sum((kind = 'purchase')::INT) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {LOG}) WHERE before = 0",
        "token_budget": f"SELECT job, coalesce(sum(c) FILTER (used <= 200), 0)::BIGINT AS spent, count(*) FILTER (used > 200) AS refused FROM (SELECT job, c, sum(c) {run} AS used FROM (SELECT *, greatest(1, (length(kind || props) + 2) // 3) AS c FROM {LOG})) GROUP BY 1",
        "ttl_events": f"SELECT job, count(*) AS n FROM {LOG} GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-30 12:00:00' AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts)) < 86400000000",
        "queue_admission": f"SELECT job, event_id, greatest(open - 1, 0)::BIGINT AS open_before, open - 1 < 3 AS admitted FROM (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 WHEN kind IN ('purchase', 'error') THEN -1 ELSE 0 END) {run} AS open FROM {LOG}) WHERE kind = 'signup'",
        "stage_timings": f"SELECT job AS paper, kind AS stage, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(CASE WHEN count(*) > 1 AND avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS cv, bool_and(value <= 120) AS all_within FROM {LOG} GROUP BY ALL",
        "suite_summary": f"SELECT count(*) AS n_papers, sum(n)::BIGINT AS n_trials, sum(f)::BIGINT AS n_failed, count(*) FILTER (ok) AS n_within, count(*) FILTER (k = 1) AS n_stable, round(avg(ok::INT::DOUBLE), 6) AS rate_within FROM (SELECT job, bool_and(value <= 250) AS ok, count(*) AS n, count(*) FILTER (kind = 'error') AS f, count(DISTINCT kind = 'error') AS k FROM {LOG} GROUP BY 1)",
        "hourly_windows": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, kind, count(*) AS n, round(sum(value), 2) AS total FROM {LOG} GROUP BY ALL",
        "session_windows": f"SELECT job, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(brk) {run} AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM {LOG})) GROUP BY job, s",
        "score_buckets": f"SELECT CASE WHEN value >= 80 THEN 'good' WHEN value >= 50 THEN 'warn' ELSE 'danger' END AS bucket, count(*) AS n FROM {LOG} GROUP BY 1",
    }
