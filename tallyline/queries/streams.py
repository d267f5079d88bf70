"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import captures as cap
from . import query


def _folder(spark) -> str:
    """A folder that all executors share: the session's checkpoint folder, or a local one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    return cap.events(spark, f"{d}/events.parquet")


@query("ss_1_incremental", "SELECT event_id, user_id FROM events")
def incremental(spark, d):
    """Every event once, though the stream holds each twice."""
    e = _events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return cap.run_once(cap.deduplicated(twice, "event_id", "40 days").select("event_id", "user_id"), _folder(spark))


@query("ss_2_late", "SELECT event_id, CASE WHEN ts IS NULL THEN 'no time' WHEN ts < '2024-01-10' THEN 'before since' ELSE 'at or after until' END AS refused FROM events WHERE ts IS NULL OR ts < '2024-01-10' OR ts >= '2024-01-20'")
def late(spark, d):
    x = cap.bounded(_events(spark, d), "2024-01-10", "2024-01-20").filter("refused IS NOT NULL")
    return cap.run_once(x.select("event_id", "refused"), _folder(spark))


@query("ss_3_sampled", "SELECT event_id FROM events WHERE substr(sha256('s1:' || event_id), 1, 16) < '4000000000000000'")
def sampled(spark, d):
    return cap.run_once(cap.sample(_events(spark, d), F.col("event_id"), 0.25, "s1").select("event_id"), _folder(spark))


@query("ss_6_days", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def days(spark, d):
    x = cap.per_window(_events(spark, d), ["event_type"], "1 day")
    return cap.run_once(x, _folder(spark), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 6).alias("value"))


@query("ss_7_weeks", "SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL 0 DAY, date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY, date_trunc('day', ts) - INTERVAL 3 DAY, date_trunc('day', ts) - INTERVAL 4 DAY, date_trunc('day', ts) - INTERVAL 5 DAY, date_trunc('day', ts) - INTERVAL 6 DAY]) AS s FROM events) GROUP BY 1")
def weeks(spark, d):
    x = cap.per_window(_events(spark, d), [], "7 days", "1 day")
    return cap.run_once(x, _folder(spark), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("ss_8_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, n, count(*) AS n_sessions FROM c GROUP BY 1, 2""")
def sessions(spark, d):
    """Sessions of users, closed by four hours of silence: how many of each length."""
    x = cap.sessions(_events(spark, d), ["user_id"], "4 hours")
    return cap.run_once(x, _folder(spark), "complete").groupBy("user_id", "n").agg(F.count("*").alias("n_sessions"))


@query("ss_4_log", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def log(spark, d):
    return cap.append_log(_events(spark, d), _folder(spark), ["user_id"], "at", ["event_id", "event_type"])
