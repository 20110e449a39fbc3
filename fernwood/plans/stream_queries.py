"""Streaming queries; their SQL states the same over the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.streaming import events, requests


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return events.source(spark, f"{d}/events.parque[t]", like=f"{d}/events.parquet")  # a pattern, so that one file serves as well as a folder


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.taken(events.tumbling(_stream(spark, d)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return events.taken(events.sessions(_stream(spark, d)), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return events.taken(events.deduplicated(twice).select("event_id", "user_id", "event_type"), "append")


def _requests(rows: DataFrame) -> DataFrame:
    """Events as a log of requests: what a user does in an hour is one request, the kind of event says what became of it."""
    kind = F.element_at(F.array(*map(F.lit, ("planned", "sent", "failed", "answered", "sent", "other"))), (F.ascii(F.substring("event_type", 2, 1)) % 6 + 1).cast("int"))
    return rows.select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH")).alias("request_id"), kind.alias("event"), F.length("props").cast("long").alias("chars"))


def stream_requests(spark: SparkSession, d: str) -> DataFrame:
    """States of requests, kept over a stream."""
    return events.taken(requests.states(_requests(_stream(spark, d))), "complete").groupBy("state").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_session, stream_dedupe, stream_requests)}
SQL = {
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "stream_requests": """WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y%m%d%H') AS id, length(props) AS chars, ['planned', 'sent', 'failed', 'answered', 'sent', 'other'][ascii(substring(event_type, 2, 1)) % 6 + 1] AS event FROM events),
        r AS (SELECT id, max(CASE event WHEN 'planned' THEN 0 WHEN 'sent' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END) AS reach, count(*) FILTER (event = 'sent') AS calls, coalesce(sum(chars) FILTER (event = 'sent'), 0) AS chars FROM e WHERE event <> 'other' GROUP BY id)
        SELECT ['not_sent', 'started', 'ambiguous', 'succeeded'][reach + 1] AS state, count(*) AS n, sum(calls)::BIGINT AS calls, sum(chars)::BIGINT AS chars FROM r GROUP BY reach""",
    "stream_dedupe": "SELECT event_id, user_id, event_type FROM events",
}
