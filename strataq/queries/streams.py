"""Structured Streaming over the events file, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.queries.registry import query
from strataq.streaming import windows as S


def _events(e):
    return S.read_stream(e.spark, e.catalog.folder, "events")


def _agg():
    return [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]


@query("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def tumbling(e):
    return S.run_available(S.tumbling(_events(e), "ts", "1 day", ["event_type"], _agg()), "complete").select("event_type", F.col("window_start").alias("day"), "n")


@query("stream_sliding", "SELECT w AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS w FROM events, range(2) t(k)) GROUP BY w")
def sliding(e):
    return S.run_available(S.sliding(_events(e), "ts", "12 hours", "6 hours", [], _agg()), "complete").select(F.col("window_start").alias("start"), "n")


@query("stream_session", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events)) GROUP BY user_id, s""")
def session(e):
    return S.run_available(S.sessions(_events(e), "ts", "30 minutes", ["user_id"], _agg()), "complete").select("user_id", F.col("window_start").alias("start"), "n")


@query("stream_deduplicate", "SELECT count(DISTINCT (user_id, event_type, ts)) AS n FROM events")
def dedup(e):
    return S.run_available(S.deduplicate(_events(e), ["user_id", "event_type", "ts"], "ts", "3650 days")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_maintained_aggregate", "SELECT event_type, count(*) AS count, round(sum(value)::DOUBLE, 4) AS sum FROM events GROUP BY event_type")
def maintained(e):
    import uuid

    from strataq.operators.aggregate import read_state
    from strataq.plans.lineage import shared_folder

    path = f"{shared_folder(e.spark)}/maintained-{uuid.uuid4().hex}"
    q = S.maintain(_events(e), ["event_type"], "value", path + "/table", path + "/log")
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return read_state(e.spark.read.parquet(f"{path}/table/{last}"), ["event_type"]).select("event_type", "count", F.round("sum", 4).alias("sum"))
