"""Streams over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..streaming import rounds as R
from .registry import query


def _events(spark, sf):
    return R.source(spark, f"{sf}/events.parquet")


@query("t1_ingest", "SELECT event_id, event_type FROM events")
def ingest(spark, sf):
    """Every row is delivered twice and written once."""
    x = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return R.run(R.ingest(x, "event_id").select("event_id", "event_type"))


@query("t7_round_windows", """SELECT round_start, event_type, n, round(mean, 6) AS mean
    FROM (SELECT (epoch(ts)::bigint // 21600) * 21600 AS round_start, event_type, count(*) AS n, avg(value) AS mean
    FROM (SELECT event_type, value, ts FROM events) e GROUP BY 1, 2) t WHERE round_start + 21600 <= (SELECT max(epoch(ts)) - 600
    FROM events)""")
def round_windows(spark, sf):
    return R.run(R.tumbling(_events(spark, sf), "6 hours", "event_type")).withColumn("mean", F.round("mean", 6))


@query("t3_empty_rounds", """SELECT s AS round_start FROM (SELECT DISTINCT epoch(ts)::bigint // 21600 * 21600 AS s FROM events) a
    WHERE s + 21600 <= (SELECT max(epoch(ts)) - 600 FROM events) AND s NOT IN (SELECT epoch(ts)::bigint // 21600 * 21600 FROM events
    WHERE event_type = 'error' AND event_id % 3 = 0)""")
def empty_rounds(spark, sf):
    """Rounds with rows but without a written quote (every third error here), counted in one stream."""
    wrote = F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("wrote")
    return R.run(R.tumbling(_events(spark, sf), "6 hours", extra=(wrote,))).where("wrote = 0").select("round_start")


@query("t4_source_isolation", """SELECT event_type, CASE WHEN value < 10 THEN 'low'
    WHEN user_id % 11 = 0 THEN 'source' END AS error, count(*) AS n FROM events GROUP BY 1, 2""")
def source_isolation(spark, sf):
    x = R.run(R.quarantine(_events(spark, sf), {"low": F.col("value") < 10, "source": F.col("user_id") % 11 == 0}).select("event_type", "error"))
    return x.groupBy("event_type", "error").agg(F.count(F.lit(1)).alias("n"))


@query("t5_stream_change_log", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) AS before FROM events) t WHERE before IS DISTINCT FROM event_type""")
def stream_change_log(spark, sf):
    return R.run(R.change_log(_events(spark, sf)))


@query("t8_breaker")
def breaker(spark, sf):
    return R.run(R.breaker(_events(spark, sf)))


@query("t6_stream_ratings")
def stream_ratings(spark, sf):
    return R.run(R.ratings(_events(spark, sf))).withColumn("rating", F.round("rating", 6))


@query("t2_closing_seal", """SELECT e.user_id, CASE WHEN count(*) FILTER (s < start AND s >= start - 21600) > 0 THEN 'sealed'
    ELSE 'missed' END AS status, count(*) FILTER (s < start AND s >= start - 21600) AS closing
    FROM (SELECT user_id, epoch(ts)::bigint AS s, 1704067200 + 86400 * (5 + user_id % 20) AS start FROM events) e
    WHERE start * 1000 < (SELECT floor(max(epoch(ts)) * 1000) - 600000 FROM events) GROUP BY 1""")
def closing_seal(spark, sf):
    """Each user's start is an instant of its own; six hours before it count as closing."""
    starts = table(spark, sf, "events").select("user_id").distinct().withColumn("start", F.lit(1704067200) + 86400 * (5 + F.col("user_id") % 20))
    return R.run(R.seal(_events(spark, sf), starts, 360))
