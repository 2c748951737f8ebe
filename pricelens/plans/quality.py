"""Data-quality contracts: each is a table of violations or of counts that a caller can refuse on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import matches, odds, table
from .registry import query


def violations(df: DataFrame, minimum: int, required: list[str]) -> DataFrame:
    """(rule, n): too few rows, and rows with a null or empty required field; all rules in one pass."""
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    x = df.agg(F.count(F.lit(1)).alias("rows"), *[empty(c).alias(c) for c in required])
    rules = [F.struct(F.lit("too_few_rows").alias("rule"), F.greatest(F.lit(minimum) - F.col("rows"), F.lit(0)).cast("long").alias("n"))]
    rules += [F.struct(F.lit(f"empty_{c}").alias("rule"), F.col(c).alias("n")) for c in required]
    return x.select(F.inline(F.array(*rules))).where("n > 0")


@query("q1_schema_assertion", """SELECT * FROM (SELECT 'too_few_rows' AS rule, greatest(1000000 - count(*), 0) AS n FROM documents UNION ALL
    SELECT 'empty_text', count(*) FILTER (text IS NULL OR trim(text) = '') FROM documents UNION ALL
    SELECT 'empty_source', count(*) FILTER (source IS NULL OR trim(source) = '') FROM documents) t WHERE n > 0""")
def schema_assertion(spark, sf):
    return violations(table(spark, sf, "documents"), 1_000_000, ["text", "source"])


@query("q2_freshness", """SELECT event_type, CASE WHEN max(epoch(ts)) > 1706659200 + 60 THEN 'future'
    WHEN max(epoch(ts)) < 1706659200 - 3600 THEN 'stale' ELSE 'fresh' END AS state FROM events GROUP BY 1""")
def freshness(spark, sf, now=1706659200, limit=3600):
    last = F.max(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.date_format(F.col("ts").cast("timestamp"), "SSSSSS").cast("double") / 1e6)
    x = table(spark, sf, "events").groupBy("event_type").agg(last.alias("last"))
    return x.select("event_type", F.when(F.col("last") > now + 60, "future").when(F.col("last") < now - limit, "stale").otherwise("fresh").alias("state"))


# What each source may be late by, in seconds; times of their own count alone.
LIMITS = {"click": 3600, "view": 600, "error": 86400}


@query("q2_freshness_by_source", f"""SELECT event_type, n, provided, CASE WHEN provided = 0 THEN 'no_time'
    WHEN last > 1706659200 + 60 THEN 'future' WHEN most IS NULL THEN 'no_limit' WHEN last < 1706659200 - most THEN 'stale'
    ELSE 'fresh' END AS state FROM (
 SELECT event_type, count(*) AS n, count(*) FILTER (own) AS provided, max(epoch(ts)) FILTER (own) AS last FROM (SELECT *, user_id % 3 <> 0
    AND event_type <> 'purchase' AS own FROM events) e GROUP BY 1) x
    LEFT JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in LIMITS.items())}) l(event_type, most) USING (event_type)""")
def freshness_by_source(spark, sf, now=1706659200):
    own = (F.col("user_id") % 3 != 0) & (F.col("event_type") != "purchase")
    limits = spark.createDataFrame(list(LIMITS.items()), "source string, most long")
    x = fresh(table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"), own.alias("provided")), limits, now)
    return x.withColumnRenamed("source", "event_type")


def fresh(rows: DataFrame, limits: DataFrame, now: int) -> DataFrame:
    """(source, n, provided, state) of rows (source, at, provided): a source is judged by its newest time that it provided
    itself; a time more than a minute ahead is a fault, and so are a source without a time and one without a limit."""
    second = F.unix_micros("at") / 1e6
    x = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("provided").alias("provided"), F.max(F.when(F.col("provided"), second)).alias("last")).join(F.broadcast(limits), "source", "left")  # a row a source
    state = F.when(F.col("provided") == 0, "no_time").when(F.col("last") > now + 60, "future").when(F.col("most").isNull(), "no_limit").when(F.col("last") < now - F.col("most"), "stale").otherwise("fresh")
    return x.select("source", "n", "provided", state.alias("state"))


@query("q3_reject_shares", """SELECT season, count(*) AS cells, count(*) FILTER (d IS NULL) AS bad, CASE
    WHEN avg((d IS NULL)::int) > 0.01 THEN 'too_many_rejects' WHEN avg((phase = 1
    AND d IS NOT NULL)::int) < 0.5 * avg((phase = 1)::int) THEN 'closing_missing' ELSE 'ok' END AS verdict FROM fx_odds
    JOIN fx_match USING (match_id) GROUP BY 1""", "odds")
def reject_shares(spark, sf):
    hole, closing = F.col("d").isNull().cast("int"), (F.col("phase") == 1).cast("int")
    x = odds(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("cells"), F.sum(hole).alias("bad"), F.avg(hole).alias("share"), F.avg(closing * (1 - hole)).alias("have"), F.avg(closing).alias("want"))
    verdict = F.when(F.col("share") > 0.01, "too_many_rejects").when(F.col("have") < 0.5 * F.col("want"), "closing_missing").otherwise("ok")
    return x.select("season", "cells", "bad", verdict.alias("verdict"))


@query("q4_duplicate_refusal", """SELECT league, count(*) AS keys, sum(n)::bigint AS n_rows
    FROM (SELECT league, match_date, home, away, count(*) AS n FROM fx_match GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) t GROUP BY 1""", "match")
def duplicate_refusal(spark, sf):
    x = matches(spark, sf).groupBy("league", "match_date", "home", "away").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.groupBy("league").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n_rows"))


_RULES = {
    "floor_date": ("match_date < date '1993-01-01'", "fx_match"),
    "own_opponent": ("home = away", "fx_match"),
    "negative_goals": ("home_goals < 0 OR away_goals < 0", "fx_match"),
    "decimals": ("abs(h * 100 - round(h * 100)) > 0.01", "fx_odds"),
    "price_floor": ("h <= 1 OR a <= 1", "fx_odds"),
}


@query("q5_snapshot_rules", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS n FROM {t}" for k, (c, t) in _RULES.items()) + """ UNION ALL SELECT 'key_repeats',
    count(*) - count(DISTINCT match_id) FROM fx_match""", "odds")
def snapshot_rules(spark, sf):
    """Counts of rows that break each rule of a published snapshot: one pass a table, whatever the number of rules."""
    frames = {"fx_match": matches(spark, sf), "fx_odds": odds(spark, sf)}
    out = None
    for name, df in frames.items():
        mine = {k: c for k, (c, t) in _RULES.items() if t == name}
        x = df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in mine.items()])
        x = x.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in mine])))
        out = x if out is None else out.unionByName(x)
    repeats = frames["fx_match"].groupBy("match_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.sum("more").alias("n"))
    return out.unionByName(repeats.select(F.lit("key_repeats").alias("rule"), "n"))


@query("q7_availability", """SELECT source, count(*) FILTER (available < first_seen) AS before_seen, count(*) FILTER (available < claim) AS
    before_claim, count(*) FILTER (claim IS NULL AND doc_id % 2 = 0) AS archive_without_claim
    FROM (SELECT *, (doc_id * 7) % 100 AS first_seen, CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 3) % 100 END AS claim, (doc_id * 7) % 100 +
    doc_id % 50 AS available FROM documents) t GROUP BY 1""")
def availability(spark, sf):
    i = F.col("doc_id")
    x = table(spark, sf, "documents").withColumns({"first_seen": (i * 7) % 100, "claim": F.when(i % 9 != 0, (i * 3) % 100), "available": (i * 7) % 100 + i % 50})
    return x.groupBy("source").agg(F.count_if(F.col("available") < F.col("first_seen")).alias("before_seen"), F.count_if(F.col("available") < F.col("claim")).alias("before_claim"), F.count_if(F.col("claim").isNull() & (i % 2 == 0)).alias("archive_without_claim"))


@query("q8_row_reconciliation", """SELECT coalesce(a.league, b.league) AS league, coalesce(a.n, 0) AS locked, coalesce(b.n, 0) AS present,
    coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM (SELECT league, count(*) AS n FROM fx_match GROUP BY 1) a
    FULL JOIN (SELECT league, count(*) AS n FROM fx_match WHERE league <> 'L2' OR match_id % 100 <> 0 GROUP BY 1) b ON a.league = b.league""", "match")
def row_reconciliation(spark, sf):
    n = F.count(F.lit(1))
    m = matches(spark, sf)
    x = m.groupBy("league").agg(n.alias("locked"), F.count_if((F.col("league") != "L2") | (F.col("match_id") % 100 != 0)).alias("present"))
    return x.select("league", "locked", "present", (F.col("locked") == F.col("present")).alias("agrees"))


@query("q10_single_opening", """SELECT phase, count(*) AS openings, CASE WHEN count(*) = 1
    AND max((event_type = 'error')::int) = 1 THEN 'rerun' ELSE 'refused' END AS verdict
    FROM (SELECT concat_ws('|', user_id::varchar, ts::date::varchar) AS phase, event_type FROM events) t GROUP BY 1""")
def single_opening(spark, sf):
    """A phase is a user's day; any revision will do, a failure is the reason, nothing is reported."""
    x = access_log(spark, sf).withColumns({"revision": F.lit("r1"), "reported": F.lit(False)})
    return rerun_rule(x, "r1").select("phase", "openings", F.when(F.col("against").isNull(), "rerun").otherwise("refused").alias("verdict"))


def access_log(spark, sf):
    """Events as openings: a phase is a user's day, the revision goes by value, errors name a reason, views are reports."""
    e = table(spark, sf, "events")
    phase = F.concat_ws("|", "user_id", F.to_date(F.col("ts").cast("timestamp")))
    return e.select(phase.alias("phase"), F.when(F.col("value") < 20, "r1").otherwise("r2").alias("revision"), F.when(F.col("event_type") == "error", "crash").alias("reason"), (F.col("event_type") == "view").alias("reported"))


def rerun_rule(log, revision):
    """(phase, openings, against) of an access log (phase, revision, reason, reported): a phase may be run again only after
    exactly one opening, without a report, at the same revision and for a named reason; ``against`` is the first of
    these that fails, null if none does."""
    x = log.groupBy("phase").agg(F.count(F.lit(1)).alias("openings"), F.bool_or("reported").alias("reported"), F.max("revision").alias("of"), F.max("reason").alias("reason"))
    against = F.when(F.col("openings") > 1, "openings").when(F.col("reported"), "report").when(F.col("of") != revision, "revision").when(F.col("reason").isNull(), "reason")
    return x.select("phase", "openings", against.alias("against"))


@query("q10_rerun_rule", """SELECT phase, count(*) AS openings, CASE WHEN count(*) > 1 THEN 'openings'
    WHEN bool_or(event_type = 'view') THEN 'report' WHEN max(value) >= 20 THEN 'revision'
    WHEN NOT bool_or(event_type = 'error') THEN 'reason' END AS against FROM (SELECT user_id || '|' || ts::date AS phase, event_type, value
    FROM events) t GROUP BY 1""")
def rerun(spark, sf):
    return rerun_rule(access_log(spark, sf), "r1")


def guarded(df: DataFrame, period_col: str, wanted: list[str], log: DataFrame | None = None, token: str | None = None) -> DataFrame:
    """Rows of the wanted periods; the holdout needs a token that the access log holds; an unknown period is an error."""
    if unknown := set(wanted) - {"dev", "holdout", "post"}:
        raise ValueError(f"unknown periods {sorted(unknown)}")
    if "holdout" in wanted and (log is None or token is None or log.where(F.col("token") == token).isEmpty()):
        raise PermissionError("the holdout needs a logged token")
    return df.where(F.col(period_col).isin(*wanted))


@query("p5_guarded_periods", "SELECT league, count(*) AS n FROM fx_match WHERE match_date < date '2000-07-01' OR match_date >= date '2001-01-01' GROUP BY 1", "match")
def guarded_periods(spark, sf):
    from ..functions import timeaxis as T

    m = matches(spark, sf).withColumn("period", T.period(F.col("match_date"), "2000-07-01", "2001-01-01"))
    return guarded(m, "period", ["dev", "post"]).groupBy("league").agg(F.count(F.lit(1)).alias("n"))
