"""Joins by names and keys that may not match: every row without a partner keeps a status."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..fixtures import matches, table
from .registry import query

# Live rows are all matches under names of their own; eight of twelve teams have an alias. History has all matches too, one
# in ten on another day, one in thirty at another time.
_LIVE = """alias AS (SELECT * FROM (SELECT range AS team, 'T' || range AS live_name, 'Team ' || range AS name
    FROM range(8)) t), names AS (SELECT DISTINCT 'Team ' || home AS name FROM fx_match WHERE home < 10),
live AS (SELECT match_id, league, grp, match_date, CASE WHEN home < 9 THEN 'T' || home ELSE 'Team ' || home END AS home, CASE
    WHEN away < 9 THEN 'T' || away ELSE 'Team ' || away END AS away, season + (match_id % 40 = 0)::int AS season, (match_id * 7) % 90 AS
    minute FROM fx_match),
hist AS (SELECT match_id, league, grp, match_date + (match_id % 10 = 3)::int AS match_date, 'Team ' || home AS home, 'Team ' || away AS
    away, season, (match_id * 7) % 90 + CASE WHEN match_id % 30 = 0 THEN 45 ELSE 5 END AS minute FROM fx_match),
resolved AS (SELECT l.*, coalesce(a.name, n.name) AS home_name, coalesce(b.name, o.name) AS away_name FROM live l LEFT JOIN alias a
    ON a.live_name = l.home LEFT JOIN alias b ON b.live_name = l.away LEFT JOIN names n ON n.name = l.home LEFT JOIN names o
    ON o.name = l.away)"""


def _name(c: str) -> Column:
    return F.when(F.col(c) < 9, F.concat(F.lit("T"), F.col(c).cast("string"))).otherwise(F.concat(F.lit("Team "), F.col(c).cast("string")))


def resolve(rows, column: str, aliases, known):
    """``column`` as a known name: by alias (alias, name), else by a known name (name) itself, else null."""
    a = aliases.select(F.col("alias").alias(column), F.col("name").alias("_a"))
    k = known.select(F.col("name").alias(column), F.col("name").alias("_k"))
    return rows.join(a, column, "left").join(k, column, "left").withColumn(f"{column}_name", F.coalesce("_a", "_k")).drop("_a", "_k")


def resolved(spark, sf):
    m = matches(spark, sf)
    live = m.select("match_id", "league", "grp", "match_date", _name("home").alias("home"), _name("away").alias("away"), (F.col("season") + (F.col("match_id") % 40 == 0).cast("int")).alias("season"), ((F.col("match_id") * 7) % 90).alias("minute"))
    known = m.where("home < 10").select(F.concat(F.lit("Team "), F.col("home").cast("string")).alias("name")).distinct()
    aliases = spark.range(8).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("Team "), F.col("id").cast("string")).alias("name"))
    return resolve(resolve(live, "home", aliases, known), "away", aliases, known)


def history(spark, sf):
    team = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string")).alias(c)
    late = F.when(F.col("match_id") % 30 == 0, 45).otherwise(5)
    day = F.date_add("match_date", (F.col("match_id") % 10 == 3).cast("int")).alias("match_date")
    return matches(spark, sf).select("match_id", "league", "grp", day, team("home"), team("away"), "season", ((F.col("match_id") * 7) % 90 + late).alias("minute"))


@query("j3_canonical_names", f"WITH {_LIVE} SELECT home, home_name, count(*) AS n FROM resolved GROUP BY 1, 2", "match")
def canonical_names(spark, sf):
    return resolved(spark, sf).groupBy("home", "home_name").agg(F.count(F.lit(1)).alias("n"))


_PAIR = "ON h.grp = r.grp AND h.match_date = r.match_date AND h.home = r.home_name AND h.away = r.away_name"


def paired(spark, sf):
    """Live rows with the first of their historical rows, or none."""
    key = ["grp", "match_date", "home", "away"]
    h = history(spark, sf).groupBy(*key).agg(F.min(F.struct("match_id", "season", "minute")).alias("h"))
    r = resolved(spark, sf).select("match_id", "league", "grp", "match_date", F.col("home_name").alias("home"), F.col("away_name").alias("away"), "season", "minute")
    return r.join(h, key, "left")


@query("j2_live_history_join", f"""WITH {_LIVE} SELECT r.league, CASE WHEN home_name IS NULL OR away_name IS NULL THEN 'unmapped'
    WHEN EXISTS (SELECT 1 FROM hist h WHERE h.grp = r.grp AND h.match_date = r.match_date AND h.home = r.home_name
    AND h.away = r.away_name) THEN 'paired' ELSE 'unmatched' END AS status, count(*) AS n FROM resolved r GROUP BY 1, 2""", "match")
def live_history_join(spark, sf):
    status = F.when(F.col("home").isNull() | F.col("away").isNull(), "unmapped").when(F.col("h").isNotNull(), "paired").otherwise("unmatched")
    return paired(spark, sf).groupBy("league", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("j12_parity", f"""WITH {_LIVE}, p AS (SELECT r.match_id, r.league, r.season, r.minute, arg_min(h.season, h.match_id) AS hs,
    arg_min(h.minute, h.match_id) AS hm FROM resolved r LEFT JOIN hist h {_PAIR} GROUP BY 1, 2, 3, 4)
SELECT league, count(hs) AS paired, count(*) - count(hs) AS unmatched, count(*) FILTER (season <> hs) AS season_differs, count(*) FILTER
    (abs(minute - hm) > 30) AS kickoff_differs FROM p GROUP BY 1""", "match")
def parity(spark, sf):
    x = paired(spark, sf)
    return x.groupBy("league").agg(F.count("h").alias("paired"), F.count_if(F.col("h").isNull()).alias("unmatched"), F.count_if(F.col("season") != F.col("h.season")).alias("season_differs"), F.count_if(F.abs(F.col("minute") - F.col("h.minute")) > 30).alias("kickoff_differs"))


@query("j11_official_links", """WITH official AS (SELECT match_id AS report, league, match_date, CASE WHEN match_id % 5 = 0 THEN away
    ELSE home END AS home, CASE WHEN match_id % 5 = 0 THEN home ELSE away END AS away FROM fx_match),
fx AS (SELECT league, match_date, home, away, count(*) AS n, min(match_id) AS match_id
    FROM (SELECT * REPLACE (match_date + (match_id % 7 = 0)::int AS match_date) FROM fx_match) d GROUP BY 1, 2, 3, 4)
SELECT o.report, CASE WHEN o.league = 'L4' THEN 'other_league' WHEN greatest(o.home, o.away) = 11 THEN 'awaiting_alias'
    WHEN f.n > 1 THEN 'ambiguous' WHEN f.n = 1 THEN 'linked' WHEN r.n >= 1 THEN 'reversed' ELSE 'not_in_db' END AS status,
 CASE WHEN o.league <> 'L4' AND greatest(o.home, o.away) <> 11 AND f.n = 1 THEN f.match_id END AS match_id
FROM official o LEFT JOIN fx f USING (league, match_date, home, away) LEFT JOIN fx r ON r.league = o.league AND r.match_date = o.match_date
    AND r.home = o.away AND r.away = o.home""", "match")
def official_links(spark, sf):
    """Reports linked by day and both teams; every report has one status. Both orders are looked up in one join."""
    m = matches(spark, sf)
    flip = F.col("match_id") % 5 == 0
    o = m.select(F.col("match_id").alias("report"), "league", "match_date", F.when(flip, F.col("away")).otherwise(F.col("home")).alias("home"), F.when(flip, F.col("home")).otherwise(F.col("away")).alias("away"))
    fx = m.withColumn("match_date", F.date_add("match_date", (F.col("match_id") % 7 == 0).cast("int"))).groupBy("league", "match_date", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), "home").agg(F.count(F.lit(1)).alias("n"), F.min("match_id").alias("id"))
    fx = fx.groupBy("league", "match_date", "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("n", "id")))).alias("by_home"))
    x = o.withColumns({"a": F.least("home", "away"), "b": F.greatest("home", "away")}).join(fx, ["league", "match_date", "a", "b"], "left")
    own, other = F.col("by_home")[F.col("home")], F.col("by_home")[F.col("away")]
    status = F.when(F.col("league") == "L4", "other_league").when(F.col("b") == 11, "awaiting_alias").when(own["n"] > 1, "ambiguous").when(own["n"] == 1, "linked").when(other.isNotNull(), "reversed").otherwise("not_in_db")
    return x.select("report", status.alias("status"), F.when(status == "linked", own["id"]).alias("match_id"))


@query("w2_latest_before", """SELECT match_id, official FROM (SELECT match_id, grp::bigint AS g, 1704067200 + (match_id * 977) % 2592000 AS
    s FROM fx_match) m ASOF JOIN (SELECT user_id % 25 AS g, floor(epoch(ts))::bigint AS s, max(event_id) AS official FROM events
    GROUP BY 1, 2) x ON x.g = m.g AND m.s > x.s""", "match")
def latest_before(spark, sf):
    return last_event(matches(spark, sf), table(spark, sf, "events"))


def last_event(m, events):
    """The last event of the group strictly before an instant, without a join of the two: both sides are united by day, a
    day's own rows are carried forward in one window and what came before the day is carried in."""
    m = m.select(F.col("grp").cast("long").alias("g"), (F.lit(1704067200) + (F.col("match_id") * 977) % 2592000).alias("s"), F.lit(0).alias("side"), F.col("match_id").alias("match_id"), F.lit(None).cast("long").alias("event_id"))
    e = events.select((F.col("user_id") % 25).alias("g"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("match_id"), "event_id")
    both = m.unionByName(e).withColumn("day", F.floor(F.col("s") / 86400))
    days = both.groupBy("g", "day").agg(F.max_by("event_id", F.when(F.col("event_id").isNotNull(), F.struct("s", "event_id"))).alias("last"))
    past = Window.partitionBy("g").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("g", "day", F.last("last", ignorenulls=True).over(past).alias("before"))
    w = Window.partitionBy("g", "day").orderBy("s", "side", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = both.withColumn("today", F.last("event_id", ignorenulls=True).over(w)).where("match_id is not null").join(days, ["g", "day"])
    return x.select("match_id", F.coalesce("today", "before").alias("official")).where("official is not null")


@query("p19_horizon", "SELECT match_id FROM fx_match WHERE home IN (0, 1, 2) AND match_id % 9 <> 0 AND match_date BETWEEN date '1997-06-01' AND date '1997-06-11'", "match")
def horizon(spark, sf):
    """Unsealed fixtures of some home teams within ten days."""
    return matches(spark, sf).where(F.col("home").isin(0, 1, 2) & (F.col("match_id") % 9 != 0) & F.col("match_date").between("1997-06-01", "1997-06-11")).select("match_id")


@query("p21_public_views", """SELECT league, count(*) AS n, min(match_date)::date::varchar AS first_day FROM fx_match
    WHERE league IN (SELECT league FROM fx_match GROUP BY 1 HAVING max(match_id) % 2 = 0 OR count(*) > 100)
    AND match_date >= date '1996-01-01' GROUP BY 1""", "match")
def public_views(spark, sf):
    """Fixtures of active leagues from a floor day on, read through temporary views."""
    fixture, active = (f"{name}_{uuid.uuid4().hex}" for name in ("fixture", "active"))  # runs in one session don't share them
    matches(spark, sf).createOrReplaceTempView(fixture)
    spark.sql(f"select league from {fixture} group by league having max(match_id) % 2 = 0 or count(*) > 100").createOrReplaceTempView(active)
    return spark.sql(f"select league, count(*) n, cast(min(match_date) as string) first_day from {fixture} left semi join {active} using (league) where match_date >= date '1996-01-01' group by league")


@query("p22_allowed_strategies", "SELECT match_id, book FROM fx_odds WHERE phase = 1 AND book IN (0, 2) AND d IS NOT NULL", "odds")
def allowed_strategies(spark, sf, wanted=(0, 2), allowed=(0, 1, 2)):
    """Rows of the wanted strategies; a request outside the allowed set is an error, and so is such a row."""
    from ..fixtures import odds

    if not set(wanted) <= set(allowed):
        raise ValueError("a strategy isn't allowed")
    x = odds(spark, sf).where(F.col("book").isin(*wanted) & (F.col("phase") == 1) & F.col("d").isNotNull())
    return x.withColumn("book", F.when(F.col("book").isin(*allowed), F.col("book")).otherwise(F.raise_error(F.lit("a row isn't allowed")).cast("int"))).select("match_id", "book")


@query("u4_common_components", """SELECT match_id, string_agg(book::varchar, ',' ORDER BY book) AS common FROM (SELECT match_id, book
    FROM fx_odds WHERE d IS NOT NULL AND 1/h + 1/d + 1/a >= 1 GROUP BY 1, 2 HAVING count(*) = 2) t GROUP BY 1""", "odds")
def common_components(spark, sf):
    """Books usable in both phases: the intersection of each phase's set."""
    from ..fixtures import odds

    fine = F.col("d").isNotNull() & (1 / F.col("h") + 1 / F.col("d") + 1 / F.col("a") >= 1)
    sets = odds(spark, sf).where(fine).groupBy("match_id", "phase").agg(F.collect_set("book").alias("s"))
    x = sets.groupBy("match_id").agg(F.collect_list("s").alias("s")).where(F.size("s") == 2)
    both = F.array_sort(F.reduce(F.slice("s", 2, 1), F.get("s", 0), lambda a, b: F.array_intersect(a, b)))
    return x.select("match_id", F.array_join(both.cast("array<string>"), ",").alias("common")).where("common <> ''")
