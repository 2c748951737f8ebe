"""Instants, periods, zones and seasons of matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import matches, with_odds
from ..functions import timeaxis as T
from .registry import query

# Kick-off hours: null every 13th match. The clocks change on the last Sundays of March and October, before 1996
# on the Sunday after October's fourth Saturday.
_KICK = """days AS (SELECT *, CASE WHEN match_id % 13 <> 0 THEN match_date + to_hours(match_id % 24) END AS local, match_date + interval
    12 hours AS noon,
  make_date(year(match_date)::int, 3, 31) - dayofweek(make_date(year(match_date)::int, 3, 31))::int + interval 2 hours AS spring,
  make_date(year(match_date)::int, 10, CASE WHEN year(match_date) < 1996 THEN 28
    ELSE 31 END) - dayofweek(make_date(year(match_date)::int, 10, CASE WHEN year(match_date) < 1996 THEN 28
    ELSE 31 END))::int + interval 1 hour AS autumn FROM fx_match),
kick AS (SELECT *, CASE WHEN local >= spring AND local < autumn THEN local - interval 1 hour ELSE local END AS utc FROM days)"""
_DDAY = "(CASE WHEN isodow(match_date) BETWEEN 2 AND 4 THEN match_date - (isodow(match_date) - 2)::int ELSE match_date - ((isodow(match_date) + 2) % 7)::int END)::date"
_UTC = """(CASE WHEN {x} >= make_date(year({x})::int, 3, 31) - dayofweek(make_date(year({x})::int, 3, 31))::int + interval 2 hours
    AND {x} < make_date(year({x})::int, 10, CASE WHEN year({x}) < 1996 THEN 28 ELSE 31 END) - dayofweek(make_date(year({x})::int, 10, CASE
    WHEN year({x}) < 1996 THEN 28 ELSE 31 END))::int + interval 1 hour THEN {x} - interval 1 hour ELSE {x} END)"""


def kickoffs(spark, sf):
    m = matches(spark, sf)
    local = F.when(F.col("match_id") % 13 != 0, F.col("match_date").cast("timestamp") + F.make_dt_interval(hours=F.col("match_id") % 24))
    return m.withColumn("kickoff", T.local_to_utc(local))


@query("p1_kickoff_utc", f"WITH {_KICK} SELECT match_id, epoch(utc)::bigint::varchar AS kickoff FROM kick", "match")
def kickoff_utc(spark, sf):
    return kickoffs(spark, sf).select("match_id", F.unix_timestamp("kickoff").cast("string").alias("kickoff"))


@query("p2_decision_instant", f"""WITH {_KICK}, d AS (SELECT *, {_UTC.format(x='noon_at')} AS noon_utc
    FROM (SELECT *, {_DDAY} + interval 12 hours AS noon_at FROM kick) t) SELECT match_id, CASE WHEN utc IS NULL
    OR noon_utc < utc THEN epoch(noon_utc)::bigint::varchar END AS decided FROM d""", "match")
def decision_instant(spark, sf):
    return kickoffs(spark, sf).select("match_id", F.unix_timestamp(T.decision_at(F.col("match_date"), F.col("kickoff"))).cast("string").alias("decided"))


@query("p3_result_known", f"""WITH {_KICK}, d AS (SELECT *, match_date + interval 27 hours AS late FROM kick)
    SELECT match_id, epoch(coalesce(utc + interval 3 hours, {_UTC.format(x='late')}))::bigint AS known FROM d""", "match")
def result_known(spark, sf):
    return kickoffs(spark, sf).select("match_id", F.unix_timestamp(T.result_known_at(F.col("match_date"), F.col("kickoff"))).alias("known"))


@query("p4_period_counts", """SELECT league, CASE WHEN match_date < date '2000-07-01' THEN 'dev'
    WHEN match_date < date '2001-01-01' THEN 'holdout' ELSE 'post' END AS period, count(*) AS n FROM fx_match GROUP BY 1, 2""", "match")
def period_counts(spark, sf):
    return matches(spark, sf).groupBy("league", T.period(F.col("match_date"), "2000-07-01", "2001-01-01").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("p6_window", "SELECT match_id FROM fx_match WHERE match_date >= date '1996-01-01' AND match_date < date '1997-01-01'", "match")
def in_window(spark, sf):
    return matches(spark, sf).where(T.window(F.col("match_date"), "1996-01-01", "1997-01-01", "2000-07-01")).select("match_id")


def _zones_sql(zoning: str) -> str:
    rows = ", ".join(f"('{z}', date '{a}', date '{b}')" for z, a, b in T.zone_rows(zoning))
    return f"SELECT match_id, zone FROM fx_match LEFT JOIN (VALUES {rows}) z(zone, first_day, last_day) ON match_date BETWEEN first_day AND last_day"


def zoned(m, zoning: str):
    """``m`` with its zone, null outside of all: an interval join with a table of a few rows."""
    z = T.zones(m.sparkSession, zoning)
    return m.join(F.broadcast(z), F.col("match_date").between(F.col("first_day"), F.col("last_day")), "left").drop("first_day", "last_day")


@query("p7_zone", _zones_sql("final"), "match")
def zone(spark, sf):
    return zoned(matches(spark, sf), "final").select("match_id", "zone")


@query("p7_zone_rehearsal", _zones_sql("rehearsal"), "match")
def zone_rehearsal(spark, sf):
    return zoned(matches(spark, sf), "rehearsal").select("match_id", "zone")


# Leagues whose files name their seasons themselves.
EXTRA = ("L3", "L4")
_EXTRA = ", ".join(f"'{x}'" for x in EXTRA)


@query("p8_season_code", f"""WITH days AS (SELECT league, match_date, max(season) AS season FROM fx_match WHERE league IN ({_EXTRA})
    GROUP BY 1, 2), before AS (SELECT *, lag(season) OVER (PARTITION BY league ORDER BY match_date) AS last FROM days)
SELECT match_id, CASE WHEN m.league IN ({_EXTRA}) THEN last::varchar
    ELSE lpad((y % 100)::varchar, 2, '0') || lpad(((y + 1) % 100)::varchar, 2, '0') END AS code
    FROM (SELECT *, year(match_date) - (month(match_date) < 7)::int AS y FROM fx_match) m LEFT JOIN before b ON b.league = m.league
    AND b.match_date = m.match_date""", "match")
def season_code(spark, sf):
    """Main leagues: the season that the date falls in. Extra ones: the season of the league's last earlier match day; a
    league's days, not its matches, enter the window."""
    m = matches(spark, sf)
    days = m.where(F.col("league").isin(*EXTRA)).groupBy("league", "match_date").agg(F.max("season").alias("season"))
    before = days.select("league", "match_date", F.lag("season").over(Window.partitionBy("league").orderBy("match_date")).alias("last"))
    x = m.join(before, ["league", "match_date"], "left")
    return x.select("match_id", F.when(F.col("league").isin(*EXTRA), F.col("last").cast("string")).otherwise(T.season(F.col("match_date"))).alias("code"))


@query("p17_closing_window", f"""WITH {_KICK} SELECT match_id FROM kick
    WHERE epoch(utc)::bigint - (epoch(match_date + interval 18 hours)::bigint + (match_id * 7) % 3600 - 1800) BETWEEN 0 AND 1200""", "match")
def closing_window(spark, sf):
    """Matches that begin within twenty minutes of a round's instant."""
    now = F.timestamp_seconds(F.unix_timestamp(F.col("match_date").cast("timestamp")) + 18 * 3600 + (F.col("match_id") * 7) % 3600 - 1800)
    return kickoffs(spark, sf).where(T.closing(F.col("kickoff"), now)).select("match_id")


@query("p15_before_kickoff", f"""WITH {_KICK} SELECT match_id, book, phase FROM fx_odds JOIN kick USING (match_id) WHERE utc IS NOT NULL
    AND ((match_id * 5 + book) % 3 = 0 OR (phase = 1 AND (match_id * 5 + book) % 3 = 1))""", "odds")
def quotes_before_kickoff(spark, sf):
    """Quotes observed ten minutes before, at, or ten minutes after the kick-off."""
    x = with_odds(kickoffs(spark, sf))
    observed = F.timestamp_seconds(F.unix_timestamp("kickoff") + ((F.col("match_id") * 5 + F.col("book")) % 3 - 1) * 600)
    return x.where(T.before_kickoff(observed, F.col("kickoff"), F.col("phase") == 1)).select("match_id", "book", "phase")


@query("m6_fit_days", """SELECT grp, (match_date - ((match_date - date '2000-01-03') % 28 + 28)::int % 28)::date::varchar AS fit_day,
    count(*) AS n FROM fx_match GROUP BY 1, 2""", "match")
def fit_days(spark, sf):
    return matches(spark, sf).groupBy("grp", T.fit_day(F.col("match_date"), 28).cast("string").alias("fit_day")).agg(F.count(F.lit(1)).alias("n"))
