"""Latest rows, change logs, ranks, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import matches, table
from ..functions import timeaxis as T
from .registry import query


@query("w1_latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("w3_change_log", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
    ORDER BY event_id) AS before FROM events) t WHERE before IS DISTINCT FROM event_type""")
def change_log(spark, sf):
    """Rows that differ from their key's value before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").withColumn("before", F.lag("event_type").over(w)).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("w4_dense_rank_pseudonym", "SELECT l_orderkey, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS part_no FROM lineitem")
def dense_rank_pseudonym(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")).cast("long").alias("part_no"))


@query("w5_replay_order", "SELECT match_id, row_number() OVER (PARTITION BY grp ORDER BY match_date, match_id % 24, league, home, match_id) AS place FROM fx_match", "match")
def replay_order(spark, sf):
    """Places by day and within it: a group's days, and then each day's matches, enter a window."""
    m = matches(spark, sf)
    days = m.groupBy("grp", "match_date").agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("grp").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("grp", "match_date", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    w = Window.partitionBy("grp", "match_date").orderBy(F.col("match_id") % 24, "league", "home", "match_id")
    x = m.withColumn("own", F.row_number().over(w)).join(days, ["grp", "match_date"])
    return x.select("match_id", (F.col("before") + F.col("own")).cast("long").alias("place"))


@query("w6_usual_gap", """SELECT grp, count(*) AS gaps, round(quantile_cont(gap, 0.9), 6) AS p90
    FROM (SELECT grp, (match_date - lag(match_date) OVER (PARTITION BY grp ORDER BY match_date))::int AS gap
    FROM (SELECT DISTINCT grp, match_date FROM fx_match) d) t WHERE gap <= 10 GROUP BY 1 HAVING count(*) >= 10""", "match")
def usual_gap(spark, sf):
    d = matches(spark, sf).select("grp", "match_date").distinct()
    x = d.withColumn("gap", F.datediff("match_date", F.lag("match_date").over(Window.partitionBy("grp").orderBy("match_date")))).where("gap <= 10")
    return x.groupBy("grp").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.expr("percentile(gap, 0.9)"), 6).alias("p90")).where("gaps >= 10")


# Match days that a league must have, longest regular gap and longest gap within a season in days, the
# quantile of regular gaps over a year that is usual.
DAYS_NEEDED, REGULAR, IN_SEASON, YEAR, QUANTILE = 10, 10, 21, 365, 0.9


def lag_test(m, decisions):
    """(region, league, decided, gap, usual, lagging) from the match days (region, league, match_date) of ``m`` and the
    decision days (region, decided): a league lags if its last match day lies further back than is usual for it and
    another league of its region has played since. ``usual`` is the quantile of the year's regular gaps and one day
    more, null where there is none or the league is new or out of season.

    Gaps are whole days up to ``REGULAR``, so the rolling quantile comes from that many running counts, and days, not
    matches, enter the windows."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01"))
    days = m.select("region", "league", number("match_date").alias("day")).distinct()
    days = days.withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy("region", "league").orderBy("day")))
    asked = days.select("region", "league").distinct().join(decisions.select("region", number("decided").alias("day")).distinct(), "region")
    both = days.select("region", "league", "day", "gap", F.lit(False).alias("asked")).unionByName(asked.select("region", "league", "day", F.lit(None).cast("int").alias("gap"), F.lit(True).alias("asked")))
    ever = Window.partitionBy("region", "league").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    recent = Window.partitionBy("region", "league").orderBy("day").rangeBetween(-YEAR, -1)
    played = F.when(~F.col("asked"), F.col("day"))
    x = both.withColumns({"last": F.max(played).over(ever), "days": F.count(played).over(ever), **{f"_{k}": F.count(F.when(F.col("gap") == k, 1)).over(recent) for k in range(1, REGULAR + 1)}}).where("asked")
    total = sum((F.col(f"_{k}") for k in range(1, REGULAR + 1)), F.lit(0))
    place = F.floor(F.lit(QUANTILE) * (total - 1))
    below = {k: sum((F.col(f"_{i}") for i in range(1, k)), F.lit(0)) for k in range(1, REGULAR + 1)}
    usual = F.coalesce(*[F.when(below[k] <= place, k) for k in range(REGULAR, 0, -1)])
    gap = F.col("day") - F.col("last")
    x = x.withColumn("gap", gap).withColumn("usual", F.when((F.col("days") >= DAYS_NEEDED) & (gap <= IN_SEASON) & (total > 0), usual + 1))
    since = F.max("last").over(Window.partitionBy("region", "day")) > F.col("last")
    return x.select("region", "league", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("decided"), "gap", "usual", F.coalesce((F.col("gap") > F.col("usual")) & since, F.lit(False)).alias("lagging"))


_DECIDED = "(CASE WHEN isodow(match_date) BETWEEN 2 AND 4 THEN match_date - (isodow(match_date) - 2)::int ELSE match_date - ((isodow(match_date) + 2) % 7)::int END)::date"


@query("w6_lag_test", f"""WITH days AS (SELECT DISTINCT league AS region, grp AS league, match_date AS day
    FROM fx_match), gaps AS (SELECT *, day - lag(day) OVER (PARTITION BY region, league ORDER BY day) AS gap FROM days),
ask AS (SELECT DISTINCT l.region, l.league, d.day AS decided FROM days l JOIN (SELECT DISTINCT league AS region, {_DECIDED} AS day
    FROM fx_match) d ON d.region = l.region),
past AS (SELECT a.region, a.league, decided, max(day) AS last, count(day) AS n, list(gap ORDER BY gap) FILTER (gap <= {REGULAR}
    AND decided - day <= {YEAR}) AS regular FROM ask a LEFT JOIN gaps g ON g.region = a.region AND g.league = a.league AND g.day < decided
    GROUP BY 1, 2, 3),
u AS (SELECT *, (decided - last)::int AS gap, CASE WHEN n >= {DAYS_NEEDED} AND decided - last <= {IN_SEASON}
    AND len(regular) > 0 THEN (regular[floor({QUANTILE} * (len(regular) - 1))::int + 1] + 1)::int END AS usual FROM past)
SELECT region, league, decided::date::varchar AS decided, gap, usual, coalesce(gap > usual AND max(last) OVER (PARTITION BY region, decided) > last, false) AS lagging
    FROM u""", "match")
def lagging_leagues(spark, sf):
    """Nations as leagues of five regions, on every decision day of their region."""
    m = matches(spark, sf).select(F.col("league").alias("region"), F.col("grp").alias("league"), "match_date")
    out = lag_test(m, m.select("region", T.decision_day(F.col("match_date")).alias("decided")))
    return out.withColumn("decided", F.date_format("decided", "yyyy-MM-dd"))


@query("w7_top_k", """SELECT grp, match_id FROM (SELECT grp, match_id, row_number() OVER (PARTITION BY grp
    ORDER BY home_goals + away_goals DESC, match_date, match_id) AS k FROM fx_match) t WHERE k <= 6""", "match")
def top_k(spark, sf):
    w = Window.partitionBy("grp").orderBy(F.desc(F.col("home_goals") + F.col("away_goals")), "match_date", "match_id")
    return matches(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 6").select("grp", "match_id")


@query("w8_earliest_of_cluster", "SELECT sha256(text) AS cluster, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def earliest_of_cluster(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").groupBy(F.sha2("text", 256).alias("cluster")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("u1_union_names", "SELECT grp, home AS team FROM fx_match UNION SELECT grp, away FROM fx_match", "match")
def union_names(spark, sf):
    m = matches(spark, sf)
    return m.select("grp", F.col("home").alias("team")).union(m.select("grp", "away")).distinct()


@query("u2_set_difference", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("u3_event_union", """SELECT kind, count(*) AS n, min(day)::date::varchar AS first_day FROM (SELECT 0 AS kind, match_date AS day
    FROM fx_match UNION ALL SELECT 1, match_date + 1 FROM fx_match) t GROUP BY 1""", "match")
def event_union(spark, sf):
    m = matches(spark, sf)
    x = m.select(F.lit(0).alias("kind"), F.col("match_date").alias("at")).unionByName(m.select(F.lit(1).alias("kind"), F.date_add("match_date", 1).alias("at")))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").cast("string").alias("first_day"))
