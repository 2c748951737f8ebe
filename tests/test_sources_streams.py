"""Readers on small files, sinks, and streams against plain loops."""

import pytest
from pyspark.sql import functions as F

from pricelens import plans
from pricelens.functions import text as T
from pricelens.operators.goals import fit_strengths
from pricelens.operators.replay import Elo, replay
from pricelens.plans.quality import guarded
from pricelens.plans.reports import calibration
from pricelens.sources import documents, sinks, wide

SF = "/root/testdata/sf0.001"


def test_wide_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,XH,XH\r\nE0,05/08/2005,15:00,A,B,2,1,H,1.5,9\r\nE0,05/08/05,,A,C,1,1,D,0.9,9,,\r\nE0,31/02/2005,,A,C,1,1,D,2,9\r\nE0,06/08/2005,,A,C,1,1,D,2\r\nE0,06/08/2005,,A,C,1,1,H,x,9\r\nE1,06/08/2005,,A,C,1,1,H,x,9\r\n".encode())
    x = wide.read_wide(spark, str(tmp_path / "a.csv"))
    x = x.withColumn("reason", wide.first_reason(F.col("cells"), F.col("fits"), "main", "E0"))
    rows = x.orderBy("line").collect()
    assert [r.reason for r in rows] == [None, None, "date", "width", "result", "division"]
    assert rows[0].cells["XH"] == "1.5" and rows[0].cells["Div"] == "E0"
    prices = wide.unpivot_odds(x.where("reason is null"), ["line"], ("X",)).orderBy("line").collect()
    assert [(p.book, p.outcome, p.phase, p.price, p.valid) for p in prices] == [("X", "H", "pre", 1.5, True), ("X", "H", "pre", None, False)]


def test_wide_reader_of_old_files(spark, tmp_path):
    """Latin-1 files, quoted cells, and more than ten thousand surplus cells."""
    (tmp_path / "l.csv").write_bytes("Div,HomeTeam,AwayTeam\nSP1,Málaga,\"A, \"\"B\"\"\"\n".encode("latin-1") + b"SP1,A,B" + b"," * 10_500 + b"\nSP1,A,B" + b"," * 10_500 + b"x\n")
    (tmp_path / "u.csv").write_bytes("\ufeffDiv,HomeTeam,AwayTeam\nSP1,Málaga,B\n".encode())
    rows = wide.read_wide(spark, str(tmp_path)).orderBy("file", "line").collect()
    assert [(r.cells["HomeTeam"], r.cells["AwayTeam"], r.fits) for r in rows] == [("Málaga", 'A, "B"', True), ("A", "B", True), ("A", "B", False), ("Málaga", "B", True)]
    assert rows[3].cells["Div"] == "SP1"


def test_dates(spark):
    x = spark.createDataFrame([("01/02/69",), ("01/02/68",), ("1/2/2000",), ("30/02/2000",), ("",)], "t string")
    assert [str(r.d) for r in x.select(wide.parse_date(F.col("t")).alias("d")).collect()] == ["1969-02-01", "2068-02-01", "None", "None", "None"]


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>a</title><link>u</link><pubDate>Mon, 02 Mar 2026 10:00:00 +0300</pubDate></item><item><title>b</title><link>v</link></item></channel></rss>")
    rows = documents.read_feed(spark, str(tmp_path / "r.xml")).orderBy("link").collect()
    assert [(r.link, r.is_source_provided) for r in rows] == [("u", True), ("v", False)] and str(rows[0].claimed) == "2026-03-02 07:00:00"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>u</loc><lastmod>2026-03-02T10:00:00+03:00</lastmod></url></urlset>")
    assert documents.read_sitemap(spark, str(tmp_path / "s.xml")).count() == 1
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>u</loc></sitemap></sitemapindex>")
    (tmp_path / "n.xml").write_text("<urlset><url><loc>u</loc></url></urlset>")
    for bad in ("i.xml", "n.xml"):
        with pytest.raises(ValueError):
            documents.read_sitemap(spark, str(tmp_path / bad))


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.append(rows, path, ["k"]).count() == 2
    assert sinks.append(rows.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"]).count() == 3


def test_changed_files_and_log(spark):
    f = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2")), ("r", None)], "path string, content binary").withColumn("at", F.lit(1))
    current = sinks.attempt_log(f).where("path = 'p'")
    assert [r.path for r in sinks.changed_files(f.where("content is not null"), current).collect()] == ["q"]
    assert sinks.attempt_log(f).where("sha is null").count() == 1


def test_names(spark):
    x = spark.createDataFrame([("Gaziantep F.K.", "gaziantep fk"), ("İstanbulspor", "Istanbulspor"), ("Beşiktaş", "Beşiktaş")], "a string, b string")
    assert all(r.a == r.b for r in x.select(T.normalise_team(F.col("a")).alias("a"), T.normalise_team(F.col("b")).alias("b")).collect())
    s = spark.createDataFrame([("Beşiktaş JK", "Newell's"), ("?!", None)], "a string, b string").select(T.slug(F.col("a")).alias("a"), T.slug(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in s] == [("besiktas-jk", "newells"), (None, None)]
    names = {"Śląsk Wrocław": "slask-wroclaw", "Bodø/Glimt": "bodo-glimt", "Šibenik Čakovec": "sibenik-cakovec", "Großaspach": "grossaspach", "Győr Újpest": "gyor-ujpest", "Đakovo Ærø": "dakovo-aero", "Dinamo Ţăndărei": "dinamo-tandarei", "e\u0301cole": "ecole"}
    got = spark.createDataFrame([(k,) for k in names], "a string").select("a", T.slug(F.col("a")).alias("s")).collect()
    assert {r.a: r.s for r in got} == names
    same = spark.createDataFrame([("Besi\u0307ktas\u0327", "École FC"), ("E\u0301cole FC", "École FC")], "a string, b string").select(T.normalise_team(F.col("a")).alias("a"), T.normalise_team(F.col("b")).alias("b")).collect()
    assert same[1].a == same[1].b


def test_guard(spark):
    x = spark.createDataFrame([("dev",), ("holdout",)], "period string")
    log = spark.createDataFrame([("t1",)], "token string")
    assert guarded(x, "period", ["dev"]).count() == 1 and guarded(x, "period", ["holdout"], log, "t1").count() == 1
    with pytest.raises(PermissionError):
        guarded(x, "period", ["holdout"], log, "other")
    with pytest.raises(ValueError):
        guarded(x, "period", ["later"])


MATCHES = "match_id long, grp int, match_date date, home long, away long, home_goals int, away_goals int"


def _matches(spark, n=240):
    return spark.sql(f"select id as match_id, cast(id % 2 as int) grp, date_add(date '2000-01-01', cast(id div 4 as int)) match_date, id % 6 home, (id + 1 + id % 5) % 6 away, cast((id * 7) % 4 as int) home_goals, cast((id * 5) % 3 as int) away_goals from range({n})").where("home <> away")


def test_elo_is_zero_sum_and_blind_to_the_future(spark):
    m = _matches(spark)
    run = lambda x: {r.match_id: (r.rh, r.ra) for r in replay(x, lambda: Elo(newcomer=0.0, regress=0.0), ["rh", "ra", "e"]).collect()}
    full, part = run(m), run(m.where("match_date < date '2000-02-01'"))
    assert part and all(full[k] == v for k, v in part.items())
    elo = Elo(newcomer=0.0)
    for r in m.where("grp = 0").orderBy("match_date", "match_id").collect():
        elo.observe(r)
    assert abs(sum(elo.ratings.values()) - 1500 * len(elo.ratings)) < 1e-6


def test_goal_fit_settles_and_sees_only_the_past(spark):
    m = _matches(spark)
    days = spark.sql("select g grp, date '2000-02-20' fit_day from (select explode(array(0, 1)) g)")
    a = {(r.grp, r.team): (round(r.attack, 5), round(r.rho, 5)) for r in fit_strengths(m, days).collect()}
    b = {(r.grp, r.team): (round(r.attack, 5), round(r.rho, 5)) for r in fit_strengths(m.where("match_date < date '2000-02-20'"), days).collect()}
    assert len(a) > 4 and a == b and all(abs(v[1]) <= 0.2 for v in a.values())


def test_calibration_of_calibrated_forecasts(spark):
    x = spark.sql("select 'a' k, p, cast(j < p * 100 as int) hit from (select explode(array(0.1D, 0.3D, 0.6D, 0.9D)) p), (select id j from range(100)) union all select 'b', 0.5D, 1 from range(10)")
    rows = {r.k: r for r in calibration(x, ["k"]).collect()}
    assert abs(rows["a"].slope - 1) < 0.05 and abs(rows["a"].intercept) < 0.05 and rows["a"].measurable
    assert rows["b"].slope is None and not rows["b"].measurable


def test_stream_breaker_and_ratings_equal_loops(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    state, want, rating, rated = {}, set(), {}, {}
    for r in ev:
        n, until = state.get(r.user_id, (0, 0.0))
        n = n + 1 if r.event_type == "error" else 0
        now = r.ts.timestamp()
        if n >= 3 and now >= until:
            until = now + 3600
            want.add(r.event_id)
        state[r.user_id] = (n, until)
        rated[r.event_id] = rating.get(r.user_id, 0.0)
        rating[r.user_id] = rated[r.event_id] + 0.1 * (r.value - rated[r.event_id])
    assert {r.event_id for r in plans.queries()["t8_breaker"](spark, SF).collect()} == want
    got = {r.event_id: r.rating for r in plans.queries()["t6_stream_ratings"](spark, SF).collect()}
    assert got.keys() == rated.keys() and all(abs(got[k] - v) < 1e-5 for k, v in rated.items())
