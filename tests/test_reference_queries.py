"""Every registered query with SQL gives what its SQL gives; loops and invariants for the others."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pricelens import plans
from pricelens.functions import prices as P
from pricelens.functions import timeaxis as T
from pricelens.plans.ledger import build_chain, lines, verify_chain
from pricelens.plans.timeaxis import kickoffs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(row):
    return tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({plans.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(_norm, got.select(*cols).collect())) == sorted(map(_norm, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_devig_properties(spark):
    rows = spark.createDataFrame([([2.0, 4.0, 4.0],), ([2.1, 3.4, 3.6],), ([1.25, 10.0, 10.0],), ([2.0, None, 4.0],), ([1.0, 3.0, 3.0],), ([5.0, 5.0, 5.0],)], "o array<double>")
    for m in P.METHODS:
        out = [r.p for r in rows.select(P.devig(F.col("o"), m).alias("p")).collect()]
        assert out[3] is out[4] is out[5] is None
        assert all(abs(sum(p) - 1) < 1e-9 and all(a > b or abs(a - b) < 1e-12 for a, b in zip(p, p[1:], strict=False)) for p in out[:3])
        assert out[0] == [0.5, 0.25, 0.25]
    with pytest.raises(ValueError):
        P.devig(F.col("o"), "other")


def test_tampered_chain_is_found(spark):
    chain = build_chain(lines(spark, SF))
    assert verify_chain(chain).where("first_bad is not null").count() == 0
    bad = chain.withColumn("line", F.when(F.col("event_id") == 500, "changed").otherwise(F.col("line")))
    assert [r.first_bad for r in verify_chain(bad).where("first_bad is not null").collect()] == ["500"]
    gone = chain.where("event_id <> 321")
    assert [r.first_bad for r in verify_chain(gone).where("first_bad is not null").collect()] == ["322"]


def test_ratings_equal_a_loop_over_events(spark):
    """Decisions see just the results known before them, in the order of instants; ratings from first principles."""
    at = lambda c: F.unix_timestamp(c)
    day, kick = F.col("match_date"), F.col("kickoff")
    rows = [r.asDict() for r in kickoffs(spark, SF).withColumns({"start": at("kickoff"), "asked": at(T.decision_at(day, kick)), "known": at(T.result_known_at(day, kick))}).collect()]
    want, blind = {}, 0
    for g in {r["grp"] for r in rows}:
        mine = sorted((r for r in rows if r["grp"] == g), key=lambda r: (r["match_date"], r["start"] if r["start"] is not None else -math.inf, r["match_id"]))
        events = sorted([(r["asked"], 0, i) for i, r in enumerate(mine) if r["asked"] is not None] + [(r["known"], 1, i) for i, r in enumerate(mine)])
        rating, last = {}, {}

        def now(team, day, rating=rating, last=last):
            mean = sum(rating.values()) / len(rating) if rating else 1500.0
            if team not in rating:
                return mean - 50.0
            return rating[team] + (0.2 * (mean - rating[team]) if (day - last[team]).days > 60 else 0.0)

        for _, kind, i in events:
            r = mine[i]
            h, a = now(r["home"], r["match_date"]), now(r["away"], r["match_date"])
            e = 1 / (1 + 10 ** ((a - h - 60.0) / 400))
            if kind == 0:
                want[r["match_id"]] = (h, a, e)
                blind += any(x["match_date"] < r["match_date"] and x["known"] > r["asked"] for x in mine)
                continue
            gap = r["home_goals"] - r["away_goals"]
            move = 20.0 * (1 + math.log(max(abs(gap), 1))) * ((gap > 0) + 0.5 * (gap == 0) - e)
            rating[r["home"]], rating[r["away"]] = h + move, a - move
            last[r["home"]] = last[r["away"]] = r["match_date"]
    got = {r.match_id: (r.r_home, r.r_away, r.expected) for r in plans.queries()["m2_elo_ratings"](spark, SF).collect()}
    assert blind and got.keys() == want.keys() and len(got) < len(rows)
    assert all(abs(x - y) < 2e-6 for k, v in want.items() for x, y in zip(v, got[k], strict=True))
    counts = plans.queries()["m1_replay_counts"](spark, SF).agg(F.sum("decisions"), F.sum("no_decision"), F.sum("no_prediction")).first()
    assert tuple(counts) == (len(want), len(rows) - len(want), 0)


def test_three_way_solvers_equal_the_general_ones(spark):
    """Also for wide margins and long odds; rows that ``priced`` refuses have no general solution either."""
    rows = [(1.5, 4.0, 7.0), (1.01, 21.0, 101.0), (1.2, 1.3, 1.4), (2.0, 4.0, 4.0), (1.9, 3.2, 4.1), (9.0, 9.0, 9.0), (None, 3.0, 2.0), (1.0, 3.0, 9.0), (float("nan"), 3.0, 2.0)]
    x = spark.createDataFrame(rows, "h double, d double, a double").withColumn("o", F.array("h", "d", "a"))
    for m in P.METHODS:
        want = {r.h: r.p for r in x.select("h", P.devig(F.col("o"), m).alias("p")).where("p is not null").collect()}
        got = {r.h: r.p for r in P.with_fair(P.priced(x), m).collect() if r.p is not None}
        assert got.keys() == want.keys() and len(want) >= 4
        assert all(abs(u - v) < 1e-9 for h in want for u, v in zip(got[h], want[h], strict=True))
