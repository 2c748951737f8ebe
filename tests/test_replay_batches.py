"""A replay walks over its group's events in batches and keeps a strategy's state between them."""

from datetime import date, datetime, timedelta

from pricelens.operators.replay import Elo, Elos, Scaffold, SeenResults, replay


def test_a_group_is_walked_in_batches(spark):
    rows = [(i, g, date(2000, 1, 3) + timedelta(days=3 * i), i % 4, (i + 1) % 4, i % 3, i % 2) for g in (1, 2, None) for i in range(40)]
    m = spark.createDataFrame(rows, "match_id long, grp int, match_date date, home int, away int, home_goals int, away_goals int")
    whole = {(r.grp, r.match_id): (r.r_home, r.r_away, r.e) for r in replay(m, Elo, ["r_home", "r_away", "e"]).collect()}
    seen = replay(m, SeenResults, ["n"])
    assert "FlatMapGroupsInPandas" not in seen._jdf.queryExecution().toString()  # a group's rows never meet in one frame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.grp, r.match_id): (r.r_home, r.r_away, r.e) for r in replay(m, Elo, ["r_home", "r_away", "e"]).collect()} == whole
        counts = {}
        for r in replay(m, SeenResults, ["n"]).collect():
            counts.setdefault(r.grp, []).append((r.match_id, r.n))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(counts) == {1, 2, None} and len(whole) == 120
    for got in counts.values():
        n = [v for _, v in sorted(got)]
        assert n == sorted(n) and n[0] == 0 and n[-1] >= 37


def test_events_taken_at_once_rate_as_one_by_one(spark):
    """Every margin, long gaps, newcomers, a team against itself, decisions after the kick-off: the very same numbers, and
    several ratings from one walk."""
    rows = [(i, g, date(2000, 1, 3) + timedelta(days=(3 if i % 9 else 80) * i), None if i % 4 else datetime(2000 + 20 * (i % 3 - 1), 1, 1), i % 5, i * 3 % 7, i % 4, i % 3) for g in (1, 2, None) for i in range(60)]
    m = spark.createDataFrame(rows, "match_id long, grp int, match_date date, kickoff timestamp, home int, away int, home_goals int, away_goals int")
    names = ["h", "a", "e"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        expected = []
        for make in (Elo, Scaffold, lambda: Elo(k=35.0, margin="log", regress=0.4), lambda: Elo(margin="linear", newcomer=0.0, home=90.0)):
            one = sorted(map(tuple, replay(m, make, names).collect()), key=str)
            assert sorted(map(tuple, replay(m, make, names, events=True).collect()), key=str) == one
            expected.append({r[:2]: r[-1] for r in one})
        assert any(e is None for e in expected[0].values()) and len(expected[0]) == 180
        configs = [{}, {"k": 35.0, "margin": "log", "regress": 0.4}]
        got = replay(m, lambda: Elos(configs), ["e0", "e1"], events=True).collect()
        assert {(r.grp, r.match_id): (r.e0, r.e1) for r in got} == {k: (expected[0][k], expected[2][k]) for k in expected[0]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
