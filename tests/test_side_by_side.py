"""Prices of a match side by side: the same as from its long rows, and nothing is brought together by match."""

import pytest

from pricelens import plans
from pricelens.fixtures import by_book, odds, side_by_side

SF = "/root/testdata/sf0.001"


def test_prices_are_those_of_the_long_rows(spark):
    long = {(r.match_id, r.book, r.phase): r.o for r in odds(spark, SF).collect()}
    got = by_book(spark, SF).collect()
    assert 2 * len(got) == len(long) and all(r.pre == long[r.match_id, r.book, 0] and r.close == long[r.match_id, r.book, 1] for r in got)
    assert all(r.a == long[r.match_id, 0, 0] and r.b == long[r.match_id, 2, 1] for r in side_by_side(spark, SF, a=(0, 0), b=(2, 1)).collect())


@pytest.mark.parametrize("name", ["a7_clv", "d12_loglinear_pool", "a32_record_mismatches", "d7_closing_last_value"])
def test_no_grouping(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_both_phases_losses_stand_side_by_side(spark):
    """A match's losses aren't brought together by match: the plan deals rows by nothing but the draws' keys, and a key's
    rows stay together, so that it is weighed once."""
    from pricelens.plans import metrics

    x = metrics._two(spark, SF)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "match_id" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    y = metrics.scored(spark, SF).groupBy("match_id", "book", "league", "season").pivot("phase", [0, 1]).agg({"ll": "max"}).dropna()
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 12), round(r[5], 12))
    assert sorted(map(key, x.select("match_id", "book", "league", "season", "pre", "close").collect())) == sorted(map(key, y.collect()))
