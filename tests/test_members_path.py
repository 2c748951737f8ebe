"""A match's forecasts are made in one path, without a join by match."""

from pricelens.plans import models as M

SF = "/root/testdata/sf0.001"


def test_members_meet_in_one_path(spark):
    plan = M.members(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and plan.count("MapInPandas") == 1
    assert not [line for line in plan.splitlines() if "Join " in line and "match_id" in line]
