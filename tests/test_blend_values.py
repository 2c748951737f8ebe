"""Blends and the reports over them, worked out again from the collected forecasts."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens import plans
from pricelens.functions import timeaxis as T
from pricelens.operators.lineage import cut
from pricelens.plans import models as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return cut(M.members(spark, SF))


@pytest.fixture(scope="module")
def rows(table):
    return [r.asDict() for r in table.collect()]


@pytest.fixture(autouse=True)
def shared(table, monkeypatch):
    """The queries read the forecasts that were made once."""
    monkeypatch.setattr(M, "members", lambda spark, sf: table)


def loss(p, y):
    return -math.log(max(p[y], 1e-15))


def pooled(r, w):
    logs = np.array([sum(v * math.log(max(r[c][k], 1e-15)) for v, c in zip(w, M.BLEND, strict=True)) for k in range(3)])
    p = np.exp(logs - logs.max())
    return p / p.sum()


def zone(day, name="final"):
    return next((z for z, a, b in T.zone_rows(name) if a <= day <= b), None)


def test_forecasts_are_distributions(rows):
    assert len(rows) > 300 and all(abs(sum(r[c]) - 1) < 1e-9 and min(r[c]) >= 0 for r in rows for c in M.STRATEGIES)


def test_component_rows(spark, rows):
    want = defaultdict(list)
    for r in rows:
        for s in M.STRATEGIES:
            want[r["league"], r["season"], s].append(loss(r[s], r["y"]))
    got = {(r.league, r.season, r.strategy): r for r in plans.queries()["m15_component_rows"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k].n == len(v) and abs(got[k].log_loss - np.mean(v)) < 1e-5 for k, v in want.items())


def test_pool_weights_are_a_maximum(table, rows, monkeypatch):
    monkeypatch.setattr(M, "MIN_ROWS", 50)
    fitted = M.fit_pool(table, ["league"], list(M.BLEND))
    assert fitted
    rng = np.random.default_rng(0)
    for (league,), w in fitted.items():
        mine = [r for r in rows if r["league"] == league]
        total = lambda v, mine=mine: np.mean([loss(pooled(r, v), r["y"]) for r in mine])
        best = total(w)
        assert all(total(np.clip(np.array(w) + rng.normal(size=3) * s, 0, M.WEIGHT_LIMIT)) >= best - 1e-9 for s in (0.01, 0.1, 0.5) for _ in range(4))


def test_frozen_weights_fall_back_with_a_reason(spark, table, rows, monkeypatch):
    e = [r for r in rows if zone(r["match_date"]) == "E"]
    count = {lg: sum(r["league"] == lg for r in e) for lg in {r["league"] for r in e}}
    least = sorted(count.values())[len(count) // 2]
    monkeypatch.setattr(M, "MIN_ROWS", 20)
    zoned = M.in_zone(table, "E")
    pool = M.fit_pool(zoned.withColumn("one", F.lit("all")), ["one"], list(M.BLEND))[("all",)]
    for r in M.frozen(spark, zoned, least).collect():
        assert r.n == count[r.league] and (r.fallback == "few_rows") == (r.n < least)
        assert r.fallback is None or np.allclose([r[f"w_{c}"] for c in M.BLEND], pool, atol=1e-5)
    monkeypatch.setattr(M, "MIN_ROWS", 10_000)
    assert {r.fallback for r in M.frozen(spark, zoned, 0).collect()} == {"not_fitted"}  # and no league has weights


@pytest.mark.parametrize(("name", "zoning"), [("m16_final_evaluation", "final"), ("m16_rehearsal", "rehearsal")])
def test_final_evaluation(spark, table, rows, monkeypatch, name, zoning):
    monkeypatch.setattr(M, "MIN_ROWS", 20)
    w = {r.league: [r[f"w_{c}"] for c in M.BLEND] for r in M.frozen(spark, cut(M.in_zone(table, "E", zoning))).collect()}
    gaps = defaultdict(list)
    for r in rows:
        if zone(r["match_date"], zoning) in ("holdout", "post"):
            gaps[zone(r["match_date"], zoning)].append(loss(pooled(r, w[r["league"]]), r["y"]) - loss(r["m0"], r["y"]))
    clvs = defaultdict(list)
    for r in M.placebo_clv(spark, SF).collect():
        if r.clv is not None and zone(r.match_date, zoning) in ("holdout", "post"):
            clvs[zone(r.match_date, zoning)].append(r.clv)
    got = {(r.zone, r.measure): r for r in plans.queries()[name](spark, SF).collect()}
    want = {(z, "blend_gap"): v for z, v in gaps.items()} | {(z, "placebo_clv"): v for z, v in clvs.items()}
    assert got.keys() == want.keys() and ("post", "blend_gap") in got if zoning == "final" else ("holdout", "blend_gap") in got
    for k, v in want.items():
        assert got[k].n == len(v) and abs(got[k].estimate - np.mean(v)) < 2e-5 and got[k].low <= got[k].estimate <= got[k].high


def test_shadow_rows_are_those_of_live_decisions(spark, rows):
    live = {r.match_id for r in M.live_status(spark, SF).where("status = 'decision'").collect()}
    want = {(r["match_id"], s) for r in rows if r["match_id"] in live for s in M.STRATEGIES}
    got = plans.queries()["m19_shadow_rows"](spark, SF).collect()
    assert {(r.match_id, r.strategy) for r in got} == want and len(got) == len(want) > 0


def test_checks_that_cannot_be_measured_do_not_pass(spark, table, rows, monkeypatch):
    got = {r.check: r for r in plans.queries()["m20_check_registry"](spark, SF).collect()}
    e, s = ([r for r in rows if zone(r["match_date"]) == z] for z in "ES")
    share = [np.mean([r["y"] == k for r in s]) for k in range(3)]
    goals = np.mean([loss(r["goals"], r["y"]) - loss(share, r["y"]) for r in e])
    assert abs(got["goals_beat_base_rates"].detail - goals) < 2e-5 and got["goals_beat_base_rates"].passed == (goals < 0)
    assert got["blend_not_worse"].passed == (got["blend_not_worse"].detail <= 0.001) and [r.gate for r in got.values()] == [True, True, True, False]
    monkeypatch.setattr(M, "members", lambda spark, sf: table.limit(0))
    none = plans.queries()["m20_check_registry"](spark, SF).collect()
    assert len(none) == 4 and not any(r.passed for r in none) and all(r.detail is None for r in none)


def test_walkforward_scores(spark, rows):
    got = {r.strategy: r for r in plans.queries()["a23_walkforward_scores"](spark, SF).collect()}
    e = [r for r in rows if zone(r["match_date"]) == "E"]
    for s in M.STRATEGIES:
        assert got[s].n == len(e) and abs(got[s].log_loss - np.mean([loss(r[s], r["y"]) for r in e])) < 2e-6
        found = []
        for r in e:
            edges = [p * o - 1 for p, o in zip(r[s], r["pre"], strict=True)]
            pick = int(np.argmax(edges))
            if edges[pick] > 0.02 and r["closing"] is not None:
                found.append(r["pre"][pick] * r["closing"][pick] - 1)
        assert got[s].bets == len(found) and (not found or abs(got[s].clv - np.mean(found)) < 2e-6)
    assert got["blend"].n == len(e)


def test_gap_penalty(spark):
    got = {r.component: r for r in plans.queries()["a39_gap_penalty"](spark, SF).collect()}
    m = M.kickoffs(spark, SF)
    ids = lambda x: {r.match_id for r in x.where("year(match_date) = 1997 and expected is not null").select("match_id").collect()}
    assert got["elo"].penalty_n == len(ids(M.rated(m)) & ids(M.rated(m.where("season <> 1996"))))
    assert got["elo"].penalty_low <= got["elo"].penalty <= got["elo"].penalty_high and got["goals"].penalty_n > 0 and got["goals"].penalty != got["elo"].penalty
