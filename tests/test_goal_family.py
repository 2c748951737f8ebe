"""Goal model, outcome parameters, zones, folds and blends against loops on small inputs."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens import plans
from pricelens.functions import timeaxis as T
from pricelens.operators import goals as G
from pricelens.operators.outcomes import fit_outcomes
from pricelens.plans import models as M

SF = "/root/testdata/sf0.001"


def _loss(args, ridge, attack, defence, edge, rho):
    """The penalised likelihood, a match at a time."""
    home, away, x, y, w, n = args
    total = 0.0
    for h, a, i, j, v in zip(home, away, x, y, w, strict=True):
        lam, mu = math.exp(attack[h] + defence[a] + edge), math.exp(attack[a] + defence[h])
        tau = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((i, j), 1.0)
        total += v * (math.log(tau) + i * math.log(lam) - lam + j * math.log(mu) - mu)
    return -total / sum(w) + ridge * (sum(v * v for v in attack) + sum(v * v for v in defence))


def test_fit_is_a_minimum():
    rng = np.random.default_rng(4)
    for seed in range(4):
        n, k = 5 + seed, 60 + 40 * seed
        home = rng.integers(0, n, k)
        away = (home + rng.integers(1, n, k)) % n
        args = home, away, rng.poisson(1.4, k).astype(float), rng.poisson(1.1, k).astype(float), np.exp(-0.001 * rng.integers(0, 900, k)), n
        attack, defence, edge, rho = G.fit_group(*args, 0.01)
        best = _loss(args, 0.01, attack, defence, edge, rho)
        for _ in range(40):
            d = rng.normal(size=2 * n + 2) * 1e-3
            assert _loss(args, 0.01, attack + d[:n], defence + d[n: 2 * n], edge + d[-2], min(max(rho + d[-1], -0.2), 0.2)) >= best - 1e-12
        warm = G.fit_group(*args, 0.01, (np.concatenate((attack, defence, [edge])), rho))
        assert np.allclose(warm[0], attack, atol=1e-6) and abs(warm[3] - rho) < 1e-6


def test_score_matrix_sums_its_cells(spark):
    rows = [(1.3, 0.9, -0.1), (0.4, 2.8, 0.15), (3.5, 3.1, 0.0), (2.4, 2.6, 0.2)]
    x = spark.createDataFrame(rows, "lam double, mu double, rho double")
    for r in x.withColumn("s", G.outcome_and_totals(F.col("lam"), F.col("mu"), F.col("rho"))).collect():
        cells = {}
        for i in range(11):
            for j in range(11):
                tau = {(0, 0): 1 - r.lam * r.mu * r.rho, (0, 1): 1 + r.lam * r.rho, (1, 0): 1 + r.mu * r.rho, (1, 1): 1 - r.rho}.get((i, j), 1.0)
                cells[i, j] = math.exp(-r.lam - r.mu) * r.lam**i * r.mu**j / math.factorial(i) / math.factorial(j) * max(tau, G.TAU_FLOOR)
        total = sum(cells.values())
        want = [sum(p for (i, j), p in cells.items() if c(i, j)) / total for c in (lambda i, j: i > j, lambda i, j: i == j, lambda i, j: i < j, lambda i, j: i + j > 2)]
        assert np.allclose([r.s.h, r.s.d, r.s.a, r.s.over], want, atol=1e-12)
    assert spark.range(1).select(G.outcome_and_totals(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)).alias("s")).first().s is None


def test_forecasts_rest_on_the_decision_day_s_fit(spark):
    """Of some matches: the fit again, from the matches before the decision day alone."""
    rows = [r.asDict() for r in M.asked(spark, SF).collect()]
    every = [r.asDict() for r in M.matches(spark, SF).collect()]
    got = {r.match_id: r for r in M.goal_forecasts(spark, SF).collect()}
    for r in [r for r in rows if r["match_id"] in got][::60]:
        day, grp = r["fit_day"], r["grp"]
        seen = [x for x in every if int(x["grp"]) == grp and 1 <= (day - x["match_date"]).days <= 1095]
        teams = sorted({t for x in seen for t in (x["home"], x["away"])})
        at = {t: k for k, t in enumerate(teams)}
        arrays = [np.array(v) for v in zip(*[(at[x["home"]], at[x["away"]], float(x["home_goals"]), float(x["away_goals"]), math.exp(-0.0019 * (day - x["match_date"]).days)) for x in seen], strict=True)]
        attack, defence, edge, rho = G.fit_group(arrays[0].astype(int), arrays[1].astype(int), *arrays[2:], len(teams), 0.01)
        f = got[r["match_id"]]
        assert abs(f.lam - math.exp(attack[at[r["home"]]] + defence[at[r["away"]]] + edge)) < 1e-5 and abs(f.mu - math.exp(attack[at[r["away"]]] + defence[at[r["home"]]])) < 1e-5
    left = [r for r in rows if r["match_id"] not in got]
    assert left and all(sum(int(x["grp"]) == r["grp"] and 1 <= (r["fit_day"] - x["match_date"]).days <= 1095 for x in every) < 30
                        or {r["home"], r["away"]} - {t for x in every if int(x["grp"]) == r["grp"] and 1 <= (r["fit_day"] - x["match_date"]).days <= 1095 for t in (x["home"], x["away"])} for r in left)


def test_outcome_parameters_equal_a_grid(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c, (s, cut) in enumerate(((0.8, 0.5), (1.4, 0.3), (0.2, 0.9))):
        for e in rng.uniform(0.1, 0.9, 500):
            eta = s * math.log(e / (1 - e))
            h, a = 1 / (1 + math.exp(cut - eta)), 1 / (1 + math.exp(cut + eta))
            rows.append((c, float(e), int(rng.choice(3, p=[h, 1 - h - a, a]))))
    x = spark.createDataFrame(rows, "candidate int, expected double, y int")
    for form in ("ordered", "quadratic"):
        got = fit_outcomes(x, form)
        for c in range(3):
            e, y = (np.array(v) for v in zip(*[(r[1], r[2]) for r in rows if r[0] == c], strict=True))

            def loss(u, v, form=form, e=e, y=y):
                eta = u * np.log(e / (1 - e))
                p = np.stack([e - 2 * u * e * (1 - e), 4 * u * e * (1 - e), 1 - e - 2 * u * e * (1 - e)]) if form == "quadratic" else np.stack([1 / (1 + np.exp(v - eta)), 1 - 1 / (1 + np.exp(v - eta)) - 1 / (1 + np.exp(v + eta)), 1 / (1 + np.exp(v + eta))])
                return -np.log(np.maximum(p[y, np.arange(len(y))], 1e-15)).mean()

            params, value, settled = got[c]
            assert settled and abs(value - loss(params[0], params[-1])) < 1e-9
            grid = [(u, v) for u in np.linspace(0.05, 2, 60) for v in np.linspace(0.01, 1.5, 60)] if form == "ordered" else [(u, 0) for u in np.linspace(0, 0.5, 500)]
            assert value <= min(loss(u, v) for u, v in grid) + 1e-9


def test_descent_measures_each_candidate_once_and_keeps_the_first():
    asked = []

    def losses(new):
        asked.extend(tuple(t.values()) for t in new)
        return [abs(t["a"] - 2) + (t["b"] == "x") * 0.0 for t in new]

    best, known = M.descend({"a": (1, 2, 3), "b": ("x", "y")}, {"a": 1, "b": "y"}, losses)
    assert best == {"a": 2, "b": "x"} and len(asked) == len(set(asked)) == len(known) == 4


def test_zonings():
    for zoning in ("development", "final", "rehearsal"):
        rows = sorted(T.zone_rows(zoning), key=lambda r: r[1])
        assert all(a[2] + timedelta(days=1) == b[1] for a, b in zip(rows, rows[1:], strict=False)) and all(a <= b for _, a, b in rows)
    assert ("holdout", date(2000, 1, 1), date(2000, 6, 30)) in T.zone_rows("rehearsal") and not any(z == "post" for z, *_ in T.zone_rows("rehearsal"))
    assert [z for z, *_ in T.zone_rows("rehearsal", (date(1998, 1, 1), date(1999, 1, 1)))] == ["S", "E", "E", "holdout"]
    for bad in ((date(1999, 1, 1), date(1999, 1, 1)), (date(2000, 1, 1), date(2002, 1, 1))):
        with pytest.raises(ValueError):
            T.zone_rows("rehearsal", bad)
    with pytest.raises(ValueError):
        T.zone_rows("other")


def test_folds_see_earlier_seasons_alone(spark, monkeypatch):
    """Training rows of each fold, read off by a stand-in for the fit that counts them."""
    rows = [(f"L{k % 3}", y, date(y, 1 + k % 12, 5), k % 3, [0.4, 0.3, 0.3], [0.5, 0.2, 0.3], [0.3, 0.3, 0.4]) for y in range(1996, 2002) for k in range(36)]
    x = spark.createDataFrame(rows, "league string, season int, match_date date, y int, m0 array<double>, elo array<double>, goals array<double>")

    def counted(t, keys, names):
        return {tuple(r[c] for c in keys): [float(r["count"]), 0.0, 0.0] for r in t.groupBy(*keys).count().collect()}

    monkeypatch.setattr(M, "fit_pool", counted)
    got = {(r.league, r.fold): r for r in M.fold_weights(spark, x, least=20).collect()}
    zone = {z: (a, b) for z, a, b in T.zone_rows("final")}
    inside = lambda d, z: zone[z][0] <= d <= zone[z][1]
    assert got.keys() == {(r[0], r[1]) for r in rows if inside(r[2], "E")}
    for (league, fold), r in got.items():
        count = lambda mine: sum(mine(x) and inside(x[2], "E") and x[1] < fold for x in rows) or sum(mine(x) and inside(x[2], "S") for x in rows)
        own = count(lambda x, league=league: x[0] == league)
        assert (r.n, r.kind) == (own, "league" if own >= 20 else "pooled") and r.w_m0 == (own if own >= 20 else count(lambda x: True))


@pytest.mark.parametrize("name", ["m13_coordinate_descent", "m13_goal_model_descent"])
def test_the_chosen_candidate_has_the_least_loss_of_its_last_search(spark, name):
    small = {"m13_coordinate_descent": ({"k": (10.0, 20.0), "form": ("quadratic", "ordered")}, M.ELO_START, M.coordinate_descent), "m13_goal_model_descent": ({"xi": (0.001, 0.003)}, M.GOAL_START, M.goal_model_descent)}
    grid, start, run = small[name]
    rows = run(spark, SF, grid, start).collect()
    assert sum(r.chosen for r in rows) == 1 and all(math.isfinite(r.log_loss) for r in rows)
    assert next(r.log_loss for r in rows if r.chosen) == min(r.log_loss for r in rows if name != "m13_coordinate_descent" or r.k == next(s.k for s in rows if s.chosen))
    assert plans.queries()[name]


def test_tiers_lie_to_the_median_and_the_better_one_counts(spark, monkeypatch):
    from pricelens.plans import reports as R
    from pricelens.plans.metrics import tiered

    rows = [("a", 0.5, 0.4, 0.6), ("b", 0.3, 0.1, 0.5), ("c", 0.1, 0.0, 0.2), ("d", 0.31, 0.305, 0.4), ("e", 0.2, 0.1, 0.29)]
    x = spark.createDataFrame(rows, "league string, gap double, low double, high double")
    assert {r.league: r.tier for r in tiered(x).collect()} == {"a": "A", "b": "B", "c": "C", "d": "A", "e": "C"}
    late = spark.createDataFrame([("a", 0.05, 0.04, 0.06, 1.5), ("b", 0.01, 0.0, 0.02, 0.9), ("c", None, None, None, 1.1)], "league string, late_info double, late_info_low double, late_info_high double, slope double")
    monkeypatch.setattr(R, "slope_interval", lambda spark, sf, before=None: spark.createDataFrame([("a", 1.05, 1.9), ("b", 0.85, 0.95), ("c", 1.05, 1.15)], "league string, low double, high double"))
    # Distances 0.5, 0.1, 0.1 with intervals from 0.05 to 0.9, 0.05 to 0.15, 0.05 to 0.15; the median is 0.1, late tiers A and C.
    got = {r.league: (r.late_tier, r.miss_tier, r.tier) for r in R.league_tiers(spark, SF, late).collect()}
    assert got == {"a": ("A", "B", "A"), "b": ("C", "B", "B"), "c": (None, "B", "B")}
