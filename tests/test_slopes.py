"""The draws of calibration slopes against a fit of each draw over all rows."""

import numpy as np
import pytest

from pricelens.operators import slopes as O
from pricelens.operators.intervals import halves, weights
from pyspark.sql import functions as F

KINDS = "match_id long, league string, p array<double>, y int"


def one_fit(x, y, w):
    """A logistic regression by Newton steps; none for a constant sample or without settling."""
    if not 0 < (w * y).sum() < w.sum():
        return None
    a, b = 0.0, 1.0
    with np.errstate(all="ignore"):
        for _ in range(25):
            q = 1 / (1 + np.exp(-(a + b * x)))
            g, v = w * (y - q), w * q * (1 - q)
            det = v.sum() * (v * x * x).sum() - (v * x).sum() ** 2
            if not det > 1e-12:
                return None
            da, db = ((v * x * x).sum() * g.sum() - (v * x).sum() * (g * x).sum()) / det, (v.sum() * (g * x).sum() - (v * x).sum() * g.sum()) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-10:
                return round(b, 6)
    return None


def sample(rng, prices, n):
    sets = rng.dirichlet((4, 3, 3), prices)
    out = []
    for i in range(n):
        p = sets[rng.integers(prices)]
        out.append((i, [None, "a", "b"][i % 3], [float(v) for v in p], int(rng.choice(3, p=p))))
    return [*out, (n, "few", [0.5, 0.3, 0.2], 0), (n + 1, "few", [0.5, 0.3, 0.2], 1)]


# Few prices that repeat; prices that don't, more than a task holds at once.
@pytest.mark.parametrize("prices", [5, 10_000])
def test_draws_equal_single_fits(spark, monkeypatch, prices):
    monkeypatch.setattr(O, "HELD", 20)
    rows = sample(np.random.default_rng(prices), prices, 400)
    x = spark.createDataFrame(rows, KINDS)
    h1, h2 = halves(F.col("match_id"))
    hashed = {r.match_id: (r.a, r.b) for r in x.select("match_id", h1.alias("a"), h2.alias("b")).collect()}
    got: dict = {}
    for r in O.slope_draws(x, "league", F.col("p"), F.col("y"), draws=40).collect():
        got.setdefault(r.league, []).append(r.slope)
    for league in (None, "a", "b", "few"):
        own = [r for r in rows if r[1] == league]
        w = weights(*(np.array([hashed[r[0]][k] for r in own]) for k in (0, 1)), range(40)).astype(float)
        p = np.clip(np.array([r[2] for r in own]), 1e-6, 1 - 1e-6)
        hit = np.array([r[3] for r in own])[:, None] == np.arange(3)
        want = [one_fit(np.log(p / (1 - p)).ravel(), hit.ravel().astype(float), np.repeat(v, 3)) for v in w]
        assert got[league] == [v if v is None else pytest.approx(v, abs=1.1e-6) for v in want]


def test_rows_of_a_price_set_meet(spark):
    """What a step reads grows with price sets, not with rows: a task once held all rows of a league."""
    rows = sample(np.random.default_rng(1), 5, 3000)
    h1, h2 = halves(F.col("match_id"))
    x = spark.createDataFrame(rows, KINDS).select(F.col("league").alias("k"), h1.alias("h1"), h2.alias("h2"), "p", "y")
    sets = O.weighed(x, 8).collect()
    assert len(sets) <= (3 * 5 * 3 + 2) * O.PARTS
    h = x.collect()
    assert sum(np.frombuffer(r.w, np.int32).sum() for r in sets) == weights(np.array([r.h1 for r in h]), np.array([r.h2 for r in h]), range(8)).sum(dtype=int)
