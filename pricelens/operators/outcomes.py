"""Fits of the parameters that turn a rating's home expectation into outcome probabilities, for many candidates at once.

A step is one aggregation: sums of slope and expected curvature a candidate come to the driver, where two by two systems
are solved. Candidates are a bounded grid; rows never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import FLOOR
from .replay import ordered_draw, quadratic_draw

# Bounds of the draw rate, of the ordered form's scale and cut, and where the fits start.
DRAW_BOUNDS, SCALE_BOUNDS, CUT_BOUNDS = (0.0, 0.5), (0.05, 5.0), (1e-3, 3.0)
STARTS = {"quadratic": (0.26,), "ordered": (1.0, 0.53)}
BOUNDS = {"quadratic": (DRAW_BOUNDS,), "ordered": (SCALE_BOUNDS, CUT_BOUNDS)}
STEPS, CLIP, MOST = 40, 1e-6, 10_000


def probabilities(form: str, e: Column, first: Column, second: Column) -> Column:
    """(home, draw, away) of either form; the quadratic one has no second parameter."""
    return ordered_draw(e, first, second, CLIP) if form == "ordered" else quadratic_draw(e, first)


def _slopes(form: str, e: Column, first: Column, second: Column) -> tuple[Column, list[Column]]:
    """The probabilities and their derivatives by each parameter, as arrays over outcomes."""
    p = probabilities(form, e, first, second)
    if form == "quadratic":
        tie = 4.0 * e * (1.0 - e)
        return p, [F.array(-tie / 2.0, tie, -tie / 2.0)]
    c = F.greatest(F.least(e, F.lit(1 - CLIP)), F.lit(CLIP))
    eta = F.log(c / (1.0 - c))
    h, a = F.get(p, 0) * (1.0 - F.get(p, 0)), F.get(p, 2) * (1.0 - F.get(p, 2))
    return p, [F.array(h * eta, -eta * (h - a), -a * eta), F.array(-h, h + a, -a)]


def fit_outcomes(rows: DataFrame, form: str, steps: int = STEPS) -> dict[int, tuple[tuple[float, ...], float, bool]]:
    """{candidate: (parameters, mean loss, settled)} with the least log loss within the bounds, from rows (candidate,
    expected, y). Steps by the exact curvature of the
    draw rate or the expected one of the ordered form; a step that raises a candidate's loss is halved."""
    spark, k = rows.sparkSession, len(STARTS[form])
    candidates = [r["candidate"] for r in rows.select("candidate").distinct().limit(MOST + 1).collect()]
    if len(candidates) > MOST:
        raise ValueError("too many candidates for a driver's step")
    at = {c: (np.array(STARTS[form]), np.zeros(k), np.inf) for c in candidates}  # best point, step tried from it, its loss
    done: dict[int, tuple[tuple[float, ...], float, bool]] = {}
    low, high = (np.array(b) for b in zip(*BOUNDS[form], strict=True))
    for _ in range(steps):
        tried = {c: np.clip(x + d, low, high) for c, (x, d, _) in at.items() if c not in done}
        if not tried:
            break
        grid = spark.createDataFrame([(c, float(v[0]), float(v[-1])) for c, v in tried.items()], "candidate int, _u double, _v double")
        x = rows.select("candidate", "expected", "y").join(F.broadcast(grid), "candidate")  # as many rows as candidates: bounded
        p, d = _slopes(form, F.col("expected"), F.col("_u"), F.col("_v"))
        x = x.select("candidate", "y", p.alias("p"), *[v.alias(f"d{i}") for i, v in enumerate(d)])
        floor = lambda v: F.greatest(v, F.lit(FLOOR))
        own = [F.avg(F.get(f"d{i}", "y") / floor(F.get("p", "y"))).alias(f"g{i}") for i in range(k)]
        if form == "quadratic":  # probabilities are linear in the draw rate: its curvature is known exactly
            own += [F.avg(F.pow(F.get("d0", "y") / floor(F.get("p", "y")), 2)).alias("h00")]
        else:
            own += [F.avg(sum((F.get(f"d{i}", o) * F.get(f"d{j}", o) / floor(F.get("p", o)) for o in range(3)), F.lit(0.0))).alias(f"h{i}{j}") for i in range(k) for j in range(i, k)]
        for r in x.groupBy("candidate").agg(F.avg(-F.log(floor(F.get("p", "y")))).alias("loss"), *own).collect():
            c = r["candidate"]
            point, step, best = at[c]
            if r["loss"] > best + 1e-12:
                at[c] = (point, step / 2, best)
                if np.abs(step).max() < 1e-9:
                    done[c] = (tuple(map(float, point)), best, True)
                continue
            new = tried[c]
            g = np.array([r[f"g{i}"] for i in range(k)])
            h = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-12 * np.eye(k)
            free = ~(((new <= low) & (g < 0)) | ((new >= high) & (g > 0)))
            step = np.zeros(k)
            if free.any():
                step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            at[c] = (new, step, r["loss"])
            if np.abs(np.clip(new + step, low, high) - new).max() < 1e-7:
                done[c] = (tuple(map(float, new)), r["loss"], True)
    return done | {c: (tuple(map(float, x)), float(v), False) for c, (x, _, v) in at.items() if c not in done}
