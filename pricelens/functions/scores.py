"""Scores of probability arrays against an outcome index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import FLOOR, let, total


def log_loss(p: Column, y: Column) -> Column:
    return F.when(F.get(p, y).isNotNull(), -F.log(F.greatest(F.get(p, y), F.lit(FLOOR))))


def brier(p: Column, y: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)))


def rps(p: Column, y: Column) -> Column:
    """Ranked probability score: squared differences of the running sums over the number of outcomes less 1."""
    step = lambda s, x: let(s["c"] + x["p"] - F.when(x["i"] == y, 1.0).otherwise(0.0), lambda c: F.struct(c.alias("c"), (s["t"] + c * c).alias("t")))
    rows = F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i")))
    return F.aggregate(rows, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t")), step, lambda s: s["t"] / (F.size(p) - 1))


def valid(p: Column, y: Column, tolerance: float = 1e-9) -> Column:
    """Probabilities in [0, 1] that sum to 1, and an index inside."""
    return F.coalesce(F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total(p) - 1.0) <= tolerance) & y.between(0, F.size(p) - 1), F.lit(False))


def clv(price: Column, p_close: Column) -> Column:
    """Closing-line value; null outside the domain."""
    return F.when((price > 1) & p_close.between(0, 1), price * p_close - 1.0)


def outcome_index(home: Column, away: Column) -> Column:
    """0 home, 1 draw, 2 away."""
    return F.when(home > away, 0).when(home == away, 1).when(home < away, 2)


def over_index(home: Column, away: Column) -> Column:
    """0 over 2.5 goals, 1 under."""
    return F.when(home + away > 2.5, 0).when(home + away < 2.5, 1)
