"""Margin removal and price arithmetic on arrays of decimal prices, in market order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("multiplicative", "power", "shin")
EVEN = 1e-12
FLOOR = 1e-15
STEPS = 14
SHIN_STEPS = 8
#: How far from 1 the probabilities of a solver that has settled may sum.
SETTLED = 1e-9


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def complete(prices: Column) -> Column:
    """Prices if all are known, finite and above 1, and there are two at least; else null."""
    ok = (F.size(prices) >= 2) & F.forall(prices, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 1) & (x < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), prices)


def inverses(prices: Column) -> Column:
    return F.transform(prices, lambda x: 1.0 / x)


def overround(prices: Column) -> Column:
    """Sum of inverse prices less 1; null for an incomplete set."""
    return total(inverses(complete(prices))) - 1.0


def _multiplicative(q: Column) -> Column:
    return let(total(q), lambda s: F.transform(q, lambda x: x / s))


def settled(p: Column) -> Column:
    """Probabilities that sum to 1; null for those of a solver that didn't settle."""
    return F.when(F.abs(total(p) - 1.0) <= SETTLED, p)


def _power(q: Column) -> Column:
    """Exponent with sum q^k = 1 by Newton steps from 1: the sum is convex and falls in k, so steps never pass it."""
    step = lambda k, _: k - (total(F.transform(q, lambda x: F.pow(x, k))) - 1.0) / total(F.transform(q, lambda x: F.pow(x, k) * F.log(x)))
    k = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(1.0), step)
    return let(let(k, lambda e: F.transform(q, lambda x: F.pow(x, e))), settled)


def shin_probability(q: Column, z: Column, book: Column) -> Column:
    return (F.sqrt(z * z + 4.0 * (1.0 - z) * q * q / book) - z) / (2.0 * (1.0 - z))


def _shin(q: Column) -> Column:
    """Insider share z in [0, 0.5) with probabilities summing to 1; null without one. With r the root of
    z^2 + 4 (1 - z) q^2 / book, the sum of r less 2 less (n - 2) z is zero there; Newton steps from 0."""

    def solved(book: Column) -> Column:
        def step(z: Column, _: Column) -> Column:
            root = lambda x: F.sqrt(z * z + 4.0 * (1.0 - z) * x * x / book)
            return let(F.transform(q, root), lambda r: z - (total(r) - 2.0 - (F.size(q) - 2) * z) / (total(F.zip_with(q, r, lambda x, y: (z - 2.0 * x * x / book) / y)) - (F.size(q) - 2)))

        z = F.aggregate(F.sequence(F.lit(1), F.lit(SHIN_STEPS)), F.lit(0.0), step)
        fair = lambda v: F.when((v >= 0) & (v < 0.5), F.transform(q, lambda x: shin_probability(x, v, book)))
        return let(let(z, fair), settled)

    return let(total(q), solved)


def devig(prices: Column, method: str) -> Column:
    """Fair probabilities; null for an incomplete set or one with a negative margin. An unknown method is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    rule = {"multiplicative": _multiplicative, "power": _power, "shin": _shin}[method]
    return let(inverses(complete(prices)), lambda q: let(total(q) - 1.0, lambda m: F.when(F.abs(m) <= EVEN, q).when(m > 0, rule(q))))


def priced(x: DataFrame, names=("h", "d", "a")) -> DataFrame:
    """Rows with all three prices above 1 and no negative margin, as plain conditions on the price columns."""
    ok = [F.col(n).isNotNull() & ~F.isnan(n) & (F.col(n) > 1) & (F.col(n) < float("inf")) for n in names]
    return x.where(ok[0] & ok[1] & ok[2] & (1.0 / F.col(names[0]) + 1.0 / F.col(names[1]) + 1.0 / F.col(names[2]) >= 1.0 - EVEN))


def with_fair(x: DataFrame, method: str, names=("h", "d", "a"), out: str = "p") -> DataFrame:
    """Three-way ``devig`` of price columns as an array column; null where the solver doesn't settle.

    A solver's steps are one loop within an expression over plain columns: unrolled, they would make a method too large
    for the JVM to compile. Filter the rows by ``priced`` before, not by the result after."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    keep, q, e = x.columns, [f"_q{i}" for i in range(3)], [f"_e{i}" for i in range(3)]
    c, add = F.col, lambda cols: F.col(cols[0]) + F.col(cols[1]) + F.col(cols[2])
    x = x.withColumns({a: 1.0 / c(n) for a, n in zip(q, names, strict=True)}).withColumn("_b", add(q))
    if method == "multiplicative":
        return x.select(*keep, F.array(*[c(a) / c("_b") for a in q]).alias(out))
    steps = lambda n, start, step: F.aggregate(F.array_repeat(F.lit(0), n), F.lit(start), lambda k, _: step(k))
    if method == "power":
        logs = [f"_l{i}" for i in range(3)]
        x = x.withColumns({a: F.log(c(b)) for a, b in zip(logs, q, strict=True)})

        def newton(k: Column) -> Column:
            up = [F.exp(k * c(a)) for a in logs]
            return k - (up[0] + up[1] + up[2] - 1.0) / (up[0] * c("_l0") + up[1] * c("_l1") + up[2] * c("_l2"))

        x = x.withColumn("_k", steps(STEPS, 1.0, newton)).withColumns({a: F.exp(c("_k") * c(b)) for a, b in zip(e, logs, strict=True)})
        ok = F.abs(add(e) - 1.0) <= SETTLED
        fair = [c(a) for a in e]
    else:
        x = x.withColumns({a: c(b) * c(b) / c("_b") for a, b in zip(e, q, strict=True)})

        def newton(z: Column) -> Column:
            root = [F.sqrt(z * z + 4.0 * (1.0 - z) * c(a)) for a in e]
            slope = sum(((z - 2.0 * c(a)) / r for a, r in zip(e, root, strict=True)), F.lit(-1.0))
            return z - (root[0] + root[1] + root[2] - 2.0 - z) / slope

        x = x.withColumn("_k", steps(SHIN_STEPS, 0.0, newton))
        x = x.withColumns({a: (F.sqrt(c("_k") * c("_k") + 4.0 * (1.0 - c("_k")) * c(a)) - c("_k")) / (2.0 * (1.0 - c("_k"))) for a in e})
        fair = [c(a) for a in e]
        ok = (c("_k") >= 0) & (c("_k") < 0.5) & (F.abs(add(e) - 1.0) <= SETTLED)
    even = F.abs(c("_b") - 1.0) <= EVEN
    return x.select(*keep, F.when(even, F.array(*q)).when(ok, F.array(*fair)).alias(out))


def reject_code(prices: Column) -> Column:
    """Why a set can't be devigged: missing, price or margin; null if it can."""
    missing = F.coalesce((F.size(prices) < 2) | F.exists(prices, lambda x: x.isNull()), F.lit(True))
    return F.when(missing, "missing").when(complete(prices).isNull(), "price").when(overround(prices) < -EVEN, "margin")


def pool(members: list[Column], weights: list[Column]) -> Column:
    """Log-linear pool of probability arrays with weights, floored and normalised."""

    def weighted(p: Column, w: Column) -> Column:
        return F.transform(p, lambda x: w * F.log(F.greatest(x, F.lit(FLOOR))))

    logs = weighted(members[0], weights[0])
    for m, w in zip(members[1:], weights[1:], strict=True):
        logs = F.zip_with(logs, weighted(m, w), lambda a, b: a + b)
    return let(logs, lambda s: let(F.array_max(s), lambda m: _multiplicative(F.transform(s, lambda x: F.exp(x - m)))))


def shift(p: Column, by: Column) -> Column:
    """Move home and away on the log scale by +by and -by and normalise; unchanged for 0."""
    logs = F.transform(p, lambda x, i: F.log(F.greatest(x, F.lit(FLOOR))) + F.when(i == 0, by).when(i == F.size(p) - 1, -by).otherwise(0.0))
    return F.when(by == 0, p).otherwise(let(logs, lambda s: let(F.array_max(s), lambda m: _multiplicative(F.transform(s, lambda x: F.exp(x - m))))))


def best_edge(p: Column, prices: Column) -> tuple[Column, Column]:
    """(edge, index from 0) of the largest p * price - 1; the first one wins."""
    edges = F.zip_with(p, prices, lambda a, b: a * b - 1.0)
    return F.array_max(edges), (F.array_position(edges, F.array_max(edges)) - 1).cast("int")
