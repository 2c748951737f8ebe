"""Bootstrap draws of a calibration slope: the Newton steps of all keys and draws at once, over rows that met by price.

A row's weights in the draws are those of ``intervals``. Rows of a key with the same probabilities and outcome have the
same share in every step, so their weights are added up first, to one array over the draws for each. A step is one pass
over these: a task holds seven sums a key and draw, whatever the rows; the driver holds two numbers a key and draw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import DRAWS, ROWS, SEED, TASKS, halves, weights
from .lineage import cut

#: Probabilities are clipped to this, Newton steps at most, price sets that a task adds up at once, parts that a price set
#: is dealt into, so that a frequent one is no task of its own, and price sets that a step weighs together.
CLIP, STEPS, HELD, PARTS, SETS = 1e-6, 25, 2048, 4, 64


def weighed(x: DataFrame, draws: int) -> DataFrame:
    """(k, p, y, w) from rows (k, h1, h2, p, y): the sums of the weights, 32-bit integers of all draws in their order.

    Price sets that a task couldn't hold at once, and parts of one set, are rows of their own."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told() -> pd.DataFrame:
            k, p, y = zip(*held, strict=True)
            return pd.DataFrame({"k": list(k), "p": [list(v) for v in p], "y": list(y), "w": [v.tobytes() for v in held.values()]})

        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at: at + ROWS]
                code: dict = {}
                labels = zip(some["k"], map(tuple, some["p"]), some["y"], strict=True)
                place = np.array([code.setdefault(label, len(code)) for label in labels])
                order = np.argsort(place, kind="stable")
                w = weights(some["h1"].to_numpy()[order], some["h2"].to_numpy()[order], range(draws))
                sums = np.add.reduceat(w, np.searchsorted(place[order], np.arange(len(code))), axis=1, dtype=np.int32)
                for label, j in code.items():
                    held[label] = held[label] + sums[:, j] if label in held else sums[:, j].copy()
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    k = dict(x.dtypes)["k"]
    tasks = min(TASKS, 4 * x.sparkSession.sparkContext.defaultParallelism)  # dear rows: adaptive execution would put them into few tasks
    return x.repartition(tasks, "k", "p", "y", F.col("h1") % PARTS).mapInPandas(add, f"k {k}, p array<double>, y int, w binary")


def _step(sets: DataFrame, state: dict, draws: int) -> dict:
    """The sums of a step for every key: gradient (2), information (3), weight and, of one row a match, hits."""
    known = sets.sparkSession.sparkContext.broadcast(state)

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for label, own in pdf.groupby(pdf["k"].map(lambda v: (v,)), sort=False):  # in a tuple, as a key may be null
                a, b = known.value.get(label[0], (np.zeros(draws), np.ones(draws)))
                acc = held.setdefault(label[0], np.zeros((7, draws)))
                for at in range(0, len(own), SETS):
                    some = own.iloc[at: at + SETS]
                    n = np.stack([np.frombuffer(v, np.int32) for v in some["w"]]).astype(float)
                    p, y = np.clip(np.stack(some["p"].to_list()), CLIP, 1 - CLIP), some["y"].to_numpy()
                    for i in range(p.shape[1]):
                        x = np.log(p[:, i] / (1 - p[:, i]))[:, None]
                        q, hit = 1 / (1 + np.exp(-(a + b * x))), (y == i)[:, None]
                        v, g = n * q * (1 - q), n * (hit - q)
                        acc += np.stack([g.sum(0), (g * x).sum(0), v.sum(0), (v * x).sum(0), (v * x * x).sum(0), n.sum(0), (n * hit).sum(0)])
        for label, acc in held.items():
            yield pd.DataFrame({"k": [label], "s": [acc.ravel()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "s": [np.sum(np.stack(pdf["s"].to_list()), axis=0)]})

    kind = f"k {dict(sets.dtypes)['k']}, s array<double>"
    found = {r["k"]: np.array(r["s"], float).reshape(7, draws) for r in sets.select("k", "p", "y", "w").mapInPandas(pass_over, kind).groupBy("k").applyInPandas(added, kind).collect()}
    known.unpersist()
    return found


def slope_draws(rows: DataFrame, group: str, p: Column, y: Column, key: str = "match_id", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(group, slope): of every group and draw the slope of a logistic regression of each outcome's coming on the logit of
    its probability, null where the sample is constant or the steps don't settle. ``p`` is an array, ``y`` an index in it."""
    h1, h2 = halves(F.col(key), seed)
    sets = cut(weighed(rows.select(F.col(group).alias("k"), h1.alias("h1"), h2.alias("h2"), p.alias("p"), y.cast("int").alias("y")), draws))
    state: dict = {}
    moves, whole = {}, {}
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            for k, (g0, g1, h00, h01, h11, n, hits) in _step(sets, state, draws).items():
                a, b = state.get(k, (np.zeros(draws), np.ones(draws)))
                det = np.where(h00 * h11 - h01 * h01 > 1e-12, h00 * h11 - h01 * h01, np.nan)
                da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
                state[k], moves[k], whole[k] = (a + da, b + db), np.abs(da) + np.abs(db), (hits > 0) & (hits < n)
            if not any((m >= 1e-10).any() for m in moves.values()):
                break
        out = [(k, None if np.isnan(v) else round(float(v), 6)) for k, (_, b) in state.items() for v in np.where(whole[k] & (moves[k] < 1e-8), b, np.nan)]
    return rows.sparkSession.createDataFrame(out, f"{group} {dict(rows.dtypes)[group]}, slope double")
