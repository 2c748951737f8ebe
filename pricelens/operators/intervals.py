"""Bootstrap intervals of many means in one pass.

A row's weight in a draw is Poisson(1), a function of seed, key and draw alone: the key is hashed once, to two numbers of
32 bits, and each draw's number comes from them by arithmetic on whole arrays. So nothing is resampled, reruns agree, and
rows of one key always move together. Tasks hold, for every group they meet, an array of weighted sums over all draws
and measures; these arrays are added up group by group. Work grows with rows times draws, what is shuffled with tasks
times groups times draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed and draws, and the two percentiles.
SEED, DRAWS, BOUNDS = 20260922, 2000, (0.025, 0.975)
#: Multipliers of the mixing steps, and the number that a draw moves the first hash by.
MIX, STRIDE = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B9
#: Keys that are weighed together, groups that a task holds, draws that are weighed and added up together, tasks at most.
ROWS, HELD, BLOCK, TASKS = 1000, 256, 250, 1024
#: Groups are added up one by one where keys have a row in less than one group of so many.
FEW = 8


def _cuts() -> list[int]:
    """Where a 32-bit number's Poisson(1) weight goes from k to k + 1, for k up to 8."""
    total, p, out = 0.0, float(np.exp(-1.0)), []
    for k in range(1, 10):
        total, p = total + p, p / k
        out.append(int(total * 2**32))
    return out


CUTS = _cuts()


def halves(key: Column, seed: int = SEED) -> tuple[Column, Column]:
    """The two numbers of a key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _mix(x: np.ndarray, free: np.ndarray) -> None:
    """Mixes numbers where they are; ``free`` is an array of the same size to work in."""
    for shift, by in ((16, MIX[0]), (13, MIX[1]), (16, 1)):
        np.right_shift(x, np.uint32(shift), out=free)
        x ^= free
        if by > 1:
            x *= np.uint32(by)


def weights(first: np.ndarray, second: np.ndarray, draws) -> np.ndarray:
    """Weights of keys in some draws: an array of draws by keys."""
    with np.errstate(over="ignore"):
        x = first.astype(np.uint32)[None, :] + (np.asarray(draws, np.uint32) * np.uint32(STRIDE))[:, None]
        free = np.empty_like(x)
        _mix(x, free)
        x ^= second.astype(np.uint32)[None, :]
        _mix(x, free)
    out, hit = np.zeros(x.shape, np.uint8), np.empty(x.shape, bool)
    for c in CUTS:
        np.greater_equal(x, np.uint32(c), out=hit)
        out += hit.view(np.uint8)
    return out


def weights_sql(table: str, key: str, name: str = "wts", draws: int = DRAWS, seed: int = SEED) -> str:
    """The same weights as tables of a WITH clause, the last of them (key, draw, w)."""
    out = [f"{name}0 AS (SELECT {key}, h2, (h1 + draw * {STRIDE}) % 4294967296 AS x FROM (SELECT DISTINCT {key}, "
           f"""('0x' || substr(md5('{seed}|' || {key}::varchar), 1, 8))::ubigint AS h1, ('0x' || substr(md5('{seed}|' || {key}::varchar), 9,
    8))::ubigint AS h2 FROM {table}) t, (SELECT unnest(range({draws}))::ubigint AS draw) d)"""]
    out[0] = out[0].replace(f"SELECT {key}, h2,", f"SELECT {key}, draw::int AS draw, h2,", 1)
    k = 0
    for again in (False, True):
        start = "xor(x, h2)" if again else "x"
        for shift, by in ((16, MIX[0]), (13, MIX[1]), (16, 1)):
            out.append(f"""{name}{k + 1} AS (SELECT {key}, draw, h2, xor(x, x >> {shift}) * {by}::ubigint % 4294967296 AS x
    FROM (SELECT {key}, draw, h2, {start} AS x FROM {name}{k}) t)""")
            k, start = k + 1, "x"
    out.append(f"{name} AS (SELECT {key}, draw, ({' + '.join(f'(x >= {c})::int' for c in CUTS)}) AS w FROM {name}{k})")
    return ",\n".join(out)


def intervals_sql(rows: str, groups: str, measures: dict[str, str], key: str = "match_id", weights_table: str = "wts") -> str:
    """Select the columns that ``intervals`` gives from a table of rows and the weights."""
    by = ", ".join(str(k + 1) for k in range(len(groups.split(","))))
    means = ", ".join(f"sum(w * ({m}))::double / nullif(sum(w) FILTER (({m}) IS NOT NULL), 0) AS {n}" for n, m in measures.items())
    both = ", ".join(f"round(quantile_cont({n}, {q}), 6) AS {n}_{end}" for n in measures for q, end in zip(BOUNDS, ("low", "high"), strict=True))
    own = ", ".join(f"count({m}) AS {n}_n, round(avg({m}), 6) AS {n}" for n, m in measures.items())
    same = " AND ".join(f"e.{g.strip()} IS NOT DISTINCT FROM q.{g.strip()}" for g in groups.split(","))
    every = ", ".join([*(f"e.{g.strip()}" for g in groups.split(",")), *(f"{n}_n, e.{n}, {n}_low, {n}_high" for n in measures)])
    return f"""SELECT {every} FROM (SELECT {groups}, {own} FROM {rows} GROUP BY {by}) e
 JOIN (SELECT {groups}, {both} FROM (SELECT {groups}, draw, {means} FROM {rows} JOIN {weights_table} USING ({key}) GROUP BY {by}, draw) m GROUP BY {by}) q ON {same}"""


def intervals(rows: DataFrame, measures: dict[str, Column], key: str, groups: list[str], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(groups, and for each measure <name>_n, <name>, <name>_low, <name>_high): count, mean and percentile interval of
    every measure in every group; nulls are left out of their measure alone."""
    names = list(measures)
    m, kinds = len(names), dict(rows.select(*groups).dtypes)
    first, second = halves(F.col(key), seed)
    x = rows.select(*groups, first.alias("_h"), second.alias("_i"), *[c.cast("double").alias(f"_m{k}") for k, c in enumerate(measures.values())])
    tasks = min(TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism)  # dear rows: adaptive execution would put them into few tasks
    blocks = -(-draws // BLOCK)

    def told(held: dict) -> Iterator[pd.DataFrame]:
        for labels, sums in held.values():
            out = pd.DataFrame({"_b": np.arange(blocks + 1), "_s": [sums[b * BLOCK: min(b * BLOCK + BLOCK, draws)].ravel() for b in range(blocks)] + [sums[draws:].ravel()]})
            for g in groups:
                out[g] = pd.Series([labels[g]] * len(out), dtype=object)
            yield out[[*groups, "_b", "_s"]]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            # A key is weighed once a batch, however many rows it has; keys of the same groups lie together.
            key, place = np.unique(pdf["_h"].to_numpy(np.uint64) << np.uint64(32) | pdf["_i"].to_numpy(np.uint64), return_inverse=True)
            by = pdf.groupby(groups, dropna=False, sort=False)
            code = by.ngroup().to_numpy()
            least = np.full(len(key), len(pdf))
            np.minimum.at(least, place, code)
            order = np.argsort(least, kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.arange(len(key))
            key, place = key[order], rank[place]
            values = pdf[[f"_m{k}" for k in range(m)]].to_numpy(float)
            known = ~np.isnan(values)
            cells = np.concatenate((np.where(known, values, 0.0), known), axis=1)
            rows = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[rows], np.arange(0, len(key) + ROWS, ROWS))
            _, ones = np.unique(code, return_index=True)
            # Nulls are NaN here, which don't equal each other: as None they are one label in all batches.
            names_of = [tuple(None if pd.isna(v) else v for v in label) for label in zip(*(pdf[g].iloc[ones] for g in groups), strict=True)]
            for at, (lo, hi) in zip(range(0, len(key), ROWS), zip(cuts, cuts[1:], strict=False), strict=False):
                own, some = rows[lo:hi], key[at: at + ROWS]
                present, part = np.unique(code[own], return_inverse=True)
                sums = np.zeros((len(some), len(present), 2 * m))
                np.add.at(sums, (place[own] - at, part), cells[own])
                for c in present.tolist():
                    if names_of[c] not in held:
                        held[names_of[c]] = pdf.iloc[ones[c]][groups], np.zeros((draws + 1, 2 * m))
                arrays = [held[names_of[c]][1] for c in present.tolist()]
                where = [np.flatnonzero(np.bincount(place[own[part == k]] - at, minlength=len(some))) for k in range(len(present))]
                few = sum(map(len, where)) * FEW < len(some) * len(present)
                for d in range(0, draws, BLOCK):
                    w = weights(some >> np.uint64(32), some & np.uint64(0xFFFFFFFF), range(d, min(d + BLOCK, draws))).astype(np.float64)
                    if not few:
                        got = (w @ sums.reshape(len(some), -1)).reshape(len(w), len(present), 2 * m)
                    for k, out in enumerate(arrays):
                        out[d: d + len(w)] += w[:, where[k]] @ sums[where[k], k] if few else got[:, k]
                for k, out in enumerate(arrays):
                    out[draws] += sums[:, k].sum(axis=0)  # the last: the mean itself
                if len(held) > HELD:
                    yield from told(held)
                    held.clear()
        yield from told(held)

    def means(key_of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(pdf["_s"].to_list()), axis=0).reshape(-1, 2 * m)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums[:, :m] / sums[:, m:]
        b = key_of[-1]
        out = pd.DataFrame({"_draw": np.arange(len(sums)) + b * BLOCK if b < blocks else [-1], "_n": [s.astype(int) for s in sums[:, m:]]})
        for k in range(m):
            out[f"_m{k}"] = pd.Series(mean[:, k]).astype(object).where(~np.isnan(mean[:, k]), None)
        for g in groups:
            out[g] = pd.Series([pdf[g].iloc[0]] * len(out), dtype=object)
        return out[[*groups, "_draw", "_n", *[f"_m{k}" for k in range(m)]]]

    labels = ", ".join(f"{g} {kinds[g]}" for g in groups)
    sums = x.repartition(tasks, "_h", "_i").mapInPandas(weigh, f"{labels}, _b long, _s array<double>")
    drawn = sums.groupBy(*groups, "_b").applyInPandas(means, f"{labels}, _draw long, _n array<long>, {', '.join(f'_m{k} double' for k in range(m))}")
    own = F.col("_draw") < 0
    cols = [F.max(F.when(own, F.col("_n"))).alias("_n")] + [f(k) for k in range(m) for f in (lambda k: F.max(F.when(own, F.col(f"_m{k}"))).alias(f"_e{k}"), lambda k: F.percentile(F.when(~own, F.col(f"_m{k}")), F.array(*map(F.lit, BOUNDS))).alias(f"_q{k}"))]
    out = drawn.groupBy(*groups).agg(*cols)
    r = lambda c: F.round(c, 6)
    return out.select(*groups, *[c for k, n in enumerate(names) for c in (F.get("_n", k).alias(f"{n}_n"), r(F.col(f"_e{k}")).alias(n), r(F.get(f"_q{k}", 0)).alias(f"{n}_low"), r(F.get(f"_q{k}", 1)).alias(f"{n}_high"))])
