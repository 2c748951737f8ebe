"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its ``NEAREST`` nearest pivots in order and posted to the inverted lists of all of them.
Lists are worked on in blocks of bounded size, each pair of blocks in one task. There every pivot that two vectors
share counts ``NEAREST`` less the difference of its ranks; pairs of ``LEAST`` and more are candidates, each taken in the
list of the least pivot that both have, and verified by their cosine in double precision. A task gives back sums and a
spanning forest of links, never pairs. Equal vectors are one class from the start.

The number of pivots grows with the square root of the number of vectors of a length, so lists grow likewise and the
work with the power 1.5. Pivots are fitted on a bounded sample: the classes with the smallest hashes, as many as
``SAMPLE`` or the pivots if these are more, of which there are ``PIVOTS`` at most. All rows are indexed; vectors of
lengths with no more than a block of rows share one list a length, which is exact. Of pairs just at a cosine of 0.95 in
64 dimensions 0.96 and more are candidates, from 400 pivots (10,000 vectors) to all 65,536 (268 million; beyond that
lists grow with the rows and the work with their square). Recall is measured in the tests.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, are
linked with nothing; very small and very large components are scaled before they are squared; vectors meet only their
own length; rows that share an id are vectors of their own, each
with the component of its own vector; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_back, stash

PIVOTS, SAMPLE, NEAREST = 65_536, 4096, 8
#: Shared pivots, weighted by how near their ranks are, that make two vectors candidates.
LEAST = 10
#: Rows in a block of an inverted list.
BLOCK = 500


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Reference points far from each other: each next is the one least similar to those before. If there are more
    pivots than ``SAMPLE``, the whole sample is taken."""
    if n >= len(sample):
        return sample
    picked, near = [0], sample @ sample[0]
    while len(picked) < n:
        k = int(near.argmin())
        picked.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[picked]


def nearest_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots in order; in slices, to bound memory."""
    k = min(NEAREST, len(pivots))
    out = np.empty((len(v), k), np.int32)
    for a in range(0, len(v), 1000):
        near = -(v[a: a + 1000] @ pivots.T)
        few = np.argpartition(near, k - 1, axis=1)[:, :k]
        rank = np.lexsort((few, np.take_along_axis(near, few, 1)))
        out[a: a + 1000] = np.take_along_axis(few, rank, 1)
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ordered pivots: each pivot that two share counts their number less the difference of its ranks."""
    k, out = a.shape[1], np.zeros((len(a), len(b)), np.uint8)
    for i in range(k):
        for j in range(k):
            out += (a[:, i, None] == b[None, :, j]).view(np.uint8) * np.uint8(k - abs(i - j))
    return out


def near_vectors(rows: DataFrame, least: float = 0.95, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    v = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("key", F.when(good, F.sha2(F.array_join(F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")), ","), 256)))
    classes = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written
    pivots: dict[int, np.ndarray] = {}
    for r in classes.groupBy(F.size("v").alias("d")).count().where(F.col("count") > BLOCK).collect():  # lengths with lists
        many = int(min(PIVOTS, 4 * r["count"] ** 0.5))
        some = classes.where(F.size("v") == r.d).orderBy(F.xxhash64("key"), "key").limit(max(SAMPLE, many)).select("v").toPandas()  # bounded sample
        pivots[r.d] = fit_pivots(unit(np.array(some["v"].tolist())), many)

    def post(batches):
        for batch in batches:
            vectors = [np.array(x) for x in batch.column(2).to_pylist()]
            for d in {len(x) for x in vectors}:
                i = np.array([k for k, x in enumerate(vectors) if len(x) == d])
                tops = nearest_pivots(unit(np.stack([vectors[k] for k in i])), pivots[d]) if d in pivots else np.full((len(i), 1), -1, np.int32)
                k = tops.shape[1]
                rows = batch.take(pa.array(i.repeat(k)))
                yield pa.RecordBatch.from_arrays([pa.array(tops.ravel()), pa.array(np.full(tops.size, d, np.int32)), rows.column(0), rows.column(1), pa.array(list(tops.repeat(k, axis=0)), pa.list_(pa.int32()))], ["pivot", "d", "cid", "n", "tops"])

    posts = stash(classes.select("cid", "n", "v").mapInArrow(post, "pivot int, d int, cid long, n long, tops array<int>"), "posts")
    lists = posts.groupBy("pivot", "d").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cuts = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = posts.join(lists, ["pivot", "d"]).withColumns({"cuts": cuts, "own": F.pmod(F.xxhash64("cid"), cuts).cast("int")})
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("pivot", "d", "cid", "n", "tops", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = placed.join(classes.select("cid", "v"), "cid")

    def block(table: pa.Table) -> pa.Table:
        pivot, i, j = (table.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        cid, n, own = (table.column(c).to_numpy() for c in ("cid", "n", "own"))
        v, tops = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(cid), -1) for c in ("v", "tops"))
        v = unit(v)
        a, b = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        if pivot < 0:
            hit = v[a] @ v[b].T >= least
        else:
            p, q = np.nonzero(agreement(tops[a], tops[b]) >= LEAST)
            hit = np.zeros((len(a), len(b)), bool)
            for s in range(0, len(p), 20_000):  # in slices, to bound memory
                x, y = a[p[s: s + 20_000]], b[q[s: s + 20_000]]
                good = np.flatnonzero((v[x] * v[y]).sum(1) >= least)
                x, y = x[good], y[good]
                same = (tops[x][:, :, None] == tops[y][:, None, :]).any(2)
                first = np.where(same, tops[x], np.iinfo(np.int32).max).min(1) == pivot  # else another list has the pair
                hit[p[s + good[first]], q[s + good[first]]] = True
        if i == j:
            hit[np.arange(len(a)), np.arange(len(a))] = False
        out: dict[str, list] = {"cid": [], "links": [], "peer": []}
        for mine, theirs, m in ((a, b, hit),) if i == j else ((a, b, hit), (b, a, hit.T)):
            sums = m @ n[theirs]
            for k in np.flatnonzero(sums).tolist():
                out["cid"].append(int(cid[mine[k]]))
                out["links"].append(int(sums[k]))
                out["peer"].append(None)
        for x, y in _forest(cid[a], cid[b], hit):
            out["cid"].append(x)
            out["links"].append(0)
            out["peer"].append(y)
        return pa.table({"cid": pa.array(out["cid"], pa.int64()), "links": pa.array(out["links"], pa.int64()), "peer": pa.array(out["peer"], pa.int64())})

    got = stash(full.groupBy("pivot", "d", "i", "j").applyInArrow(block, "cid long, links long, peer long"), "links")
    parts = components(got.where("peer is not null").select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    sums = got.groupBy("cid").agg(F.sum("links").alias("links"))
    own = classes.select("key", "cid", "low", (F.col("n") - 1).alias("copies")).join(sums, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left")
    own = own.select("key", "cid", "low", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"), "label")
    linked = stash(own.where("label is not null"), "linked")
    of = join_back(linked.drop("low"), linked.groupBy("label").agg(F.min("low").alias("low")), "label", "cid").select("key", "n_links", "low")
    of = of.unionByName(own.where("label is null").select("key", "n_links", "low"))
    out = v.select("vec_id", "key").join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("low", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _forest(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``hit`` joins, at most one for each row and column."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.flatnonzero(hit.any(1)).tolist():
        x = int(a[k])
        for y in b[np.flatnonzero(hit[k])].tolist():
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out
