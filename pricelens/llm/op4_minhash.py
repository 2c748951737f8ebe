"""Near-duplicate documents by HyperMinHash sketches, with links confirmed on full shingle sets.

1. Each text becomes the set of its distinct word shingles (64-bit hashes) and a sketch: shingles are dealt to
   ``BUCKETS`` buckets; of a bucket's smallest hash the leading-zero count and ten mantissa bits are kept in 16 bits.
2. Documents with equal sets form a class, with a number of its own; only classes go on.
3. Empty buckets borrow from full ones by a fixed walk; bands of ``ROWS`` registers, 64 bits together, are the keys
   under which classes meet. At the least similarity of 0.8 a pair misses all bands with probability 5e-8.
4. The full sets of classes that meet another one are made once and written. Each band's classes are compared with
   its hub, the class that meets the most others. Where a band's classes still lie in several components, those
   outside the band's largest are compared with all of the band, or those of all bands that have the same largest one
   together, whichever takes fewer comparisons. A comparison first estimates the similarity from
   the registers, corrected for chance collisions, with a margin of ``SIGMAS`` standard deviations, then intersects
   the full sets. Comparisons run in blocks of bounded size: no pairs of a group are listed, and no group meets in
   one task.
5. Components of the confirmed links, each named by the smallest id of all its classes.

Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is
one shingle; very long texts are read whole; rows that share an id are documents of their own, each with the
component of its own text; a null id is linked with nothing (its component is null); repeated rows stay rows; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, join_back, mix, stash, word_hashes, word_spans

BUCKETS, ROWS = 128, 4
BANDS = BUCKETS // ROWS
_BUCKET_BITS = 7
SIGMAS = 5.5
#: Shingles in a block of the left and of the right side of a comparison, and members at most.
LEFT, RIGHT, MEMBERS = 100_000, 400_000, 400
#: Parts over which the members of a group are dealt when they learn how large it is.
SALT = 64
_SHORT = np.uint64(0x51A7E5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = np.zeros(len(h), np.uint64)
    n = max(0, len(h) - size + 1)
    for k in range(size):
        grams[:n] = mix(grams[:n] * np.uint64(0x9E3779B97F4A7C15) + h[k: k + n] + np.uint64(k))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            g = np.sort(grams[a: b - size + 1])
            yield g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            x = np.full(1, _SHORT + np.uint64(b - a), np.uint64)
            for w in h[a:b]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
            yield x
        else:
            yield np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of sorted hashes: 0 for an empty bucket, else leading zeros and mantissa of its least hash."""
    regs = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        least = (shingles[at] << np.uint64(_BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as a double
        m, e = np.frexp(least.astype(np.float64))
        zeros = np.where(least > 0, 53 - e, 53)
        mantissa = np.where(least > 0, ((m - 0.5) * 2048).astype(np.int64), 0)
        regs[bucket[at]] = 1 + (zeros * 1024 + mantissa)
    return regs


def _walks() -> np.ndarray:
    """For each bucket the order in which it looks for a full one: itself, then a fixed permutation."""
    rng = np.random.default_rng(4)
    return np.stack([np.concatenate(([b], rng.permutation([x for x in range(BUCKETS) if x != b]))) for b in range(BUCKETS)])


_WALK = _walks()


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(n, bands) keys of sketches (n, buckets): densified registers, a band's 64 bits mixed with its number."""
    full = regs > 0
    dense = regs.copy()
    for b in range(BUCKETS):
        rows = np.flatnonzero(~full[:, b])
        if len(rows):
            src = _WALK[b][full[rows][:, _WALK[b]].argmax(1)]
            dense[rows, b] = regs[rows, src]
    words = np.ascontiguousarray(dense).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix(words + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of sketches (a, buckets) against (b, buckets), and how many buckets
    they rest on."""
    used = ((left[:, None, :] > 0) | (right[None, :, :] > 0)).sum(2)
    same = ((left[:, None, :] == right[None, :, :]) & (left[:, None, :] > 0)).sum(2)
    # Two different minima agree in zeros and mantissa with about this chance: half of each zero count's share.
    chance = (2 / 3) / 1024 * used
    return np.maximum(0.0, (same - chance) / np.maximum(used - chance, 1e-9)), used


def links_between(lid, lregs, lsets, rid, rregs, rsets, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of a left and a right block."""
    out = []
    lsize = np.array([len(s) for s in lsets])
    owner = np.repeat(np.arange(len(lsets)), lsize)
    cat = np.concatenate(lsets)
    order = np.argsort(cat, kind="stable")
    cat, owner = cat[order], owner[order]
    for a in range(0, len(rid), 64):
        est, used = estimate(lregs, rregs[a: a + 64])
        slack = SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / np.maximum(used, 1)) + 0.02
        may = est >= percent / 100 - slack
        for j in np.flatnonzero(may.any(0)).tolist():
            s = rsets[a + j]
            lo, hi = np.searchsorted(cat, s, "left"), np.searchsorted(cat, s, "right")
            hit = np.flatnonzero(hi > lo)
            n = hi[hit] - lo[hit]
            at = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(hit) else np.zeros(0, np.int64)
            both = np.bincount(owner[at], minlength=len(lsets))
            ok = may[:, j] & (100 * both >= percent * (lsize + len(s) - both))
            out += [(int(lid[i]), int(rid[a + j])) for i in np.flatnonzero(ok) if lid[i] != rid[a + j]]
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, n_shingles, set_key, regs) of (doc_id, h, text): set_key is a 128-bit digest of the set, null if it is
    empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, regs = [], [], []
            for _, data, offsets in chunks(batch.column(2)):
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "h", "n_shingles", "set_key", "regs"])

    return docs.select("doc_id", "h", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, n_shingles long, set_key binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(cid, key) for every band of every class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                cid = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, BANDS)), pa.array(band_keys(regs).ravel())], ["cid", "key"])

    return classes.select("cid", "regs").mapInArrow(work, "cid long, key long")


def _sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(cid, shingles): the sorted shingle hashes of one document, known by id and hash of the text, for every class of
    ``reps``, as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data, offsets in chunks(batch.column(1)):
                part = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), pa.array(part, pa.binary())], ["cid", "shingles"])

    one = docs.groupBy("doc_id", "h").agg(F.first("text").alias("text"))  # equal rows meet before they are dealt
    return one.join(reps, ["doc_id", "h"]).select("cid", "text").mapInArrow(sets, "cid long, shingles binary").where(F.length("shingles") > 0)


def _placed(groups: DataFrame) -> DataFrame:
    """(g, side, cid, i, j): members of groups (g, side, cid, n_shingles) by the blocks in which they are compared, each
    of side 0 with each of side 1. Only groups of more than one block are looked up, and by part of the group, so the
    members of a large one never meet."""
    cuts = groups.groupBy("g", "side").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    most = F.when(F.col("side") == 0, LEFT).otherwise(RIGHT)
    cuts = cuts.withColumn("cuts", F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("s") / most)).cast("int"))
    cuts = cuts.groupBy("g").agg(F.max(F.when(F.col("side") == 0, F.col("cuts"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("cuts"))).alias("c1"))
    cuts = stash(cuts.where("c0 > 1 or c1 > 1"), "cuts")
    dealt = groups.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT)))
    large = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    dealt = dealt.join(large, ["g", "salt"], "left").withColumns({"c0": F.coalesce("c0", F.lit(1)), "c1": F.coalesce("c1", F.lit(1))})
    zero = F.col("side") == 0
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col("cid"), F.lit(1)), F.when(zero, F.col("c0")).otherwise(F.col("c1"))).cast("int"))
    dealt = dealt.select("g", "side", "cid", "own", F.explode(F.sequence(F.lit(0), F.when(zero, F.col("c1")).otherwise(F.col("c0")) - 1)).alias("other"))
    return dealt.select("g", "side", "cid", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")).alias("j"))


def _compare(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups: (g, side, cid, n_shingles); each of side 0 is compared with each of side 1."""

    def block(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cid = table.column("cid").to_numpy()
        got = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        both = [np.flatnonzero(side == k) for k in (0, 1)]
        out = []
        if len(both[0]) and len(both[1]):
            sk = [np.stack([sketch(got[i]) for i in ix]) for ix in both]
            out = links_between(cid[both[0]], sk[0], [got[i] for i in both[0]], cid[both[1]], sk[1], [got[i] for i in both[1]], percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return _placed(groups).join(sets, "cid").groupBy("g", "i", "j").applyInArrow(block, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sk = stash(sketches(docs, shingle), "sketches")
    classes = sk.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    keys = _bands(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = stash(keys.join(shared, "key"), "bands")
    sets = stash(_sets(docs, classes.join(met.select("cid").distinct(), "cid", "left_semi").select("cid", "rep.*"), shingle), "sets")
    # 1: each band's classes against its hub
    ranked = met.join(met.groupBy("cid").agg(F.sum("m").alias("ties")), "cid")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("ties", (-F.col("cid")).alias("neg"))).alias("h")).select("key", (-F.col("h.neg")).alias("hub"))
    star = met.join(hubs, "key").where("cid <> hub").select("hub", "cid").distinct()
    sizes = classes.select("cid", F.col("n_shingles"))
    star = stash(star.join(sizes, "cid").join(sizes.select(F.col("cid").alias("hub"), F.col("n_shingles").alias("hn")), "hub").where("100 * least(n_shingles, hn) >= %d * greatest(n_shingles, hn)" % percent), "star")
    groups = star.select(F.col("hub").alias("g"), F.lit(1).alias("side"), "cid", "n_shingles").unionByName(
        star.select(F.col("hub").alias("g"), F.lit(0).alias("side"), F.col("hub").alias("cid"), F.col("hn").alias("n_shingles")).distinct())
    links = stash(_compare(groups, sets, percent), "links")
    parts = components(links)
    # 2: bands that still hold several components
    placed = met.join(parts, met["cid"] == parts["node"], "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    per = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    split = per.groupBy("key").agg(F.max(F.struct("c", (-F.col("label")).alias("neg"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", (-F.col("top.neg")).alias("main"))
    # Of bands with the same members, known by their number and two sums of hashes, one is enough.
    sums = [F.sum(F.xxhash64(F.col("cid"), F.lit(k)).cast("decimal(38,0)")) for k in (0, 1)]
    split = stash(split.join(met, "key").groupBy("key", "main").agg(F.struct(F.count(F.lit(1)), *sums).alias("members")).groupBy("members").agg(F.min(F.struct("key", "main")).alias("one")).select("one.*"), "split")
    left = stash(placed.join(split, "key").select("key", "main", "cid", (F.col("label") != F.col("main")).alias("out")), "rest")
    # Bands of one main component are compared each for itself or all together, whichever are fewer comparisons.
    cost = (F.count_if("out") * F.count(F.lit(1)).cast("double")).alias("cost")
    each = left.groupBy("main", "key").agg(cost).groupBy("main").agg(F.sum("cost").alias("each"))
    whole = left.select("main", "cid", "out").distinct().groupBy("main").agg(cost).select("main", F.col("cost").alias("whole"))
    joint = stash(each.join(whole, "main").where("whole < each").select("main", F.lit(True).alias("joint")), "joint")
    left = left.join(joint, "main", "left").select(F.when(F.col("joint"), F.col("main")).otherwise(F.col("key")).alias("g"), "cid", "out").distinct()
    left = stash(left.join(sizes, "cid"), "rest")
    groups = left.where("out").select("g", F.lit(0).alias("side"), "cid", "n_shingles").unionByName(left.select("g", F.lit(1).alias("side"), "cid", "n_shingles"))
    links = stash(links.unionByName(_compare(groups, sets, percent)).distinct(), "links")
    parts = components(links)
    own = classes.select("set_key", "cid", F.col("rep.doc_id").alias("low")).join(parts, F.col("cid") == F.col("node"), "left")
    linked = stash(own.where("label is not null").select("set_key", "cid", "low", "label"), "linked")
    of = join_back(linked.select("set_key", "cid", "label"), linked.groupBy("label").agg(F.min("low").alias("low")), "label", "cid").select("set_key", "low")
    of = of.unionByName(own.where("label is null").select("set_key", "low"))
    out = sk.select("doc_id", "n_shingles", "set_key").join(of, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
