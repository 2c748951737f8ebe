"""Shards of equal bytes by histogram sort.

Rows are ordered by the digest of their text, then by id, so equal texts lie together and are parted only where a
shard ends. Of each row a digest, an id and a size are written once; everything after reads that narrow table.

Splitters are searched for: in each round every task counts the exact bytes and rows of its rows between candidate
keys, and these histograms, of about ``PROBES`` cells whatever the table, are added up. Each splitter's interval
shrinks to the cell that holds its target and is probed again, from its least to its greatest key, until the bytes
below a key differ from the target by no more than the tolerance, or (tolerance 0) the very row is found. Further
splitters, of rows and with a wide tolerance, cut shards into ranges of about equal many rows, so that no task depends
on how many shards there are or how many copies a text has. Then rows are exchanged once, by range, and sorted within;
the counts below its first key give each range the slot it begins with.

A row belongs to the shard in which its first byte falls. A shard's bytes therefore differ from the mean by less than
the largest row, plus the tolerance.

Cases: null and empty texts have a size of 1; null ids come first among equal texts; rows with equal ids and texts are
told apart by their place in the written table; one row larger than a shard leaves the shards it covers empty; other
columns are not read (``write_shards`` keeps them, whatever their names); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Cells of a round's histogram, over all splitters that are still open, or eight a splitter if these are more.
PROBES = 4096
#: Share of a range's rows by which it may be longer or shorter.
SLACK = 0.25
#: Bytes of a key: text digest, whether the id is null, id, place.
WIDTH = 16 + 1 + 8 + 8
_END = b"\xff" * WIDTH


def digests(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, digest, place): what the search needs of a row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
                       F.unhex(F.md5(text)).alias("digest"), F.monotonically_increasing_id().alias("place"))


def sort_keys(ids: pa.Array, digest: pa.Array, place: pa.Array) -> np.ndarray:
    """Keys as byte strings that sort as (digest, id with nulls first, place)."""
    n = len(ids)
    out = np.zeros((n, WIDTH), np.uint8)
    out[:, :16] = np.frombuffer(b"".join(digest.to_pylist()), np.uint8).reshape(n, 16)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    out[:, 16] = known
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 17:25] = np.where(known, number, 0).astype(">u8").view(np.uint8).reshape(n, 8)
    out[:, 25:] = place.to_numpy(zero_copy_only=False).astype(">u8").view(np.uint8).reshape(n, 8)
    return out.reshape(-1).view(f"S{WIDTH}")


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(WIDTH, b"\0"), "big")


def _probes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(WIDTH, "big") for k in keys], f"S{WIDTH}")


def histogram(rows: DataFrame, keys: list[int]) -> list[tuple[int, int, int, int]]:
    """(bytes, rows, least key, greatest key) of each cell that has rows, in order; cells begin at ``keys``."""
    probes = _probes(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, many = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        least, most = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = sort_keys(batch.column(0), batch.column(2), batch.column(3))
            order = np.argsort(key)
            key, own = key[order], batch.column(1).to_numpy(zero_copy_only=False)[order]
            cell = np.searchsorted(probes, key, "right")
            at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            size[cell[at]] += np.add.reduceat(own, at)
            many[cell[at]] += np.diff(np.append(at, len(cell)))
            for c, a, b in zip(cell[at].tolist(), key[at].tolist(), key[np.append(at[1:], len(cell)) - 1].tolist(), strict=True):
                least[c], most[c] = min(a, least.get(c, a)), max(b, most.get(c, b))
        found = np.flatnonzero(many)
        full = lambda of: pa.array([of[c].ljust(WIDTH, b"\0") for c in found.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(size[found]), pa.array(many[found]), full(least), full(most)], ["cell", "size", "many", "least", "most"])

    cells = rows.select("doc_id", "size", "digest", "place").mapInArrow(count, "cell long, size long, many long, least binary, most binary")
    cells = cells.groupBy("cell").agg(F.sum("size"), F.sum("many"), F.min("least"), F.max("most")).orderBy("cell")
    return [(r[1], r[2], _number(bytes(r[3])), _number(bytes(r[4]))) for r in cells.collect()]  # no more rows than cells


def find_splitters(rows: DataFrame, shards: int, ranges: int, tolerance: float = 0.0) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Splitters of bytes and of rows as (key, rows below it), in order. A splitter of bytes is the first row with at
    least its target before it, or one whose bytes before differ by ``tolerance`` shares of a shard at most."""
    keys = [(k << 8 * WIDTH) // PROBES for k in range(1, PROBES)]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    goals: dict[tuple[int, int], tuple[float, float]] | None = None
    while True:
        cells = histogram(rows, keys)
        before = np.cumsum([(0, 0), *((c[0], c[1]) for c in cells)], axis=0, dtype=np.int64)
        if goals is None:
            size, many = (int(x) for x in before[-1])
            goals = {(0, s): (s * size / shards, tolerance * size / shards) for s in range(1, shards)} | {(1, p): (p * many / ranges, SLACK * many / ranges) for p in range(1, ranges)}
        starts = [c[2] for c in cells] + [_number(_END)]
        lookups = []
        for goal in [g for g in goals if g not in found]:
            target, slack = goals[goal]
            at = int(np.searchsorted(before[:, goal[0]], target, "left"))  # the first start with the target below it
            if at == 0 or before[at][goal[0]] - target <= slack or cells[at - 1][1] == 1:
                found[goal] = starts[at], int(before[at][1])
            elif target - before[at - 1][goal[0]] <= slack and slack:
                found[goal] = starts[at - 1], int(before[at - 1][1])
            else:
                lookups.append((cells[at - 1][2] + 1, cells[at - 1][3]))
        if not lookups:
            return [found[0, s] for s in range(1, shards)], [found[1, p] for p in range(1, ranges)]
        lookups = sorted(set(lookups))
        each = max(8, PROBES // len(lookups))
        # The row before an interval is a cell of its own, so that cells within hold rows of the interval alone.
        keys = sorted({a + (b - a) * i // (each - 1) for a, b in lookups for i in range(each)} | {a - 1 for a, _ in lookups})


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.0, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    rows = stash(digests(docs, id_col, text_col), "digests")
    spark = docs.sparkSession
    ranges = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_size, by_rows = find_splitters(rows, shards, ranges, tolerance)
    bounds = dict(sorted([*by_rows, *by_size]))
    probes, cuts = _probes(list(bounds)), np.array([0, *bounds.values()], np.int64)
    firsts = np.array([0, *(n for _, n in by_size)], np.int64)
    shard_of = np.searchsorted(_probes([k for k, _ in by_size]), np.concatenate((_probes([0]), probes)), "right")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(probes, sort_keys(batch.column(0), batch.column(3), batch.column(4)), "right")
            shard = shard_of[part]
            more = [pa.array(part.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(cuts[part] - firsts[shard])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "shard", "base"])

    dealt = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, digest binary, place long, part int, shard int, base long")
    dealt = dealt.repartitionById(len(cuts), F.col("part"))
    order = Window.partitionBy("part").orderBy("digest", F.col("doc_id").asc_nulls_first(), "place")
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(order) - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.0, id_col="doc_id", text_col="text") -> None:
    """The rows of ``docs`` as Parquet, a folder ``_shard=<k>`` each, whole texts exchanged once and in order.
    Rows with equal ids and texts may lie on either side of a splitter between them."""
    rows = stash(digests(docs, id_col, text_col), "digests")
    ranges = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_size, by_rows = find_splitters(rows, shards, ranges, tolerance)
    bounds = sorted({k for k, _ in [*by_rows, *by_size]})
    probes, shard_of = _probes(bounds), np.searchsorted(_probes([k for k, _ in by_size]), _probes([0, *bounds]), "right")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(probes, sort_keys(batch.column(0), batch.column(1), batch.column(2)), "right")
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), batch.column(0), pa.array(part.astype(np.int32)), pa.array(shard_of[part].astype(np.int32))], ["_doc", "_digest", "_id", "_part", "_shard"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    whole = docs.select(docs[id_col].cast("long").alias("_id"), F.unhex(F.md5(text)).alias("_digest"), F.monotonically_increasing_id().alias("_place"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    kind = whole.schema["_doc"].dataType.simpleString()
    dealt = whole.mapInArrow(place, f"_doc {kind}, _digest binary, _id long, _part int, _shard int").repartitionById(len(bounds) + 1, F.col("_part"))
    dealt.sortWithinPartitions("_shard", "_digest", F.col("_id").asc_nulls_first()).select("_doc", "_shard").write.partitionBy("_shard").parquet(path)
