"""Shared pieces: scratch tables in the cluster's shared folder, word hashing over Arrow batches,
and connected components over link tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes (space, tab to carriage return).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Arrow batches are worked on in slices of about this many bytes of text, to bound memory.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E6D62D06F6A9A9B  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


# ---------------------------------------------------------------- shared folder

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session that has
    none and runs in one machine (as in tests) gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/pricelens-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; the folder belongs to the cluster
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, tag: str = "stash") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- words of Arrow batches

def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) for slices of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n rows + 1)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    first[lo[full]] = inside[lo[full]]
    last[hi[full] - 1] = inside[hi[full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_MULT, _INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        if n > 4 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word (A-Z lower-cased first): a polynomial over its bytes taken from prefix sums."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * up[: len(data)] + up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


# ---------------------------------------------------------------- components

def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an undirected link table.

    Large-star and small-star steps: each is one grouped minimum and a join back, so a node with very many
    links is pre-aggregated; its links pass through one task's join as a stream, of two numbers each. Lineage is cut by
    a written table in each round."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stash(edges, "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def join_back(rows: DataFrame, per_key: DataFrame, key: str, by: str, large: int = 10_000, salt: int = 64) -> DataFrame:
    """``rows`` with what ``per_key`` has for their key, one row a key; every row has one. Rows of a key that has more
    than ``large`` of them are dealt by ``by`` over ``salt`` parts, each of which meets a copy of the key's row."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > large).select(key)
    some = stash(per_key.join(many, key, "left_semi").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).withColumn("_hot", F.lit(True)), "large")
    new = [c for c in per_key.columns if c != key]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(salt)).cast("int")).join(some, [key, "_part"], "left")
    few = dealt.where("_hot is null").select(*rows.columns).join(per_key, key)
    return dealt.where("_hot").select(*rows.columns, *new).unionByName(few.select(*rows.columns, *new))
