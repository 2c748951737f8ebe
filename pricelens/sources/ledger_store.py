"""A stored, append-only hash ledger.

Rows are chained within segments, id ranges of fixed length, so segments are chained in parallel; an append goes on where
the last one ended. Each append writes its rows into a folder of its own and is then published by one file, made only
if no other append has made it: readers see the folders that published commits name and no others, so a failed or
concurrent writer leaves nothing that is read. A commit holds what its append did (rows, last id, digest of the heads of
the segments it touched) and is chained to the commit before; the last commit's head stands for the whole ledger.

A ledger is verified from a known commit on: only later folders are read, their rows hashed again, each linked to the row
before it or to what the known commit says of the open segment, and each commit's digest and link compared."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
_COMMIT = ("batch", "folder", "n_rows", "total", "last_id", "last_seg", "last_head", "digest", "head")
_ROWS = "event_id long, line string, prev_hash string, row_hash string, seg long"


class Conflict(RuntimeError):
    """Another append has published this commit, or the rows don't follow the ledger's last one."""


def first_link(seg):
    """What the first row of a segment is linked to."""
    return F.concat(F.lit("segment "), seg.cast("string"))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("event_id")
    prev, prevs, hashes = pdf["start"].iloc[0], [], []
    for line in pdf["line"]:
        prevs.append(prev)
        prev = hashlib.sha256((prev + line).encode()).hexdigest()
        hashes.append(prev)
    return pdf.assign(prev_hash=prevs, row_hash=hashes)[["event_id", "line", "prev_hash", "row_hash", "seg"]]


def touched(rows: DataFrame) -> DataFrame:
    """(batch, digest, n_rows, last_id) of chained rows with their batch: the heads and counts of a batch's segments, in
    order, digested in parts of a thousand segments."""
    x = rows.groupBy("batch", "seg").agg(F.max_by("row_hash", "event_id").alias("h"), F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    text = F.concat_ws("|", F.col("seg").cast("string"), "h", F.col("n").cast("string"))
    ordered = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), v.alias("v")))), lambda s: s["v"]), "\n")
    parts = x.groupBy("batch", F.floor(F.col("seg") / 1000).alias("part")).agg(F.sha2(ordered("seg", text), 256).alias("d"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return parts.groupBy("batch").agg(F.sha2(ordered("part", F.col("d")), 256).alias("digest"), F.sum("n").alias("n_rows"), F.max("last").alias("last_id"))


def commit_head(before: str, batch: int, n_rows: int, last_id: int, digest: str) -> str:
    return hashlib.sha256(f"{before}|{batch}|{n_rows}|{last_id}|{digest}".encode()).hexdigest()


class LedgerStore:
    """The ledger at a path that all executors share; ``segment`` ids make a segment."""

    def __init__(self, spark: SparkSession, path: str, segment: int = 1000):
        self.spark, self.path, self.segment = spark, path.rstrip("/"), segment

    def _file(self, batch: int):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{batch:012d}.json")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits(self, after: int = -1) -> list[Row]:
        """Published commits after a batch, in order: one small record an append."""
        fs, at = self._file(0)
        if not fs.exists(at.getParent()):
            return []
        schema = ", ".join(f"{c} {'string' if c in ('folder', 'last_head', 'digest', 'head') else 'long'}" for c in _COMMIT)
        return self.spark.read.schema(schema).json(f"{self.path}/commits").where(F.col("batch") > after).orderBy("batch").collect()

    def head(self) -> Row | None:
        return (self.commits() or [None])[-1]

    def rows(self, after: int = -1, commits: list[Row] | None = None) -> DataFrame:
        """Chained rows of the commits after a batch, with their batch; other folders are not listed or read."""
        commits = self.commits(after) if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], f"{_ROWS}, batch int")
        paths = [f"{self.path}/rows/batch={c.batch}/{c.folder}" for c in commits]
        return self.spark.read.schema(_ROWS).option("basePath", f"{self.path}/rows").parquet(*paths)

    def append(self, rows: DataFrame) -> Row | None:
        """Chain (event_id, line) to the ledger and publish it; None without rows. Ids must come after the last one."""
        last = self.head()
        batch, done, before, total = (last.batch + 1, last.last_id, last.head, last.total) if last else (0, None, GENESIS, 0)
        x = rows.select("event_id", "line", F.floor(F.col("event_id") / self.segment).alias("seg"))
        x = x.withColumn("start", F.when(F.col("seg") == last.last_seg, F.lit(last.last_head)).otherwise(first_link(F.col("seg"))) if last else first_link(F.col("seg")))
        folder = f"try-{uuid.uuid4().hex}"
        x.groupBy("seg").applyInPandas(_chain, _ROWS).write.parquet(f"{self.path}/rows/batch={batch}/{folder}")
        mine = self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows/batch={batch}/{folder}").withColumn("batch", F.lit(batch))
        made = touched(mine).first()
        if made is None:
            return None
        first, ids = mine.agg(F.min("event_id"), F.count_distinct("event_id")).first()
        if ids != made.n_rows or (done is not None and first <= done):
            raise Conflict(f"{made.n_rows} rows with {ids} ids from {first} on don't follow row {done}")
        open_head = mine.where(F.col("event_id") == made.last_id).select("seg", "row_hash").first()
        record = {"batch": batch, "folder": folder, "n_rows": made.n_rows, "total": total + made.n_rows, "last_id": made.last_id, "last_seg": open_head.seg, "last_head": open_head.row_hash, "digest": made.digest}
        record["head"] = commit_head(before, batch, made.n_rows, made.last_id, made.digest)
        self._publish(batch, record)
        return self.head()

    def _publish(self, batch: int, record: dict) -> None:
        fs, at = self._file(batch)
        temp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/publishing/{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(temp, at):  # a rename takes place whole or not at all
            fs.delete(temp, False)
            raise Conflict(f"batch {batch} is published already")

    def verify(self, anchor: Row | None = None, head: str | None = None) -> DataFrame:
        """(batch, seg, n_rows, first_bad) of what follows a known commit, or of all: the first bad row's id of each
        segment and batch; under seg -1 for each commit 'digest', 'link' or null, and 'head' where the last commit isn't
        the one with the known ``head``."""
        commits = self.commits(anchor.batch if anchor else -1)
        x = self.rows(commits=commits)
        start = first_link(F.col("seg"))
        if anchor:
            start = F.when(F.col("seg") == anchor.last_seg, F.lit(anchor.last_head)).otherwise(start)
        w = Window.partitionBy("seg").orderBy("event_id")
        ok = (F.col("prev_hash") == F.coalesce(F.lag("row_hash").over(w), start)) & (F.sha2(F.concat("prev_hash", "line"), 256) == F.col("row_hash"))
        bad = x.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("batch", "seg").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.when(~F.col("ok"), F.col("event_id"))).cast("string").alias("first_bad"))
        links, before = [], anchor.head if anchor else GENESIS
        for k, c in enumerate(commits):
            linked = c.batch == (anchor.batch if anchor else -1) + 1 + k and c.head == commit_head(before, c.batch, c.n_rows, c.last_id, c.digest)
            late = head is not None and k == len(commits) - 1 and c.head != head
            links.append((c.batch, c.n_rows, c.digest, "link" if not linked else "head" if late else None))
            before = c.head
        if head is not None and before != head and not commits:
            links.append(((anchor.batch if anchor else -1), 0, None, "head"))
        told = self.spark.createDataFrame(links, "batch long, said long, digest string, fault string")
        found = touched(x).select(F.col("batch").cast("long").alias("batch"), F.col("digest").alias("now"), F.col("n_rows").alias("have"))
        agrees = F.col("digest").isNull() | (F.col("digest").eqNullSafe(F.col("now")) & F.col("said").eqNullSafe(F.col("have")))
        chain = told.join(found, "batch", "left").select("batch", F.lit(-1).cast("long").alias("seg"), F.col("said").alias("n_rows"), F.coalesce(F.when(~agrees, "digest"), "fault").alias("first_bad"))
        return bad.select(F.col("batch").cast("long").alias("batch"), "seg", "n_rows", "first_bad").unionByName(chain)
