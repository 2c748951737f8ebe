"""Versioned files: a round of files is compared with what is stored by content, and every attempt is logged.

Versions and attempts are append-only tables with a folder a round, so a round that is written again replaces itself and
nothing else; a file's current version is its latest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import changed_files

_VERSIONS = "path string, sha string, bytes long, content binary, round int"
_ATTEMPTS = "path string, sha string, round int"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, content) of all files below a folder; paths are relative to it. Each file is one row."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = root.split(":", 1)[-1].strip("/") + "/"  # schemes are written with one slash or three
    return x.select(F.substring_index("path", below, -1).alias("path"), F.col("length").alias("bytes"), "content")


def write_packs(files: DataFrame, root: str) -> None:
    """Write files (path, content) into packs, Parquet files with a row for each of them: where files are many and small, a
    name of its own costs each more than its bytes do."""
    files.select("path", "content").write.parquet(root)


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, content) of all files in the packs below a folder."""
    x = spark.read.schema("path string, content binary").parquet(root)
    return x.select("path", F.octet_length("content").cast("long").alias("bytes"), "content")


class FileStore:
    """The stored files at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str, columns: list[str]) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema).select(*columns)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*columns)

    def current(self, *columns: str, before: int | None = None) -> DataFrame:
        """The latest version of each file, or the latest of the rounds ``before`` one; contents are read only where
        asked for."""
        columns = columns or ("path", "sha", "bytes", "round")
        x = self._table("versions", _VERSIONS, list(dict.fromkeys(("path", "round", *columns))))
        x = x if before is None else x.where(F.col("round") < before)
        latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("round")))
        return x.withColumn("_place", latest).where("_place = 1").select(*columns)

    def attempts(self) -> DataFrame:
        return self._table("attempts", _ATTEMPTS, ["path", "sha", "round"])

    def save(self, files: DataFrame, number: int, expected: DataFrame | None = None) -> DataFrame:
        """Store the files (path, bytes, content) of a round whose content isn't that of their current version, and log
        an attempt for each and, without a hash, for each ``expected`` path that has none. Gives what was stored."""
        seen = files.select("path", F.sha2("content", 256).alias("sha"))
        new = changed_files(files, self.current(before=number))
        new.select("path", "sha", F.octet_length("content").cast("long").alias("bytes"), "content").write.mode("overwrite").parquet(f"{self.path}/versions/round={number}")
        log = seen
        if expected is not None:
            missing = expected.select("path").distinct().join(seen.select("path"), "path", "left_anti")
            log = log.unionByName(missing.select("path", F.lit(None).cast("string").alias("sha")))
        log.write.mode("overwrite").parquet(f"{self.path}/attempts/round={number}")
        return self.spark.read.schema("path string, sha string, bytes long").parquet(f"{self.path}/versions/round={number}")
