"""Idempotent writes: what a table has isn't written again. Each gives the rows to append; ``append`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table lacks, each key once."""
    return batch.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def append(batch: DataFrame, path: str, key: list[str], partition: str | None = None) -> DataFrame:
    """Append the new rows to the Parquet table at ``path``, made if missing; gives the table afterwards."""
    spark = batch.sparkSession
    try:
        new = new_rows(batch, spark.read.parquet(path), key)
    except Exception as e:  # the table doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = batch.dropDuplicates(key)
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.parquet(path)


def upsert_time(table: DataFrame, batch: DataFrame, key: str, time: str) -> DataFrame:
    """A fixture's first values stay, but its time follows the batch; of a key's batch rows the first counts."""
    b = batch.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), "seq").alias("b"))
    x = table.join(b, key, "full_outer")
    pick = lambda c: (F.coalesce(F.col(f"b.{c}"), F.col(c)) if c == time else F.coalesce(F.col(c), F.col(f"b.{c}"))).alias(c)
    return x.select(key, *[pick(c) for c in table.columns if c != key])


def changed_files(files: DataFrame, current: DataFrame) -> DataFrame:
    """Of (path, content) the files whose hash the current versions (path, sha) lack."""
    return files.select("path", F.sha2("content", 256).alias("sha"), "content").join(current.select("path", "sha"), ["path", "sha"], "left_anti")


def attempt_log(attempts: DataFrame) -> DataFrame:
    """(path, at, sha): one row a fetch; a failed one has no hash."""
    return attempts.select("path", "at", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("sha"))
