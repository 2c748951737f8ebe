"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, one after the other.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns
of ``documents``. ``run`` writes each result into the shared folder as Parquet and reads it again.

Cases: null and empty texts fail the quality rules; to the other stages they are documents without words, links or
secrets, mixed by their hash and encoded to no tokens. Null and repeated ids are documents of their own; of rows equal
in every column the near-duplicate stage keeps one; null sources are one source; extra columns are carried along,
whatever their names, up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import op1_bpe, op2_quality, op4_minhash, op7_mixing, op9_secrets
from pricelens.llm.common import stash
from pricelens.llm.queries import vocabulary

#: What a secret is replaced by.
MARK = "[SECRET]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op2_quality.quality_rules(docs).where("kept").select("doc.*")


def _written(c: Column, kind: T.DataType) -> Column:
    """A value as text with its length before it, so that rows are equal if their columns' texts in a row are."""
    text = F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id, null ids last.

    Rows are known by a 256-bit digest of all their columns, nulls told apart: rows that share an id are documents of
    their own, and rows equal in every column are one. Texts are dealt once, by that digest, when the chosen rows are
    picked."""
    key = F.unhex(F.sha2(F.concat(*[_written(docs[f.name], f.dataType) for f in docs.schema]), 256))
    found = op4_minhash.near_duplicates(docs.select(key.alias("_key"), docs["text"].alias("_text")), 80, 5, "_key", "_text").select("doc_id", "component_id").distinct()
    ids = docs.select(key.alias("_key"), docs["doc_id"].alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key"))
    kept = found.join(ids, found["doc_id"] == ids["_key"]).groupBy("component_id").agg(first.alias("first")).select(F.col("first._key").alias("_kept"))
    rows = docs.select(key.alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    return rows.join(kept, rows["_key"] == kept["_kept"], "left_semi").groupBy("_key").agg(F.first("_doc").alias("_doc")).select("_doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan finds is replaced by a mark."""
    return op9_secrets.redact(docs, MARK)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op7_mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return op1_bpe.encode_documents(docs, vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", keep_quality), ("near duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix), ("encoding", encode)]
#: SQL can't express the stages' models; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage")
    return docs
