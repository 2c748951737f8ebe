"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. A source whose target is q whole times its size and a rest takes
every document q times, and once more those whose hash lies below the rest's threshold. The threshold's bucket
is found from the histogram; only that boundary bucket is split further, three times in all (30 bits), so no
document is ever sorted, and a larger budget's documents contain a smaller one's.

Cases: null texts have size 0; a null source is a source of its own and comes last; a null id hashes like an
empty one; rows with the same id are taken alike; documents of size 0 follow their hash; an empty table gives an
empty table; other columns are kept by ``mixed_documents`` and not read by ``mix_sources``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, stash

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Bits of the hash that each histogram adds.
LEVELS = (10, 10, 10)
BITS = 30


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) by filling up: a target is the level times the weight, at most ``most``
    times the size; the level is the one at which all targets make up all sizes. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % n + 1))
    s = s.withColumn("full", most * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("w"))
    # Sources by the level at which they are full: those before are full, the rest share what is left by weight.
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything),
                       "full_before": F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                       "w_before": F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    level = (F.col("total") - F.col("full_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("level", F.when(level <= F.col("ratio"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("w"), "full")).alias("target"))


def _key(source):
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _hash(doc_id):
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return F.shiftright(h, 60 - BITS)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stash(docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), _hash(docs[id_col]).alias("h")), "sizes")


def thresholds(rows: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(k, source_size, target, whole, lo), one row a source, from (source, size, h): documents are taken ``whole``
    times, and once more those whose hash is below ``lo``."""
    goal = stash(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    goal = goal.withColumns({"k": _key(F.col("source")), "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")})
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("source")
    # Each level: sum sizes of the boundary bucket's documents by their next hash bits, find the bucket in which
    # the rest's budget runs out.
    found = goal.select("k", F.lit(0).cast("long").alias("lo"), F.col("rest").alias("left"))
    done = 0
    for bits in LEVELS:
        done += bits
        inside = rows.withColumn("k", _key(F.col("source")))
        if done > bits:
            inside = inside.join(found, "k").where((F.shiftright("h", BITS - done + bits) == F.shiftright("lo", BITS - done + bits)))
        hist = inside.groupBy("k", F.shiftright("h", BITS - done).alias("bucket")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("k").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(w)).join(found, "k")
        # The boundary bucket is the first that doesn't fit, whether or not empty ones lie before it.
        over = F.col("upto") > F.col("left")
        hist = hist.groupBy("k").agg(F.min(F.when(over, F.col("bucket"))).alias("next"), F.max(F.when(~over, F.col("upto"))).alias("used"))
        rest = F.lit(1 << BITS) if done == bits else F.col("lo")
        found = found.join(hist, "k", "left").select("k", F.coalesce(F.shiftleft(F.col("next"), BITS - done), rest.cast("long")).alias("lo"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
        found = stash(found, "bounds")
    return goal.join(found.select("k", "lo"), "k").select("k", "source_size", "target", "whole", "lo")


def _copies(most: float):
    return F.col("whole") + F.when((F.col("h") < F.col("lo")) & (F.col("whole") < most), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: float = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document."""
    rows = _sizes(docs, id_col, text_col, source_col)
    out = rows.withColumn("k", _key(F.col("source"))).join(thresholds(rows, weights, most), "k").withColumn("copies", _copies(most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Only the table of thresholds, a row a source, meets the
    texts, so these are not joined by their ids."""
    bounds = stash(thresholds(_sizes(docs, id_col, text_col, source_col), weights, most), "thresholds")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _hash(docs[id_col]).alias("h"), _key(docs[source_col].cast("string")).alias("k")).join(bounds, "k")
    return out.select("doc", F.explode(F.array_repeat(F.lit(0), _copies(most).cast("int"))).alias("copy")).select("doc.*")
