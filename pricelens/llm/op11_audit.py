"""Audit of how filters interact: what each removes, finds removed already and alone removes, in every order.

Each document is known by a mask: which filters it fails. In an order of the filters it is removed by the first one that
it fails. Orders are numbered lexicographically (Lehmer rank); those that begin with some filters that a mask passes
and then one that it fails are neighbours, so a mask's removal at a step covers a few intervals of ranks
(``removal_intervals``). Counts of masks, a few rows a part of the corpus, are added at the lower ends and taken off at
the upper ends; a running sum over the ranks gives what each step of each order removes. Documents meet no order.

Only counts move: a row of a hash and flags a document for the labels, then sums by text and part. A text with very
many copies is summed up before it is looked at as a whole.

Cases: null texts are empty ones; a null language is the part of the empty string; rows with the same id and text are
equals, none of them is the other's copy; a null id is nobody's smaller id, such rows never count as copies and have no
labels; of several labels of an id any 1 counts; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, stash

#: Letter of the filter that takes copies of another text; the others are conditions on the text and its words.
COPY = "E"
FILTERS = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
#: Null ids meet no label; they are dealt over so many parts of the join.
SALT = 64
SUMS = ("n", "good", "toxic")


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, from, to): in orders of these ranks, ``to`` excluded, a document that fails the filters of ``mask``
    (bit k: the k-th letter) is removed at the step, counted from 1."""
    out = []

    def follow(mask: int, unused: list[int], step: int, rank: int) -> None:
        width = factorial(n - step)
        for digit, f in enumerate(unused):
            at = rank + digit * width
            if mask >> f & 1:
                out.append((mask, step, at, at + width))
            else:
                follow(mask, unused[:digit] + unused[digit + 1:], step + 1, at)

    for mask in range(1, 1 << n):
        follow(mask, list(range(n)), 1, 0)
    return out


def failure_counts(docs: DataFrame, labels: DataFrame, filters=FILTERS, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail, copies as the last one."""
    text, words = F.col("text"), F.col("words")
    d = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_SPLIT), ""))
    mask = sum((F.when(fails(text, words), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    d = d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))
    d = d.groupBy("id", "key", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key", "part"), F.lit(SALT))).otherwise(0))
    one = lambda c: F.max(F.when(labels[c].cast("int") == 1, 1).otherwise(0))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("id")).agg(one("quality").alias("g"), one("toxic").alias("t")).withColumn("salt", F.lit(0).cast("long"))
    d = d.join(marks, ["id", "salt"], "left").withColumns({"g": F.coalesce("g", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    # Of each text and part: how many rows, the smallest id and how many rows have it. Then the smallest id of the text.
    d = d.groupBy("key", "mask", "part", "g", "t").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = F.min("least").over(Window.partitionBy("key"))
    d = d.withColumn("own", F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)).withColumn("copies", F.col("n") - F.col("own"))
    sides = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.col("copies").alias("n")))
    d = d.select("part", "g", "t", F.inline(sides))
    return d.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic")).where("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """A row for each part, order of the filters and step: see the module for what is counted."""
    spark, letters = docs.sparkSession, [*filters, COPY]
    n, orders = len(letters), ["".join(p) for p in permutations(letters)]
    counts = stash(failure_counts(docs, labels, filters, id_col, text_col, part_col), "masks")
    spans = spark.createDataFrame(removal_intervals(n), "mask int, step int, start int, stop int")  # a fixed table, some hundred rows
    ends = F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")))
    steps = counts.join(F.broadcast(spans), "mask").select("part", "step", *SUMS, F.inline(ends))
    steps = steps.groupBy("part", "step", "rank").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS])
    fails = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0))
    alone = lambda k: F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("docs"), F.array(*map(fails, range(n))).alias("fails"), F.array(*map(alone, range(n))).alias("alone"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    grid = grid.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1))
    grid = grid.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("k", F.instr(F.lit("".join(letters)), F.col("letter")))
    along = Window.partitionBy("part", "step").orderBy("rank")
    grid = grid.join(steps, ["part", "step", "rank"], "left")
    grid = grid.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(along) for c in SUMS})
    so_far = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    of: Column = F.element_at("fails", F.col("k"))
    out = grid.withColumns({"kept": F.col("docs") - so_far, "shapley": F.sum("n").over(Window.partitionBy("part", "letter"))})
    return out.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (of - F.col("n")).alias("redundant"), F.element_at("alone", F.col("k")).alias("unique_fails"),
                      F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
