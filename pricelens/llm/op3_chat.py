"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue the dialogue is rendered with that speaker as assistant and the others as
named users; the mask tells which characters the speaker wrote. A rendering is given in parts of ``PART`` turn
numbers, so that a dialogue of any length never meets in one row: all parts in order make up the rendering.

Where numbers repeat or are null, a part holds more rows; it is given in pieces of ``PART`` rows, so no row of the result
grows with the dialogue. Rows are numbered within their part by a sort that can spill. In texts and names the opening
of the marks is written ``< |im_`` and a name's line breaks are spaces, so no text can forge a turn.

Cases: a null role is a participant named ``unknown``; a null text is empty; a null turn comes first, in part -1;
turns with the same number are ordered by role, then text, and repeated rows stay; a null conversation id is a
conversation of its own; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers a part covers.
PART = 64
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|im_"), F.lit("< |im_"))


def rotate_perspectives(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, rendered, mask): one row for each participant and piece of a part. ``mask`` holds
    one 'start:end' in code points of ``rendered`` for each turn of the speaker, comma-joined."""
    t = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
                     F.translate(_safe(F.coalesce(turns[role_col].cast("string"), F.lit("unknown"))), "\n", " ").alias("who"), _safe(F.coalesce(turns[text_col].cast("string"), F.lit(""))).alias("said"))
    t = t.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")), "part": F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long")})
    people = t.groupBy("key", "who").agg(F.lit(1).alias("one")).select("key", F.col("who").alias("speaker"))
    t = t.withColumn("turn", F.coalesce("turn", F.lit(-1 << 62)))
    turn = F.struct("turn", "who", "said")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("turn", "who", "said"))
    parts = t.withColumn("piece", F.floor((place - 1) / part)).groupBy("key", "part", "piece").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    out = parts.join(people, "key")
    own = lambda x: x["who"] == F.col("speaker")
    head = lambda x: F.when(own(x), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), x["who"], F.lit("\n")))
    pieces = F.transform("turns", lambda x: F.concat(head(x), x["said"], F.lit(END)))

    def step(acc, x):
        begin = acc["at"] + F.length(head(x))
        end = begin + F.length(x["said"])
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct((end + len(END)).alias("at"), F.when(own(x), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return out.select("conv_id", "speaker", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", pieces).alias("rendered"),
                      F.array_join(F.aggregate("turns", zero, step, lambda acc: acc["spans"]), ",").alias("mask"))
