"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``RULES`` is the table: metric, comparison, threshold. Metrics are Spark expressions over the whole text; the
projection first makes word and line arrays, then the metrics, then the rules.

Cases: a null text counts as empty and, having no words, fails the base rule; very long texts are judged whole;
tables may have further columns (only id and text are read); repeated rows are judged each for itself; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT

#: Function words of the four languages (fixed values).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "with", "le", "la", "les", "de", "et", "des", "un", "der", "die", "und", "den", "das", "ist", "el", "los", "en", "que", "una", "del")
#: (metric, comparison, threshold): a text is kept if every row holds.
RULES = (
    ("n_words", ">=", 20),
    ("n_words", "<=", 1_000_000),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 12.0),
    ("symbol_ratio", "<=", 0.5),
    ("stop_word_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.4),
    ("bullet_line_ratio", "<=", 0.9),
    ("ellipsis_line_ratio", "<=", 0.3),
)
WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text.

    Window hashes tell texts without a repeat (distinct hashes mean distinct windows); only for the others the hashes
    are sorted with their places, the words of neighbours with the same hash compared, and the places of repeated
    windows joined up."""
    n = F.size(words)
    places = F.sequence(F.lit(1), n - (WINDOW - 1))

    def covered(ws: Column) -> Column:
        keyed = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.slice(ws, i, WINDOW)).alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda k, x: F.coalesce((F.get(s, k)["h"] == x["h"]) & (F.slice(ws, F.get(s, k)["i"], WINDOW) == F.slice(ws, x["i"], WINDOW)), F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])

        at = _let(keyed, lambda s: F.array_sort(twice(s)))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW + 1, 0).when(F.size(F.array_distinct(hashes)) == n - (WINDOW - 1), 0).otherwise(covered(words)).cast("long")


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    n = F.size(words).cast("long")
    n_lines = F.greatest(F.size(lines), F.lit(1))
    chars = F.length(F.translate(text, _SPACES, "")).cast("long")
    share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) / n_lines
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "mean_word_chars": chars / F.greatest(n, F.lit(1)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "bullet_line_ratio": share(r"^[ \t]*[-*•]"),
        "ellipsis_line_ratio": share(r"(\.\.\.|…)[ \t\r]*$"),
    }


def compile_rules(rules=RULES) -> Column:
    ops = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
    verdict = F.lit(True)
    for metric, op, threshold in rules:
        verdict = verdict & ops[op](F.col(metric), F.lit(threshold))
    return verdict


def quality_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` as struct column ``doc`` with every metric, ``base_failed`` and ``kept``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("_text"),
                       F.array_remove(F.split(text, WORD_SPLIT), "").alias("_words"),
                       F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, _SPACES, "") != "").alias("_lines"))
    made = metrics(F.col("_text"), F.col("_words"), F.col("_lines"))
    out = base.select("doc", *[c.alias(k) for k, c in made.items()])
    n = F.greatest("n_words", F.lit(1))
    out = out.withColumns({
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    # Row ids are never negative. They keep a later filter on ``kept`` above this projection: pushed below, it would
    # hold every metric's whole expression over again, and the optimizer wouldn't end.
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules) & (F.monotonically_increasing_id() >= 0))
