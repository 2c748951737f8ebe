"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each word is a variant of.

1. Words are counted: whole texts are split in tasks, sums of a task's words meet by word.
2. Bigrams are ordered from rare to frequent, by the number of words that have them. The letters are those of ``LETTERS``
   (90 after lower-casing), so there are 8,100 bigrams at most, which every task holds.
3. A word's gram prefix is its three rarest bigrams, with their places, and all others as frequent as the last: one
   edit spoils two neighbouring bigrams at most. Of these a dynamic program picks the two disjoint ones that are the
   rarest together, the pivots. One edit leaves one of them whole.
4. Of two words one edit apart take the one whose prefix ends with the rarer bigram, so that the other's prefix has all
   its bigrams up to there. The edit lies behind the first pivot, and then all up to that pivot's end is the same in
   both, or before the second pivot, and then all from its start on is. So a word is looked up under two keys, the part
   up to its first pivot and the part from its second on, among words posted under the parts up to and from each
   gram of their prefix. That is the strictest limit of positions that leaves no pair out.
5. Pairs that meet under a key and differ by one code point at most in length are verified by their edit distance within
   the join. Postings of a key that very many words have are dealt over several tasks.
6. A word's form is its near word of largest count, if that is twice its own at least. Roots come from doubling steps
   along forms; counts at least double on each, so there are few. A word has no more near words than there are single
   edits of it, so no join by form or word can be skewed.

Cases: null and empty texts have no words; a null id is written as an empty string before the colon; rows that are equal
count as often as they occur; a text that is one very long word is one word; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Every so many pairs of id and word lose a letter.
SPOILED = 97
#: Code points and occurrences that a word has at least.
LENGTH, LEAST = 5, 3
#: How much more frequent a form is than its variant.
FACTOR = 2
GRAM, EDITS = 2, 1
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Postings of a key that are compared in one piece, and parts over which a large key's rows learn its size.
BLOCK, SALT = 2000, 64

# In UTF-8 U+00C0 to U+00FF are the byte C3 and one of 80 to BF, and no other character has a byte C3.
_TAIL = bytes(range(0x80, 0xC0))
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or b in _TAIL else 32 for b in range(256))
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3A_5C79_B2D4


def runs(text: bytes) -> Counter:
    """How often each maximal run of letters occurs in a UTF-8 text, A-Z lower-cased."""
    out: Counter = Counter()
    for piece, n in Counter(text.translate(_LETTERS).split()).items():
        run = piece.lstrip(_TAIL)  # the rest of a character that is no letter
        if run:
            out[run] += n
    return out


def spoiled(doc_id: bytes, run: bytes) -> bytes:
    """The run, or for one in ``SPOILED`` pairs the run without one of its letters."""
    h = zlib.crc32(run, zlib.crc32(doc_id + b":"))
    if h % SPOILED:
        return run
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1:]).encode()


def count_words(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= LENGTH]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).cast(pa.binary())
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(ids, texts, strict=True):
                head = doc_id.as_py() or b""
                for run, n in runs(text.as_py() or b"").items():
                    held[spoiled(head, run)] += n
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    words = rows.mapInArrow(count, "word string, n long").where(F.char_length("word") >= LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams from rare to frequent; bounded by the alphabet's square."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.update({w[i: i + GRAM] for i in range(len(w) - GRAM + 1)})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    found = words.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(found, key=lambda r: (r["n"], r["gram"])))}


def gram_prefix(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(place, rank) of the rarest bigrams, in order of places: GRAM * EDITS + 1, and all that equal the last."""
    grams = [(p, ranks[word[p: p + GRAM]]) for p in range(len(word) - GRAM + 1)]
    last = sorted(r for _, r in grams)[GRAM * EDITS]
    return [g for g in grams if g[1] <= last]


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Places of EDITS + 1 disjoint bigrams of the least ranks in total, by dynamic programming over places."""
    # best[k]: the least total, and its places, of k disjoint bigrams among those that end by now.
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] + [None] * (EDITS + 1)
    waiting: list[tuple[int, int, tuple[int, tuple[int, ...]]]] = []
    for place, rank in prefix:
        while waiting and waiting[0][0] <= place:
            _, k, got = waiting.pop(0)
            if best[k] is None or got < best[k]:
                best[k] = got
        for k in range(EDITS + 1):
            if best[k] is not None:
                waiting.append((place + GRAM, k + 1, (best[k][0] + rank, (*best[k][1], place))))
    for _, k, got in waiting:
        if best[k] is None or got < best[k]:
            best[k] = got
    return list(best[EDITS + 1][1])


def _parts(word: str) -> tuple[list[int], list[int]]:
    """Hashes of the first k letters and of those from k on, for every k."""
    heads, tails = [0], [1]
    for c in word:
        heads.append((heads[-1] * _BASE + ord(c)) % _MODULUS)
    for c in reversed(word):
        tails.append((tails[-1] * _BASE + ord(c)) % _MODULUS)
    return [2 * h for h in heads], [2 * t + 1 for t in reversed(tails)]


def _postings(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(key, pivot, word, n, length, last): a word under the keys it is looked up by (pivot) and those it is found by."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix, (heads, tails) = gram_prefix(word, ranks), _parts(word)
                first, second = pivots(prefix)
                of = (word, n, len(word), max(r for _, r in prefix))
                out += [(heads[first + GRAM], True, *of), (tails[second], True, *of)]
                out += [(key, False, *of) for p, _ in prefix for key in (heads[p + GRAM], tails[p])]
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return words.mapInArrow(post, "key long, pivot boolean, word string, n long, length int, last int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "pivot": pa.bool_(), "word": pa.string(), "n": pa.int64(), "length": pa.int32(), "last": pa.int32()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round, for words (word, n) one edit apart."""
    posts = stash(_postings(words, gram_ranks(words)), "postings")
    # Keys with many postings are cut: each posting lies in one piece, each look-up goes to all pieces of its key.
    large = posts.where("not pivot").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    large = stash(large.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("cuts"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")), "large")
    dealt = posts.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int")).join(large, ["key", "salt"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    asked = dealt.where("pivot").select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("piece"), *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "length", "last")])
    there = dealt.where("not pivot").select("key", F.pmod(F.xxhash64("word", F.lit(1)), F.col("cuts")).cast("int").alias("piece"), "word", "n", "length", "last")
    close = (F.abs(F.col("a_length") - F.col("length")) <= EDITS) & (F.col("a_last") <= F.col("last")) & (F.col("a_word") != F.col("word")) & (F.levenshtein("a_word", "word", EDITS) == EDITS)
    pairs = asked.join(there, (asked["key"] == there["key"]) & (asked["piece"] == there["piece"]) & close).select("a_word", "a_n", "word", "n")
    both = F.array(F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")), F.struct("word", "n", F.col("a_word").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(both)).distinct()


def spelling_variants(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word."""
    words = stash(count_words(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.withColumn("takes", -F.col("best.neg") >= FACTOR * F.col("n"))
    near = near.select("word", "n_near", F.when(F.col("takes"), F.col("best.form")).alias("form"), F.when(F.col("takes"), -F.col("best.neg")).alias("form_n"))
    near = stash(near, "forms")
    # Each step takes a word's goal to its goal's goal; words whose goal has no form are done.
    steps = near.where("form is not null").select("word", F.col("form").alias("goal"))
    while True:
        onward = steps.select(F.col("word").alias("goal"), F.col("goal").alias("further"))
        steps = stash(steps.join(onward, "goal", "left").select("word", F.coalesce("further", "goal").alias("goal"), F.col("further").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    out = words.join(near, "word", "left").join(steps.select("word", F.col("goal")), "word", "left")
    return out.select("word", "form", F.coalesce("goal", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
