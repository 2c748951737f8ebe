"""Interpolated modified Kneser-Ney models of order two or three, counted in Spark and stored as sorted hash arrays in
the shared folder, which workers map into memory.

Counting is a chain of groupings over packed blocks of n-grams. A task sums what it has read, cuts it by hash range and
hands on one block a range; a range's blocks are summed in one task, which writes one file and hands on what the next
lower order needs:

words -> ids; trigrams -> counts, contexts -> pairs by how many words stand before them -> words likewise.

The number of ranges follows from the number of tokens, so a range holds about ``RANGE`` entries whatever the corpus.
Followers of a pair of very common words are dealt over several ranges, so that no context must fit into one. Files are
written by rename: a task that runs again or twice does no harm. Counts have 64 bits.

A file holds hashes sorted within buckets: their leading bits select range and bucket, the next 32 are stored, so one
unseen n-gram in a thousand million is taken for a stored one. The arrays need a shared folder that workers can map: a
file path, such as a mount.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, scratch_path, word_hashes, word_spans

#: Tokens that a task gathers before it sums them; entries that a hash range shall hold; files a worker keeps mapped.
FLUSH, RANGE, MAPS = 3_000_000, 1_000_000, 4096
#: N-grams that are hashed at a time; ranges of pairs, as a power of two, for each range of words' rows.
SLICE, ROW_PART = 1 << 18, 3
#: Bytes of mapped files whose pages a worker keeps; parts of contexts that are looked up at a time.
PAGES, LOOKUPS = 256 << 20, 1 << 20
#: Shuffle partitions for each hash range, so that seldom two ranges meet in a task.
SPREAD = 4
END = np.uint64(0x0E4D0F7E57000001)
#: Ids of what stands before a text's first and second token; ids of words begin at the number of word ranges.
NONE, START = 0, 1
_BLOCK = "shard int, n long, body binary"
_COLS = ["shard", "n", "body"]
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def local_folder(path: str) -> str:
    if "://" in path or path.startswith("file:"):
        if not path.startswith("file:"):
            raise ValueError(f"workers map the model's arrays into memory: {path} is not a mounted folder")
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and where each text's tokens begin (texts + 1)."""
    starts, ends, first = word_spans(data, offsets)
    h = np.insert(word_hashes(data, starts, ends), first[1:], END)
    return h, first + np.arange(len(first))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+ from how many entries have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 0.95, 1.9, 2.85])


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v.astype(np.uint64) + _PRIME) * _PRIME + w.astype(np.uint64))


def _first_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _few(n_counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return np.array([*((n_counts == m).sum() for m in (1, 2, 3, 4)), (n_counts >= 3).sum()], np.int64)


# ---------------------------------------------------------------- blocks

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, the first one ascending, as compressed byte planes."""
    out = []
    for k, a in enumerate(arrays):
        a = np.diff(a, prepend=a[:1] * 0) if k == 0 else a
        width = max(1, (int(a.max()).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(len(a), 8)[:, :width].T
        out += [bytes([width]), np.ascontiguousarray(planes).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(body: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True), np.uint8)
    out, at = [], 0
    for i in range(k):
        width = int(raw[at])
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = raw[at + 1: at + 1 + width * n].reshape(width, n).T
        at += 1 + width * n
        a = a.view("<u8").ravel().astype(np.int64)
        out.append(np.cumsum(a) if i == 0 else a)
    return out


def _rows(table: pa.Table, k: int) -> list[np.ndarray]:
    parts = [unpack(b, n, k) for b, n in zip(table.column("body").to_pylist(), table.column("n").to_pylist(), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, n, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], _COLS)


def _dealt(shard: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A block for each range, rows in their order."""
    return [(s, len(i), pack(*(x[i] for x in arrays))) for s, i in by_range(shard)]


def _note(shard: int, numbers: np.ndarray) -> tuple[int, int, bytes]:
    """Numbers that travel along with the blocks, under a range below 0."""
    return shard, len(numbers), pack(np.arange(len(numbers)), numbers)


def _numbers(shard: int, numbers: list[int]) -> pa.Table:
    return pa.table([pa.array([shard], pa.int32()), pa.array([numbers], pa.list_(pa.int64()))], names=["shard", "numbers"])


def _added(table: pa.Table) -> np.ndarray:
    return sum(unpack(b, n, 2)[1] for b, n in zip(table.column("body").to_pylist(), table.column("n").to_pylist(), strict=True))


def summed(ids: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of ids in order, and the sum of their counts (1 each if None). The list is emptied, so that its
    arrays can go before the keys are sorted."""
    if not len(ids[0]):
        return ids, np.zeros(0, np.int64)
    width = len(ids)
    names = np.unique(np.concatenate([np.unique(x) for x in ids]))
    bits = max(1, (len(names) - 1).bit_length())
    if bits * width > 64:
        order = np.lexsort(ids[::-1])
        cols = [x[order] for x in ids]
        first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in cols]))))
        return [x[first] for x in cols], np.add.reduceat(np.ones(len(order), np.int64) if counts is None else counts[order], first)
    key = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        key <<= np.uint64(bits)
        key |= np.searchsorted(names, x).view(np.uint64)
    del x
    ids.clear()
    if counts is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, counts = key[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts, first)
    key, mask = key[first], np.uint64((1 << bits) - 1)
    return [names[(key >> np.uint64(bits * (width - 1 - i)) & mask).astype(np.int64)] for i in range(width)], total


# ---------------------------------------------------------------- files

def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other, whole numbers as narrow as they fit, each from a multiple of eight bytes; a header
    of sixteen numbers tells lengths and widths."""
    arrays = tuple(a if a.dtype == np.uint64 or not len(a) else a.astype(np.min_scalar_type(int(a.max()))) for a in arrays)
    head = np.zeros(16, np.int64)
    head[: len(arrays)] = [len(a) for a in arrays]
    head[8: 8 + len(arrays)] = [a.itemsize for a in arrays]
    tmp = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(tmp, "wb") as f:
        for a in (head, *arrays):
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 8))
    os.replace(tmp, f"{folder}/{name}")


def _read(folder: str, name: str) -> tuple[mmap.mmap, list[np.ndarray]] | None:
    path = f"{folder}/{name}"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    raw = np.frombuffer(pages, np.uint8)
    head, at, out = raw[:128].view(np.int64).tolist(), 128, []
    for n, width in zip(head[:8], head[8:], strict=True):
        if width:
            out.append(raw[at: at + n * width].view(f"u{width}"))
            at += n * width + (-n * width % 8)
    return pages, out


def save_hashed(folder: str, name: str, keys: np.ndarray, values: np.ndarray, skip: int) -> None:
    """Values (1 and more) by 64-bit hashes, of which the first ``skip`` bits are the range's."""
    bits = max(1, min(32 - skip, (max(1, len(keys) // 8)).bit_length()))
    rest = keys << np.uint64(skip)
    order = np.argsort(rest)
    rest, values = rest[order], values[order]
    start = np.searchsorted(_first_bits(rest, bits), np.arange((1 << bits) + 1)).astype(np.uint32)
    large = np.flatnonzero(values >= 255)
    codes = np.where(values < 255, values, 255).astype(np.uint8)
    _write(folder, name, np.array([bits]), start, (rest << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), codes, large, values[large])


#: Files that this worker process has mapped.
_MAPS: dict[tuple[str, str], tuple[mmap.mmap, list[np.ndarray]] | None] = {}
#: Those whose pages it may hold.
_HELD: dict[tuple[str, str], mmap.mmap] = {}


def _mapped(folder: str, name: str) -> list[np.ndarray] | None:
    """A file's arrays. Pages are let go of when files of ``PAGES`` bytes have been visited, so that a worker doesn't come
    to hold the whole model; they are read again where needed, as a rule from the system's cache."""
    key = folder, name
    if key not in _MAPS:
        if len(_MAPS) >= MAPS:
            _MAPS.clear()
            _HELD.clear()
        _MAPS[key] = _read(folder, name)
    if _MAPS[key] is None:
        return None
    pages, out = _MAPS[key]
    if key not in _HELD:
        if sum(map(len, _HELD.values())) + len(pages) > PAGES:
            for old in _HELD.values():
                old.madvise(mmap.MADV_DONTNEED)
            _HELD.clear()
        _HELD[key] = pages
    return out


def by_range(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places of its entries) for every range that occurs."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65536 else shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
    for a, b in zip(at, [*at[1:], len(order)], strict=False):
        yield int(shard[order[a]]), order[a:b]


def find_hashed(folder: str, kind: str, shard: np.ndarray, keys: np.ndarray, skip: int) -> np.ndarray:
    """Values of hashes, 0 for those that aren't stored; each file is visited once."""
    out = np.zeros(len(keys), np.int64)
    for s, i in by_range(shard):
        got = _mapped(folder, f"{kind}-{s}")
        if got is None or not len(got[2]):
            continue
        (bits,), start, stored, codes, places, large = got
        rest = keys[i] << np.uint64(skip)
        bucket = _first_bits(rest, int(bits))
        want = (rest << np.uint64(int(bits)) >> np.uint64(32)).astype(np.uint32)
        lo, end = start[bucket].astype(np.int64), start[bucket + 1].astype(np.int64)
        hi, todo = end.copy(), np.flatnonzero(lo < end)
        while len(todo):  # all buckets' binary searches side by side
            mid = (lo[todo] + hi[todo]) >> 1
            less = stored[mid] < want[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        hit = np.flatnonzero(lo < end)
        hit = hit[stored[lo[hit]] == want[hit]]
        value = codes[lo[hit]].astype(np.int64)
        much = np.flatnonzero(value == 255)
        if len(much):
            value[much] = large[np.searchsorted(places, lo[hit[much]])]
        out[i[hit]] = value
    return out


# ---------------------------------------------------------------- model

@dataclass
class KneserNey:
    """Where a model's arrays are, its ranges and totals."""

    folder: str
    order: int
    word_bits: int
    bits: int = 0  # of the ranges of pairs and trigrams
    row_bits: int = 0  # of the ranges of words' rows
    limit: int = RANGE  # followers of a context from which it is dealt over several ranges
    n_words: int = 0
    n_tokens: int = 0
    texts: int = 0
    pairs: int = 0  # distinct pairs
    d: list[np.ndarray] = field(default_factory=list)  # discounts of words, pairs, trigrams
    few: np.ndarray | None = None  # words with 1, 2, 3+ different ones before them

    @property
    def held(self) -> float:
        """Mass that the word level hands down."""
        return float(self.d[0][1:] @ self.few) / self.pairs if self.pairs else 1.0

    @property
    def word_ranges(self) -> int:
        return 1 << self.word_bits

    @property
    def row_ranges(self) -> int:
        return 1 << self.row_bits

    # -------------------------------------------------------- words

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of words; (-1, 0) for words that training didn't have."""
        u, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        cuts = np.searchsorted(_first_bits(u, self.word_bits), np.arange(self.word_ranges + 1)).tolist()
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            got = _mapped(self.folder, f"words-{s}") if b > a else None
            if got is not None:
                keys, rank, n = got
                at = np.minimum(np.searchsorted(keys, u[a:b]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == u[a:b])
                found = rank[at[hit]].astype(np.int64)
                ids[a + hit], counts[a + hit] = (found + 1) * self.word_ranges + s, n[found]
        return ids[back], counts[back]

    def word_rows(self, ids: np.ndarray) -> np.ndarray:
        """For each id: (sum of its pairs' counts, pairs with count 1, 2, 3+, distinct words before it)."""
        u, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(u), 5), np.int64)
        real = np.flatnonzero(u >= 0)
        for s, k in by_range(u[real] % self.row_ranges):
            got = _mapped(self.folder, f"rows-{s}")
            if got is not None:
                rows, i = got[0].reshape(-1, 5), real[k]
                i = i[u[i] // self.row_ranges < len(rows)]
                out[i] = rows[u[i] // self.row_ranges]
        return out[back]

    def tally(self, ids: np.ndarray) -> np.ndarray:
        """How often words occur, by their ids; a text's start occurs once a text."""
        u, back = np.unique(ids, return_inverse=True)
        out = np.full(len(u), self.texts, np.int64)
        for s in np.unique(u[u >= self.word_ranges] % self.word_ranges).tolist():
            i = np.flatnonzero((u >= self.word_ranges) & (u % self.word_ranges == s))
            out[i] = _mapped(self.folder, f"words-{s}")[2][u[i] // self.word_ranges - 1]
        return out[back]

    # -------------------------------------------------------- ranges

    def pair_range(self, h: np.ndarray) -> np.ndarray:
        return _first_bits(h, self.bits)

    def parts(self, cu: np.ndarray, cv: np.ndarray) -> np.ndarray:
        """Over how many ranges (a power of two) the followers of (u, v) are dealt, from both words' counts."""
        most = np.minimum(cu, cv) // self.limit
        return np.left_shift(1, np.ceil(np.log2(most + 1)).astype(np.int64))

    def context_hash(self, uv: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.where(part > 0, mix(uv + part.astype(np.uint64) * _PRIME), uv)

    @staticmethod
    def part_of(w: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return (mix(w.astype(np.uint64) * _PRIME) & (parts - 1).astype(np.uint64)).astype(np.int64)

    # -------------------------------------------------------- probabilities

    def word_level(self, cont: np.ndarray, below: np.ndarray | float) -> np.ndarray:
        """Probability of words from how many distinct words stand before them, over a lower distribution."""
        if not self.pairs:
            return np.zeros(len(cont)) + below
        return (cont - self.d[0][np.minimum(cont, 3)]) / self.pairs + self.held * below

    @staticmethod
    def _level(count: np.ndarray, total: np.ndarray, mass: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
        """One level over a lower one, from each context's total and the mass that it hands down."""
        some = np.maximum(total, 1)
        return np.where(total > 0, (count - d[np.minimum(count, 3)]) / some + mass / some * below, below)

    def contexts(self, uv: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """(total, n1, n2, n3) of what follows pairs, over all ranges they are dealt over, ``LOOKUPS`` at a time."""
        out, ends, a = np.zeros((len(uv), 4), np.int64), np.cumsum(parts), 0
        while a < len(uv):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - parts[a] + LOOKUPS, side="right")))
            out[a:b] = self._contexts(uv[a:b], parts[a:b])
            a = b
        return out

    def _contexts(self, uv: np.ndarray, parts: np.ndarray) -> np.ndarray:
        at = np.repeat(np.arange(len(uv)), parts)
        first = np.cumsum(parts) - parts
        h = self.context_hash(uv[at], np.arange(len(at)) - first[at])
        shard = self.pair_range(h)
        code = find_hashed(self.folder, "contexts", shard, h, self.bits)
        rows = np.zeros((len(at), 4), np.int64)
        hit = np.flatnonzero(code)
        for s, i in by_range(shard[hit]):
            rows[hit[i]] = _mapped(self.folder, f"kinds-{s}")[0].reshape(-1, 4)[code[hit[i]] - 1]
        return np.add.reduceat(rows, first, axis=0)

    def of_words(self, hashes: np.ndarray, below: np.ndarray | float | None = None) -> np.ndarray:
        """The word level's probabilities, over an even distribution if none is given."""
        rows = self.word_rows(self.words(hashes)[0])
        return self.word_level(rows[:, 4], 1.0 / (self.n_words + 1) if below is None else below)

    def levels(self, hashes: np.ndarray, starts: np.ndarray, words=None) -> tuple[np.ndarray, np.ndarray]:
        """(count, probability after the tokens before it in its text) of each token; ``words`` gives another word level
        from the sorted distinct token hashes."""
        uniq, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.words(uniq)
        rows = self.word_rows(ids)
        p = (self.word_level(rows[:, 4], 1.0 / (self.n_words + 1)) if words is None else words(uniq))[back]
        w, c, first = ids[back], counts[back], starts[:-1]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[first] = START
        begin, total, mass = self.word_rows(np.array([START])), np.empty(len(w), np.int64), np.empty(len(w))
        total[1:], mass[1:] = rows[:, 0][back[:-1]], (rows[:, 1:4] @ self.d[1][1:])[back[:-1]]
        total[first], mass[first] = begin[:, 0], begin[:, 1:4] @ self.d[1][1:]
        del rows, uniq, back
        count = np.zeros(len(w), np.int64)
        i = np.flatnonzero((w >= 0) & (v >= 0))
        h = pair_hash(v[i], w[i])
        count[i] = find_hashed(self.folder, "pairs", self.pair_range(h), h, self.bits)
        p = self._level(count, total, mass, self.d[1], p)
        del h, total, mass
        if self.order < 3:
            return c, p
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[first] = -1
        i = np.flatnonzero((u >= 0) & (v >= 0))
        parts = self.parts(np.where(u[i] == START, self.texts, c[i - 2]), c[i - 1])
        uv = pair_hash(u[i], v[i])
        count = np.zeros(len(i), np.int64)
        k = np.flatnonzero(w[i] >= 0)
        own = self.context_hash(uv[k], self.part_of(w[i[k]], parts[k]))
        count[k] = find_hashed(self.folder, "trigrams", self.pair_range(own), pair_hash(uv[k], w[i[k]]), 0)
        del own, k, u, v
        same, again = np.unique(uv, return_inverse=True)
        one = np.zeros(len(same), np.int64)
        one[again] = parts
        del uv, parts
        ctx = self.contexts(same, one)
        p[i] = self._level(count, ctx[:, 0][again], (ctx[:, 1:4] @ self.d[2][1:])[again], self.d[2], p[i])
        return c, p


# ---------------------------------------------------------------- training

def _gathered(batches: Iterator[pa.RecordBatch], columns, blocks) -> Iterator[pa.RecordBatch]:
    """Blocks of what ``columns`` makes of the texts, summed over ``FLUSH`` tokens. ``blocks`` gets the only list of the
    arrays, so that it can let go of them."""
    held, size = [], 0

    def joined() -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return out

    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            held.append(columns(*tokens(data, offsets)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield _batch(blocks(joined()))
                size = 0
    if size:
        yield _batch(blocks(joined()))


def train(docs: DataFrame, text_col: str = "text", order: int = 3, entries: int = RANGE) -> KneserNey:
    """Count all texts of ``docs``. A hash range is to hold about ``entries`` n-grams."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = local_folder(scratch_path(spark, "ngrams"))
    os.makedirs(folder)
    src = docs.select(docs[text_col].cast("string").alias("text"))
    model = KneserNey(folder, order, max(3, src.rdd.getNumPartitions().bit_length() - 2), limit=entries)

    def word_blocks(cols: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        keys, counts = np.unique(cols[0], return_counts=True)
        return _dealt(_first_bits(keys, model.word_bits), keys, counts)

    def count_words(batches):
        yield from _gathered(batches, lambda h, at: (h,), word_blocks)

    def merge_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = _rows(table, 2)
        keys = keys.view(np.uint64)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        often = np.lexsort((keys, -counts))  # small ids for frequent words
        rank = np.empty(len(keys), np.int64)
        rank[often] = np.arange(len(keys))
        _write(folder, f"words-{s}", keys, rank, counts[often])  # an id is its rank and range together
        end = int(np.searchsorted(keys, END))
        texts = int(counts[end]) if end < len(keys) and keys[end] == END else 0
        return _numbers(s, [len(keys), int(counts.sum()), texts])

    numbers = "shard int, numbers array<long>"
    got = src.mapInArrow(count_words, _BLOCK).groupBy("shard").applyInArrow(merge_words, numbers).collect()  # a row a range of words
    model.n_words, model.n_tokens, model.texts = (sum(r.numbers[i] for r in got) for i in range(3))
    model.bits = max(3, (-(-model.n_tokens // entries) - 1).bit_length())
    # A common word has a row from nearly every range, so what meets in a range of rows grows with ROW_PART ranges only.
    model.row_bits = max(model.word_bits, model.bits - ROW_PART)

    def known(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return model.words(h)[0], np.diff(at)

    def contexts(cols: list[np.ndarray]) -> list[np.ndarray]:
        """Columns of n-grams from the tokens' ids and the texts' lengths."""
        w, sizes = cols
        cols.clear()
        first = np.cumsum(sizes) - sizes
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[first] = START
        if order == 2:
            return [v, w]
        u = np.empty_like(w)
        u[1:] = v[:-1]
        u[first] = NONE
        return [u, v, w]

    def shared(u, v, w) -> np.ndarray:
        """Hash of the part of its context that a trigram belongs to."""
        return model.context_hash(pair_hash(u, v), model.part_of(w, model.parts(model.tally(u), model.tally(v))))

    def blocks(cols: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        cols, n = summed(contexts(cols))
        hashed = shared if order == 3 else pair_hash
        shard = [model.pair_range(hashed(*(x[a: a + SLICE] for x in cols))) for a in range(0, len(n), SLICE)]
        return _dealt(np.concatenate(shard), *cols, n)

    def count_grams(batches):
        yield from _gathered(batches, known, blocks)

    def merge_trigrams(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        *cols, n = _rows(table, 4)
        (u, v, w), n = summed(cols, n)
        real = u != NONE
        out = _dealt(model.pair_range(pair_hash(v[~real], w[~real])), v[~real], w[~real], n[~real])
        u, v, w, n = u[real], v[real], w[real], n[real]
        if len(u):
            uv = pair_hash(u, v)
            save_hashed(folder, f"trigrams-{s}", pair_hash(uv, w), n, 0)
            h = shared(u, v, w)
            by = np.argsort(h)
            first = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
            rows = np.stack([np.add.reduceat(x[by].astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)], 1)
            if rows.max() < 1 << 16:
                packed, kind, times = np.unique(rows @ (1 << np.array([48, 0, 16, 32])), return_inverse=True, return_counts=True)
                packed = packed.view(np.uint64)
                kinds = np.stack([(packed >> np.uint64(b) & np.uint64(0xFFFF)).astype(np.int64) for b in (48, 0, 16, 32)], 1)
            else:
                kinds, kind, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")
            code = np.empty(len(often), np.int64)
            code[often] = np.arange(1, len(often) + 1)
            save_hashed(folder, f"contexts-{s}", h[by][first], code[kind.ravel()], model.bits)
            _write(folder, f"kinds-{s}", kinds[often].ravel())
            (v, w), m = summed([v, w])
            out += _dealt(model.pair_range(pair_hash(v, w)), v, w, m)
        return pa.Table.from_batches([_batch([*out, _note(-3, _few(n))])])

    def merge_pairs(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        if s < 0:
            return pa.Table.from_batches([_batch([_note(s, _added(table))])])
        *cols, n = _rows(table, 3)
        (v, w), n = summed(cols, n)
        save_hashed(folder, f"pairs-{s}", pair_hash(v, w), n, model.bits)
        ids = np.union1d(v, w)
        vi, wi = np.searchsorted(ids, v), np.searchsorted(ids, w)
        sums = [np.bincount(i, x, len(ids)).astype(np.int64) for i, x in ((vi, n), (vi, n == 1), (vi, n == 2), (vi, n >= 3), (wi, n > 0))]
        return pa.Table.from_batches([_batch([*_dealt(ids % model.row_ranges, ids, *sums), _note(-2, _few(n))])])

    def merge_rows(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        if s < 0:
            return _numbers(s, _added(table).tolist())
        rows, top = np.zeros((0, 5), np.int64), 0
        for body, n in zip(table.column("body"), table.column("n").to_pylist(), strict=True):
            ids, *sums = unpack(body.as_py(), n, 6)
            at = ids // model.row_ranges
            top = max(top, int(at[-1]) + 1)
            if top > len(rows):
                rows = np.concatenate((rows, np.zeros((max(len(rows) // 2, top - len(rows)), 5), np.int64)))
            for k, x in enumerate(sums):
                rows[at, k] += x  # a block has a word once
        rows = rows[:top]
        _write(folder, f"rows-{s}", rows.ravel())
        return _numbers(s, [*_few(rows[:, 4]).tolist(), int(rows[:, 4].sum())])

    n = SPREAD << model.bits
    grams = src.mapInArrow(count_grams, _BLOCK)
    if order == 3:
        grams = grams.repartition(n, "shard").groupBy("shard").applyInArrow(merge_trigrams, _BLOCK)
    got = grams.repartition(n, "shard").groupBy("shard").applyInArrow(merge_pairs, _BLOCK).groupBy("shard").applyInArrow(merge_rows, numbers).collect()  # a row a range of rows
    few = {k: np.zeros(6, np.int64) for k in (0, -2, -3)}
    for r in got:
        few[min(r.shard, 0)][: len(r.numbers)] += np.array(r.numbers)
    model.d = [discounts(few[k][:4]) for k in (0, -2, -3)]
    model.pairs = int(few[0][5])
    model.few = few[0][[0, 1, 4]]
    return model
