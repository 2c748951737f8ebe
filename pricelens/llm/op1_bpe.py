"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's BPE encoding is fixed by the last token of each of its prefixes: the last token of a prefix is the
one vocabulary suffix whose left neighbour (the last token of what remains) may stand before it. So distinct
words are put into a trie and walked depth first; each node gets its last token from its ancestors' states,
once for all words that share the prefix. Decoding joins the token strings as the tokenizers library does for
a tokenizer without decoder.

Cases: null and empty texts have no tokens and decode to the empty string; texts of any length are encoded
whole; special-token strings in a text become their ids; other columns are not read; repeated rows are encoded
each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Words and chunks that a Python worker remembers before it starts anew (bounds memory, not the result).
CACHE_ENTRIES = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Python's split() takes these four as white space, the tokenizer's pattern doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_chars() -> dict[str, int]:
    """Byte-level alphabets show printable Latin-1 bytes as themselves and the rest from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encodes words of a word-end BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        vocab = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        to_byte = _byte_chars()
        inner, final = {}, {}  # a token inside a word, and one that ends it, by bytes
        for t, i in vocab.items():
            ends = t.endswith(self.end)
            chars = t[: -len(self.end)] if ends else t
            if chars and all(c in to_byte for c in chars):
                (final if ends else inner)[bytes(to_byte[c] for c in chars)] = i
        self.inner, self.final = inner, final
        self.size = {i: len(b) for d in (inner, final) for b, i in d.items()}
        self.longest = max(map(len, [*inner, *final]))
        self.rank, self.parts = {}, {}
        for r, merge in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            self.rank[left, right] = r
            self.parts[made] = (left, right, r)
        self.n_ids = 1 + max([*vocab.values(), *self.special.values()])
        self.fits_seen: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces of a token at one edge, smallest first, each with the rank of the merge that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' symbols together gives just these two tokens."""
        key = left * self.n_ids + right
        known = self.fits_seen.get(key)
        if known is None:
            ls, rs, i, j, known = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = ls[i], rs[j]
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    known = False
                    break
                if x_until == y_until == float("inf"):
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.fits_seen) > 2_000_000:
                self.fits_seen.clear()
            self.fits_seen[key] = known
        return known

    def _last(self, word: bytes, n: int, states: list[int], table: dict[bytes, int]) -> int:
        """The last token of word[:n], from the states of its shorter prefixes."""
        for k in range(min(n, self.longest), 0, -1):
            t = table.get(word[n - k: n])
            if t is not None and (k == n or self.fits(states[n - k - 1], t)):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Depth-first walk of the trie of ``words``: in sorted order each word shares the open path up to its
        common prefix with the one before, and only the nodes below that are new."""
        path, states = b"", []
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            n, keep = len(raw), 0
            most = min(len(states), n - 1)
            if path[:most] == raw[:most]:
                keep = most
            else:
                while path[keep] == raw[keep]:
                    keep += 1
            del states[keep:]
            for i in range(keep, n - 1):
                states.append(self._last(raw, i + 1, states, self.inner))
            path = raw
            token, ids = self._last(raw, n, states, self.final), []
            while True:
                ids.append(token)
                n -= self.size[token]
                if not n:
                    break
                token = states[n - 1]
            yield word, tuple(ids[::-1])

    # ------------------------------------------------------------ texts

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special id, chunks after it) of a normalised text; chunks are what white space separates."""
        special = None
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                special = self.special[part]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            odd = any(c in part for c in _ODD_SPACE)
            part = part.lower()
            yield special, ([x for x in regex.split(r"\s+", part) if x] if odd else part.split())
            special = None


class Encoder:
    """Encodes texts batch by batch; what it has learnt about words and chunks is kept within bounds."""

    def __init__(self, path: str) -> None:
        self.bpe = TrieBpe(path)
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.sp_ids = {i: np.uint32(i).tobytes() for i in self.bpe.special.values()}

    def learn(self, new: set[str]) -> None:
        bpe = self.bpe
        pieces = {c: bpe.pattern.findall(c) for c in new}
        words = {w for ws in pieces.values() for w in ws}.difference(bpe.words)
        bpe.words.update(bpe.encode_words(words))
        for c, ws in pieces.items():
            ids = [i for w in ws for i in bpe.words[w]]
            self.ids[c] = np.array(ids, dtype="<u4").tobytes()
            self.shown[c] = " ".join(map(bpe.text.__getitem__, ids))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        if len(self.ids) > CACHE_ENTRIES or len(self.bpe.words) > CACHE_ENTRIES:
            self.ids.clear()
            self.shown.clear()
            self.bpe.words.clear()
        cut = [list(self.bpe.segments(t or "")) for t in texts]
        new: set[str] = set()
        for segs in cut:
            for _, cs in segs:
                new.update(cs)
        new.difference_update(self.ids.keys())
        if new:
            self.learn(new)
        out, get, show = [], self.ids.__getitem__, self.shown.__getitem__
        for segs in cut:
            if len(segs) == 1:
                cs = segs[0][1]
                out.append((b"".join(map(get, cs)), " ".join(map(show, cs))))
                continue
            ids, shown = [], []
            for special, cs in segs:
                if special is not None:
                    ids.append(self.sp_ids[special])
                    shown.append(self.bpe.text[special])
                ids.extend(map(get, cs))
                shown.extend(map(show, cs))
            out.append((b"".join(ids), " ".join(shown)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of a column with about so many bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=0)).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if j > i:
            yield i, texts.slice(i, j - i).to_pylist()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``ids`` (array of int) and ``decoded`` text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, texts in _slices(batch.column(1)):
                got = enc.encode(texts)
                ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(got)), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())],
                    ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count and digests of ids and of the decoded text; ids never leave the worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids, shown = [], [], []
            for _, texts in _slices(batch.column(1)):
                for b, d in enc.encode(texts):
                    n.append(len(b) // 4)
                    ids.append(sha(b))
                    shown.append(sha(d.encode("utf-8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, SCHEMA)


def decode(ids: Iterable[int], vocabulary: str) -> str:
    """Text of token ids: without a decoder the library joins token strings by a space."""
    return " ".join(map(encoder(vocabulary).bpe.text.__getitem__, ids))
