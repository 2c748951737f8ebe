"""Secret scans by grammar inference.

Base patterns find labelled credentials. From a bounded sample of the distinct ones of each kind (those with the
smallest hashes) a prefix tree is built over character classes, and states whose continuations are statistically
compatible are merged into a probabilistic automaton (red-blue merging with Hoeffding bounds). Every other
candidate string of every text is then scored by its likelihood a character under the automata against ordinary
words; those above the threshold are added as ``grammar`` spans. Base spans always stay.

A candidate is a whole run of 16 and more of the characters ``A-Z a-z 0-9 + / _ . = -`` that holds a digit and overlaps
no base span. Shorter keys without a label, and keys of letters only, are thus not looked for: at these lengths ordinary
words and names are as likely under the automata.

``ALPHA`` and ``MARGIN`` were chosen on unlabelled credentials of labelled formats (base64, prefixed keys, tokens of three
parts, identifiers, hex) and on file names, paths, dates, numbers and identifiers: merging at 0.05 lost short hex keys,
a margin of 1.0 a third of the base64 keys; ordinary text without names in capitals took such names for keys.

Cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned each
for itself; with too few credentials no grammar is learnt and only base spans are given; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Only runs of 32 and more can pass; shorter ones touch no other run.
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile("[0-9]")
#: Distinct credentials of a kind that a grammar is learnt from, at most, and at least.
SAMPLE, LEAST = 1000, 20
#: Rows that a redaction holds at once.
ROWS = 500
#: Significance of the merge test, and bits a character above ordinary text from which a candidate is a secret.
ALPHA, MARGIN, SMOOTH = 0.2, 0.4, 1e-4
#: Alphabet of the grammars: classes of characters with how many characters each has.
CLASSES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20, "s": 6}
_CLASS = {c: "d" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "H" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: "s" for c in "+/_.=-"}
_CLASS_OF = str.maketrans(_CLASS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long runs of credential characters with a digit that overlap no base span."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][0] < e:  # both are in order of their starts
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= s and _DIGIT.search(m[0]):
            out.append((s, e))
    return out


# ---------------------------------------------------------------- grammars

class Automaton:
    """Probabilistic automaton: counts of arcs and ends of every state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, list[int]]] = [{}]  # class -> [target, count]
        self.ends = [0]

    def add(self, word: str) -> None:
        at = 0
        for c in word:
            if c not in self.arcs[at]:
                self.arcs[at][c] = [len(self.arcs), 0]
                self.arcs.append({})
                self.ends.append(0)
            self.arcs[at][c][1] += 1
            at = self.arcs[at][c][0]
        self.ends[at] += 1

    def count(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.arcs[q].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether both states' outcomes may come from one distribution, followed down both branches."""
        todo = [(a, b)]
        bound = math.sqrt(math.log(2 / alpha) / 2)
        while todo:
            a, b = todo.pop()
            na, nb = self.count(a), self.count(b)
            if not na or not nb:
                continue
            most = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > most:
                return False
            for c in {*self.arcs[a], *self.arcs[b]}:
                (ta, ca), (tb, cb) = self.arcs[a].get(c, (None, 0)), self.arcs[b].get(c, (None, 0))
                if abs(ca / na - cb / nb) > most:
                    return False
                if ta is not None and tb is not None and ta != tb:
                    todo.append((ta, tb))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the tree below a state to another state."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            self.ends[into] += self.ends[tree]
            for c, (t, n) in self.arcs[tree].items():
                if c in self.arcs[into]:
                    self.arcs[into][c][1] += n
                    todo.append((self.arcs[into][c][0], t))
                else:
                    self.arcs[into][c] = [t, n]

    def merge(self, alpha: float) -> None:
        """Keep a core of states; each state that an arc of the core leads to is merged into the first
        compatible core state, or joins the core."""
        core = [0]
        while True:
            inside = set(core)
            edge = next(((q, c, t) for q in core for c, (t, _) in sorted(self.arcs[q].items()) if t not in inside), None)
            if edge is None:
                break
            q, c, t = edge
            for r in core:
                if self.compatible(r, t, alpha):
                    self.arcs[q][c][0] = r
                    self.fold(r, t)
                    break
            else:
                core.append(t)
        new = {q: i for i, q in enumerate(core)}
        self.arcs = [{c: [new[t], n] for c, (t, n) in self.arcs[q].items()} for q in core]
        self.ends = [self.ends[q] for q in core]

    def bits(self, word: str) -> float:
        """log2 likelihood a character of a class string, each class shared out over its characters."""
        at, total = 0, 0.0
        for c in word:
            arc = self.arcs[at].get(c)
            n = self.count(at)
            p = (1 - SMOOTH) * (arc[1] / n if arc and n else 0) + SMOOTH / len(CLASSES)
            total += math.log2(p / CLASSES[c])
            at = arc[0] if arc else 0
        return total / max(1, len(word))


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    out = Automaton()
    for w in sorted(words):
        out.add(w.translate(_CLASS_OF))
    out.merge(alpha)
    return out


#: Class shares of ordinary strings: words (English letter use puts a third of letters in a-f), numbers, and names in capitals.
ORDINARY = (
    {"d": 0.03, "h": 0.3, "l": 0.6, "H": 0.01, "U": 0.03, "s": 0.03},
    {"d": 0.9, "h": 0.01, "l": 0.01, "H": 0.005, "U": 0.005, "s": 0.07},
    {"d": 0.05, "h": 0.01, "l": 0.02, "H": 0.27, "U": 0.55, "s": 0.1},
)


def ordinary_bits(word: str) -> float:
    """log2 likelihood a character as a word, a number or a name in capitals, whichever is likeliest."""
    return max(sum(math.log2(shares[c] / CLASSES[c]) for c in word) for shares in ORDINARY) / max(1, len(word))


# ---------------------------------------------------------------- jobs

_FOUND = "doc_id long, spans array<struct<kind:int,start:long,end:long,value:string>>"


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, spans): base spans and candidates (kind 3) of every whole text, one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                rows = [{"kind": k, "start": s, "end": e, "value": ASSIGN.match(text, s)[2] if k == 0 else text[s:e]} for s, k, e in spans]
                rows += [{"kind": 3, "start": s, "end": e, "value": text[s:e]} for s, e in candidates(text or "", spans)]
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, _FOUND)


def learn(found: DataFrame, sample: int = SAMPLE) -> list[Automaton]:
    """Grammars of the labelled credentials by kind, from a bounded sample."""
    values = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where("kind < 3").distinct()
    rows = [r for k in range(3) for r in values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()]  # at most 3 * sample
    grammars = []
    for k in range(3):
        words = [r.value for r in rows if r.kind == k]
        if len(words) >= LEAST:
            grammars.append(infer(words))
    return grammars


def _decider(grammars: list[Automaton], margin: float):
    """Whether a candidate is a secret."""

    def secret(value: str) -> bool:
        word = value.translate(_CLASS_OF)
        plain = ordinary_bits(word)
        return any(g.bits(word) - plain >= margin for g in grammars)

    return secret


def secret_spans(docs: DataFrame, id_col="doc_id", text_col="text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans): base and grammar spans with kinds and values, ordered by start, then kind."""
    found = stash(scan(docs, id_col, text_col), "spans")
    secret = _decider(learn(found), margin)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted((x for x in rows if x["kind"] < 3 or secret(x["value"])), key=lambda x: (x["start"], x["kind"])) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.column(1).type)], ["doc_id", "spans"])

    return found.mapInArrow(work, _FOUND)


def cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each (start, end) replaced by ``mark``; of overlapping spans the later one only extends the cut."""
    at, out = 0, []
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str, id_col="doc_id", text_col="text", length_col: str | None = "n_chars", margin: float = MARGIN) -> DataFrame:
    """``docs`` with a mark in place of every span; a changed text's length is updated in ``length_col``.

    The grammars are learnt in a first pass, then each row is scanned again where it lies: texts are not shuffled,
    and null or repeated ids need no key."""
    secret = _decider(learn(stash(scan(docs, id_col, text_col), "spans")), margin)
    names = docs.columns
    t, n = names.index(text_col), names.index(length_col) if length_col in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        more = [(s, e) for s, e in candidates(text, base) if secret(text[s:e])]
        return cut(text, sorted([(s, e) for s, _, e in base] + more), mark) if base or more else text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                cols = list(part.columns)
                old = cols[t].to_pylist()
                new = [clean(x) for x in old]
                cols[t] = pa.array(new, cols[t].type)
                if n is not None:
                    cols[n] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, cols[n].to_pylist(), strict=True)], cols[n].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(work, docs.schema)


def joined(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)


def base_digest(spans: list[dict]) -> str:
    return hashlib.sha256(joined([x for x in spans if x["kind"] < 3]).encode()).hexdigest()
