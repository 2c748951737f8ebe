"""Filter audit, shards and spelling variants against plain Python, on odd rows and on the given documents."""

import random
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pricelens.llm import op11_audit, op12_shards, op13_variants, queries

from .brute import WORD

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "A a", "ABC DEF " * 120, "plain words " * 150, "price $5 & more " * 80, "word " * 30_000, " nb sp \x1c  ", "Zürich ÉCOLE ΑΣ “quoted” " * 5, "é" * 40 + "́x"]
DOCS = "doc_id long, text string, lang string, mask int, n long, size long, digest string, part string, word string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, p, 7, 7, 7, "x", "x", "x", "x") for i, t, p in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    out = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(ODD)]
    out += [(i + 3, t, "en") for i, t in enumerate(ODD)] + [(None, t, "fr") for t in ODD[4:8]] + [(5, ODD[5], "de"), (5, ODD[5], "de"), (5, "other text", "de"), (None, None, None)]
    out += [(400 + i % 60, "same copy of the day $ " * 30, "en" if i % 3 else "fr") for i in range(150)]
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return out + [(1000 + r.doc_id, r.text, r.lang) for r in given]


LABELS = "doc_id long, quality int, toxic int"


def audit(rows, labels):
    """Each row taken through each order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    failed = []
    for i, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        failed.append((p or "", {x for x in f if f[x]}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        mine, shapley = [f for f in failed if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone, left = [f for f in left if x in f[1]], [f for f in left if x not in f[1]]
                fails = sum(x in f[1] for f in mine)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[x] += len(gone)
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[x])
    return out


def test_audit_equals_each_row_in_each_order(spark, rows):
    labels = [(i % 300, i % 2, i % 3 == 0) for i in range(0, 2000, 3)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (1003, 1, 1)]
    table = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], LABELS)
    got = op11_audit.filter_audit(docs(spark, rows), table).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == audit(rows, labels) and len(got) == 600 * 5
    assert op11_audit.filter_audit(docs(spark, []), table).count() == 0
    assert sum(r.good_lost for r in op11_audit.filter_audit(docs(spark, rows), table.limit(0)).collect()) == 0


def test_removal_intervals_equal_each_order():
    for n in (1, 3, 5):
        by = {}
        for mask, step, a, b in op11_audit.removal_intervals(n):
            by.update({(mask, r): step for r in range(a, b)})
        for rank, order in enumerate(permutations(range(n))):
            for mask in range(1, 1 << n):
                assert by[mask, rank] == 1 + next(k for k, x in enumerate(order) if mask >> x & 1)


def sharded(rows, shards):
    """(id, size, crc, shard, slot) by one sort."""
    import hashlib

    keyed = sorted((hashlib.md5((t or "").encode()).digest(), i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), i) for i, t, _ in rows)
    total, before, slots, out = sum(k[3] for k in keyed), 0, Counter(), []
    for k in keyed:
        s = before * shards // total
        out.append((k[5], k[3], k[4], s, slots[s]))
        slots[s] += 1
        before += k[3]
    return out


def test_shards_equal_one_sort(spark, rows, monkeypatch):
    hot = [(None if i % 3 == 0 else i // 4, "a text that very many rows have", "en") for i in range(3000)]  # by far the most rows
    small = [(i, f"{i} " * (i % 40), None) for i in range(2500)] + [(-5, "negative", None), (-(1 << 63), "least", None), (0, "least", None)]
    cases = [(rows, 16), (hot + small + rows, 16), (small, 7), (hot[:40], 16), ([(1, "x" * 100_000, None), (2, "y", None)], 16)]
    for probes in (op12_shards.PROBES, 64):
        monkeypatch.setattr(op12_shards, "PROBES", probes)
        for given, shards in cases:
            got = [tuple(r) for r in op12_shards.histogram_shards(docs(spark, given), shards).collect()]
            assert sorted(got, key=repr) == sorted(sharded(given, shards), key=repr)
    assert op12_shards.histogram_shards(docs(spark, [])).count() == 0
    loose = op12_shards.histogram_shards(docs(spark, hot + small), 16, tolerance=0.05).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("m"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r.n for r in loose) / 16
    assert len(loose) == 16 and all(abs(r.n - mean) <= 0.11 * mean + 200 and r.top == r.m - 1 and r.slots == r.m for r in loose)


def test_shards_are_exchanged_once(spark, rows):
    plan = op12_shards.histogram_shards(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_written_shards_hold_every_row(spark, rows, tmp_path):
    given = docs(spark, rows)
    op12_shards.write_shards(given, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").select("_doc.*", "_shard")
    assert back.select(*given.columns).exceptAll(given).isEmpty() and back.count() == len(rows)
    want = Counter(s for *_, s, _ in sharded(rows, 16))
    got = {r[0]: r[1] for r in back.groupBy("_shard").count().collect()}  # rows equal in id and text may lie on either side of a splitter
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 3 for s in want)


def variants(rows):
    """Words with their near words by all single edits over the letters that occur."""
    count, low = Counter(), {c: c + 32 for c in range(65, 91)}
    for i, t, _ in rows:
        for run in "".join(c if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in t or "").split(" "):
            if run:
                run = run.translate(low)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                count[run if h % 97 else run[:k] + run[k + 1:]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    letters = sorted(set("".join(n)))
    out = {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = (edits - {w}) & n.keys()
        best = min(near, key=lambda x: (-n[x], x.encode()), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    rows = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(rows, key=repr)


def test_variants_equal_all_single_edits(spark, rows, monkeypatch):
    rng = random.Random(8)
    base = ["gewöhnlich", "spelling", "aaaaaaa", "abababab", "straße", "zzzzzx", "mmmmm", "ÿÀÿÀÿ", "xylophones"]
    made = []
    for k in range(700):  # variants of few words, of all frequencies, chains of them too
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i: i + rng.randrange(2)] = rng.choice(["", *"abmxzéß"])
        made += ["".join(w)] * rng.choice([1, 2, 3, 4, 8, 30, 100])
    rng.shuffle(made)
    texts = [(k, rng.choice([" ", "“", "-", "́", "ə"]).join(made[k: k + 40]), None) for k in range(0, len(made), 40)]
    long = [(7, "q" + "rst" * 3000, None)] * 4 + [(8, "q" + "rst" * 2999 + "rt", None)] * 5 + [(None, "b" * 5000, None)] * 3
    given = texts + long + rows
    want = variants(given)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] and r[1] != r[2] for r in want)
    for block in (op13_variants.BLOCK, 5):
        monkeypatch.setattr(op13_variants, "BLOCK", block)
        monkeypatch.setattr(op13_variants, "HELD", 50 if block == 5 else 200_000)
        assert sorted((tuple(r) for r in op13_variants.spelling_variants(docs(spark, given)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == want
    assert op13_variants.spelling_variants(docs(spark, [])).count() == 0


def test_pivots_are_the_two_rarest_disjoint_grams():
    rng = random.Random(2)
    for _ in range(500):
        prefix = sorted({rng.randrange(9): rng.randrange(50) for _ in range(rng.randrange(3, 7))}.items())
        if len(prefix) < 3:
            continue
        got = op13_variants.pivots(prefix)
        rank = dict(prefix)
        assert got[1] - got[0] >= 2
        assert sum(rank[p] for p in got) == min(rank[a] + rank[b] for a in rank for b in rank if b - a >= 2)


def test_queries_give_the_contract_s_columns(spark):
    ops = queries.queries()
    assert ops["op11_filter_audit"](spark, SF).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(ops["op12_histogram_shards"](spark, SF).dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert dict(ops["op13_spelling_variants"](spark, SF).dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
