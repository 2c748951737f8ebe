import functools
import math
import os
import random
import string
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import kneser_ney, op1_bpe, op2_quality, op3_chat, op4_minhash, op5_vectors, op6_urls, op7_mixing, op8_toxicity, op9_secrets, op10_lm, queries

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "A a", "x\n\nx\ny\x0bx", "\u00a0nb\u00a0sp \x1c \u2003", "same words here again " * 30, "Zürich ÉCOLE ΑΣ " * 5, "word " * 3000,
       'api_key = "abcdEFGH12345678" x', "AKIA" + "Q7" * 10 + " " + "0af9" * 12, "PASSWORD:\x20\x20short token=12345678; Secret='a.b-c/d+e=f_g'", "toKen: " + "f" * 40]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, key string"


def docs(spark, texts, ids=None):
    rows = [(i, t, None, f"s{i % 3}" if i is not None and i % 5 else None, len(t or ""), 7, "x", "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]


def test_bpe_equals_library(spark, corpus):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(3)
    texts = [*ODD, "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>", *(t for _, t in corpus[:60])]
    texts += ["".join(rng.choice("ab'stremvld 10.,!é\u0301ΣÇ日\n\t-😀</w>|\x1c\x85") for _ in range(rng.randrange(50))) for _ in range(800)]
    got = {r.doc_id: r for r in op1_bpe.encode_documents(docs(spark, texts), queries.vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == tk.decode(ids, skip_special_tokens=False) == op1_bpe.decode(ids, queries.vocabulary())
    assert op1_bpe.digest_documents(docs(spark, texts).limit(0), queries.vocabulary()).count() == 0


def test_quality_base_columns(spark, corpus):
    rows = [*enumerate(ODD), *((100 + i, t) for i, t in corpus)]
    rep = " ".join(f"w{i % 11}" for i in range(200))
    rows += [(10_000, rep), (10_001, "a b c d e f g h " * 2), (10_002, "a b c d e f g h i j a b c d e f g h"), (10_003, "A " * 19)]
    got = {r["doc"]["doc_id"]: r for r in op2_quality.quality_rules(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), (i, t)
        assert not (r.kept and r.base_failed)
    assert op2_quality.quality_rules(docs(spark, [])).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "ann", None), (1, 70, None, "late"), (2, None, "x", "?"), (None, 0, "z", "n"), (1, 0, "ann", "hi")]
    got = op3_chat.rotate_perspectives(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, speaker long")).collect()
    by = {(r.conv_id, r.speaker, r.part): r for r in got}
    assert len(got) == 3 * 2 + 1 + 1
    ann = by[1, "ann", 0]
    assert ann.rendered == "<|im_start|>assistant\nhi<|im_end|>\n" * 2 + "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
    assert [ann.rendered[int(a):int(b)] for a, b in (x.split(":") for x in ann.mask.split(","))] == ["hi", "hi", ""]
    assert by[1, "unknown", 1].rendered.startswith("<|im_start|>assistant\nlate") and by[1, "bob", 1].mask == ""


def test_near_duplicates_equal_brute_force(spark, corpus, monkeypatch):
    rng = random.Random(5)
    base = [f"t{rng.randrange(4000)}" for _ in range(120)]
    rows = [*enumerate(ODD), *((1000 + i, t) for i, t in corpus)]
    for k in range(60):  # copies of one text with ever more edits: many link only by way of it
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9000)}"
        rows.append((5000 + k, " ".join(w)))
    rows += [(9000, "a b c d e f"), (9001, "a b c d e f g"), (9002, "A B c d e F"), (9003, "a b")]
    for size, percent, members in ((2, 80, 400), (5, 80, 400), (2, 80, 3)):  # at last with many small blocks a group
        monkeypatch.setattr(op4_minhash, "MEMBERS", members)
        got = {r.doc_id: r for r in op4_minhash.near_duplicates(docs(spark, [t for _, t in rows], [i for i, _ in rows]), percent, size).collect()}
        want = brute.near(rows, size, percent)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert op4_minhash.near_duplicates(docs(spark, [])).count() == 0
    odd = op4_minhash.near_duplicates(docs(spark, ["a b c", "a b c", "a b c"], [None, 3, 3]), 80, 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd) == [(-1, -1, True), (3, 3, True), (3, 3, True)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        err = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
            n = int(1000 * 2 * share / (1 + share))
            a, b = np.sort(x[:1000]), np.sort(np.concatenate((x[:n], x[1000: 2000 - n])))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            err.append(op4_minhash.estimate(op4_minhash.sketch(a)[None], op4_minhash.sketch(b)[None])[0][0, 0] - j)
        assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.08


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 32))
    for k in range(120):
        v[k + 200] = v[k % 9] + rng.normal(size=32) * 0.05
    v[400:420] = v[3]
    rows = [(i, [float(x) for x in r], None) for i, r in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] + [1.0] * 31, 1), (904, [], 1), (905, [2.0, 1.0], 1), (906, [2.0, 1.0], 1), (None, rows[3][1], 1)]
    got = op5_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int").repartition(3)).collect()
    assert len(got) == len(rows)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    by = {r.vec_id: r for r in got}
    links = sum(by[i].n_links for i in range(700))
    assert 0.9 * hit.sum() <= links <= hit.sum() and all(by[i].n_links <= hit[i].sum() for i in range(700))
    comp = brute.roots(range(700), np.argwhere(hit).tolist())
    assert sum(by[i].component_id == comp[i] for i in range(700)) >= 690
    assert by[900].n_links == 0 and by[901].component_id == 901 and by[905].n_links == 1 and by[906].component_id == 905 and not by[906].kept and by[None].n_links == 0
    assert op5_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_scale_and_length(spark):
    """Components that squares would lose; several lengths with lists of their own."""
    rows = [(1, [1e-170, 5e-170]), (2, [5e-170, 1e-170]), (3, [1e170, -2e170]), (4, [1.01e170, -2e170]), (5, [1.0, 5.0]), (6, [-5e-324, 0.0]), (7, [-1e308, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op5_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 1), 6: (1, 6), 7: (1, 6)}
    rng = np.random.default_rng(5)
    for d in (8, 24):
        v = rng.normal(size=(900, d))
        v[300:600] = v[:300] + rng.normal(size=(300, d)) * 0.1
        rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000 + i, [1.0] * i) for i in range(1, 6)]
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        want = np.count_nonzero(np.triu(u @ u.T >= 0.95, 1)) * 2
        got = {r.vec_id: r.n_links for r in op5_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
        assert 0.9 * want <= sum(got[i] for i in range(900)) <= want and want > 500 and not any(got[1000 + i] for i in range(1, 6))


def test_url_rules_and_links(spark):
    page = lambda i, u, h="": (i, u, h, "x", 1.0)
    rows = [page(1, "http://A.net/x"), page(2, "https://b.example.net/en/q?x#y"), page(3, "ftp://example.com/de/1"), page(4, "x://c.org/fr/2"), page(5, "no url"), page(6, None, None),
            page(7, "http://sub.bad.com/", '<a href="http://evil.net/a">'), page(8, "http://ok.com", '<a href="//c.org/fr/">'), page(9, "http://notnet/"), page(10, "http://evil.net?y")]
    got = {r.page_id: r for r in op6_urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string, host string, trust double")).collect()}
    want = {1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/q", "example.net/en/", "allow"), 3: ("example.com", "/de/1", "example.com/de/", "block"), 4: ("c.org", "/fr/2", "org/fr/", "allow"),
            5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 9: ("notnet", "/", None, "allow")}
    assert {i: (got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in want} == want
    rows += [page(100 + k, "http://evil.net/p") for k in range(3)] + [page(200, "http://spam.info/", '<a href="http://evil.net/">')]
    edges = [(r.src, r.dst) for r in op6_urls.host_edges(spark.createDataFrame([("a.com", '<a href="http://B.com/x"> <a href="/rel">')], "host string, html string")).collect()]
    assert edges == [("a.com", "b.com")]
    # distrust runs against the links: a page that links to a blocked host has some, the blocked host's own target has none
    e = spark.createDataFrame([("spam.info", "evil.net", 1), ("evil.net", "victim.com", 1)], "src string, dst string, n long")
    s = spark.createDataFrame([("evil.net", 1.0)], "host string, seed double")
    score = {r.host: r.score for r in op6_urls.propagate(e.selectExpr("dst src", "src dst", "n"), s).collect()}
    assert score["spam.info"] > 0 and "victim.com" not in score


def test_linked_hosts_against_brute_force(spark):
    """A web of links between hosts, with repeated pages, sites below a shared suffix and unquoted links."""
    rng = random.Random(7)
    hosts = [f"h{k}.com" for k in range(12)] + ["a.co.uk", "b.co.uk", "www.a.co.uk", "x.evil.net", "c.org", "10.0.0.1"]
    rows = []
    for i in range(150):
        links = "".join(f"<a href={rng.choice(['', chr(34)])}http://{rng.choice(hosts).upper()}/p>x</a>" for _ in range(rng.randrange(4)))
        rows.append((i % 140, f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'x'])}", links + " long" * (20_000 if i == 3 else 1)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op6_urls.url_verdicts(pages).collect()
    assert len(got) == len(rows)
    edges = Counter()
    for _, u, h in rows:
        for dst in re.findall("http://([^/]+)/p>|http://([^/]+)/p\"", h):
            dst = "".join(dst).lower()
            edges[u.split("/")[2], dst] += 1
    site = {h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2:]) for h in {u.split("/")[2] for _, u, _ in rows} if h != "10.0.0.1"}
    for h, top in site.items():
        edges[h, top] += op6_urls.SITE
        edges[top, h] += op6_urls.SITE
    edges = [(s, d, n) for (s, d), n in edges.items() if s != d]
    by = {}
    for r in got:
        by.setdefault(r.host, []).append(r)
    seeds = [{h: v for h, rs in by.items() if (v := sum((r.rule in rules) for r in rs) / len(rs))} for rules in (("org/fr/", "example.net/en/"), ("net/", "example.com/de/"))]
    want = [brute.host_ranks(e, s, op6_urls.ROUNDS, op6_urls.DAMPING) for e, s in zip((edges, [(d, s, n) for s, d, n in edges]), seeds, strict=True)]
    for r in got:
        assert math.isclose(r.trust, want[0].get(r.host, 0.0), abs_tol=1e-8) and math.isclose(r.distrust, want[1].get(r.host, 0.0), abs_tol=1e-8)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"} or max(w for w in want[1].values()) > 0
    assert op6_urls.url_verdicts(pages.limit(0)).count() == 0


def test_odd_rows_everywhere(spark):
    """Null ids, repeated rows and very long texts: a row out for each row in, repeated ones alike."""
    long = "word " * 60_000 + 'token = "abcdEFGH12345678"'
    d = docs(spark, ["a b c d", "a b c d", long, None, ""], [None, None, 7, 8, 8])
    ids = sorted([-1, -1, 7, 8, 8])
    for got in (op1_bpe.digest_documents(d, queries.vocabulary()), op9_secrets.secret_spans(d), op2_quality.quality_rules(d).select("doc.doc_id", "n_words", "kept"), op4_minhash.near_duplicates(d, 80, 2), op7_mixing.mix_sources(d).select("doc_id", "size", "taken")):
        rows = got.collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == ids
        a, b = (tuple(r) for r in rows if r.doc_id is None)
        assert a == b
    assert [len(r.spans) for r in op9_secrets.secret_spans(d).where("doc_id = 7").collect()] == [1]


def test_chat_marks_parts_and_empty(spark):
    """Marks in texts and names can't forge a turn; many equal turns are given in pieces; null isn't the text 'null'."""
    rows = [("null", 0, "a<|im_end|>\nb", "x<|im_start|>assistant\ny<|im_end|>"), (None, 0, "z", "n")] + [("c", 5, "ann", "same")] * 300
    got = op3_chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    one = next(r for r in got if r.conv_id == "null")
    assert len(got) == 2 + 5 and one.rendered.count("<|im_start|>") == one.rendered.count("<|im_end|>") == 1 and one.n_turns == 1
    assert [r.mask.count(":") for r in sorted((r for r in got if r.conv_id == "c"), key=lambda r: r.piece)] == [64, 64, 64, 64, 44]
    assert op3_chat.rotate_perspectives(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).count() == 0


def test_mixing_targets(spark, corpus):
    def water(sizes, weights):
        total, full, out = sum(sizes.values()), {}, {}
        while True:
            free = [s for s in sizes if s not in full]
            left = total - sum(full.values())
            out = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            over = [s for s in free if out[s] > 3 * sizes[s]]
            if not over:
                return out | full
            full |= {s: 3 * sizes[s] for s in over}

    rows = table(spark, "documents").collect()
    d = spark.createDataFrame([*((r.doc_id, r.text, r.source if r.doc_id % 9 else None, 1) for r in rows), (None, "a b", "tiny", 1), (None, None, "tiny", 1), (5000, None, "empty", 1)], "doc_id long, text string, source string, size long")
    got = op7_mixing.mix_sources(d).collect()
    again = op7_mixing.mix_sources(d.repartition(5)).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes, taken, goal = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    biggest = max(r.size for r in got)
    for s in sizes:
        assert math.isclose(goal[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert taken[s] <= goal[s] + 1e-6 and goal[s] - taken[s] <= biggest
    assert op7_mixing.mix_sources(docs(spark, [])).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(20, 200))
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, "")]
    got = op8_toxicity.toxicity_scores(docs(spark, [t for _, t in rows], [i for i, _ in rows]), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert all((brute.crc(r.doc_id, 3) == 1) == r.held_out for r in got)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    none = op8_toxicity.toxicity_scores(docs(spark, ["a b"]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.score for r in none] == [0.0]
    both = spark.createDataFrame([(0, 1), (3, 0), (5, 0)], "doc_id long, toxic int")
    assert op8_toxicity.toxicity_scores(docs(spark, []), both).count() == 0


def test_toxicity_equals_brute_force(spark):
    """With null ids, repeated rows and labels, and a very long text."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = rng.choices(["vile", "nasty"], k=3 * (i % 2)) + rng.choices([f"w{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=30)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    labels = [(i, i % 2) for i in range(300)]
    known = [i for i, _ in labels if brute.crc(i, 3) != 1]
    drop = sum(i % 2 for i in known) - sum(1 - i % 2 for i in known)  # leave as many of either label
    for i in [i for i in known if (i % 2 == 1) == (drop > 0)][: abs(drop)]:
        labels.remove((i, i % 2))
        known.remove(i)
    rows += [(None, "vile w1"), (7, rows[7][1]), (9000, "w1 vile " * 40_000), (9001, None)]
    labels += [(known[0], known[0] % 2), (None, 1)]
    got = op8_toxicity.toxicity_scores(docs(spark, [t for _, t in rows], [i for i, _ in rows]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    fit = {r.doc_id for r in spark.createDataFrame([(i,) for i in known], "doc_id long").where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(op8_toxicity.FOLD)) == 0).collect()}
    learnt = [[brute.tokens_of(t) for i, t in rows if i in known and i not in fit and i % 2 == k] for k in (1, 0)]
    x = brute.toxic_ratio(*learnt, op8_toxicity.CLEAR, op8_toxicity.CHANCE)
    want = sorted((-1 if i is None else i, x(brute.tokens_of(t))) for i, t in rows)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.x) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want] and all(math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-12) for (_, u), (_, v) in zip(have, want, strict=True)) and sum(v > 0 for _, v in want) > 100
    by = sorted(got, key=lambda r: r.x)
    assert all(a.score <= b.score for a, b in zip(by, by[1:], strict=False))


def test_secret_base_spans_and_grammar(spark, corpus):
    rng = random.Random(2)
    make = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [*enumerate(ODD), *((1000 + i, t) for i, t in corpus)]
    rows += [(20_000 + k, f'x token = "{make()}" y') for k in range(60)] + [(30_000, "see " + make(30) + " end"), (30_001, "plainword-without-anything chapter-number-12-of-the-book")]
    got = {r.doc_id: r for r in op9_secrets.secret_spans(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    for i, t in rows:
        assert [(x.start, x.kind, x.end) for x in got[i].spans if x.kind < 3] == brute.spans(t)
    assert [(x.kind, x.start, x.end) for x in got[30_000].spans] == [(3, 4, 34)] and not got[30_001].spans
    assert op9_secrets.secret_spans(docs(spark, [])).count() == 0


def test_grammars_find_unlabelled_credentials(spark):
    """Recall of unlabelled credentials whose formats occur labelled, and no spans in ordinary runs of their characters."""
    rng = random.Random(11)
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    formats = {
        "base64": lambda: make(letters + "+/", 40),
        "prefixed": lambda: "ghp_" + make(letters, 36),
        "dashed": lambda: "sk-" + make(letters, 48),
        "hex": lambda: make(hexes, 24),
        "three": lambda: ".".join(make(letters + "-_", n) for n in (36, 60, 43)),
        "uuid": lambda: "-".join(make(hexes, n) for n in (8, 4, 4, 4, 12)),
    }
    words = "report final draft version annual results table figure appendix photo meeting notes backup project index".split()
    some = lambda k: rng.choices(words, k=k)
    plain = {
        "file": lambda: "_".join(some(3)) + f"_{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}.csv",
        "path": lambda: "/".join(some(4)) + f"/{rng.randrange(1000)}",
        "name": lambda: "".join(w.title() for w in some(4)) + str(rng.randrange(10)),
        "capitals": lambda: "_".join(w.upper() for w in some(3)) + str(rng.randrange(100)),
        "number": lambda: make("0123456789", 16),
        "instant": lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}-{rng.randrange(10, 24)}-{rng.randrange(10, 60)}",
    }
    rows, kinds = [], {}
    for k in range(300):
        for kind, new in formats.items():
            rows.append((len(rows), f"the token = {new()} of it"))
    for k in range(200):
        for kind, new in {**formats, **plain}.items():
            run = new()
            if len(run) >= 16 and any(c.isdigit() for c in run):
                kinds[len(rows)] = (kind, len(run))
                rows.append((len(rows), f"see {run} there"))
    got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in op9_secrets.secret_spans(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    for kind in formats:
        mine = [got[i] == [(4, 4 + n)] for i, (k, n) in kinds.items() if k == kind]
        assert len(mine) > 150 and sum(mine) >= 0.9 * len(mine), (kind, sum(mine), len(mine))
    wrong = [i for i, (k, _) in kinds.items() if k in plain and got[i]]
    assert len(wrong) <= 0.01 * sum(k in plain for k, _ in kinds.values()), [rows[i] for i in wrong[:5]]


def test_automaton_learns_format():
    rng = random.Random(4)
    g = op9_secrets.infer(["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)])
    assert len(g.arcs) < 60
    assert g.bits("dh" * 20) > g.bits("dl" * 20) + 1


@pytest.mark.parametrize("order, entries", [(3, kneser_ney.RANGE), (3, 400), (2, 5000)])
def test_language_model_equals_brute_force(spark, corpus, order, entries, monkeypatch):
    """Also with ranges so small that followers of common pairs are dealt over several."""
    monkeypatch.setattr(op10_lm, "train", functools.partial(kneser_ney.train, entries=entries))
    rows = [*enumerate(ODD), *((1000 + i, t) for i, t in corpus), (5000, "long " + " ".join(t for _, t in corpus[:100])), (5001, corpus[0][1]), (5002, corpus[0][1])]
    got = {r.doc_id: r for r in op10_lm.lm_scores(docs(spark, [t for _, t in rows], [i for i, _ in rows]), order=order).collect()}
    base, full = brute.lm_base(rows), brute.lm_scores(rows, order)
    for i, _ in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[i][:3] and r.held_out == (brute.crc(i, 7) == 2)
        assert math.isclose(r.base_score, base[i][3], rel_tol=1e-9) and math.isclose(r.score, full[i], rel_tol=1e-7), i
    held = [i for i, _ in rows if got[i].held_out and got[i].n_tokens > 20]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_language_model_odd_tables(spark):
    none = op10_lm.lm_scores(docs(spark, ["a b"], [next(i for i in range(99) if brute.crc(i, 7) == 2)])).collect()
    assert none[0].base_score == none[0].score == 0.0
    assert op10_lm.lm_scores(docs(spark, [])).count() == 0
    n = 10 + (brute.crc(1, 7) != 2)
    twice = op10_lm.lm_scores(spark.createDataFrame([(None, "a b a b"), (None, "a b a b"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in twice) == [(0, 5, n), (0, 5, n), (1, 1, n)]
    with pytest.raises(ValueError):
        kneser_ney.train(docs(spark, ["a"]), order=4)


def test_model_probabilities_sum_to_one(spark, corpus):
    """Over all words and one unseen one, after any two words."""
    texts = [" ".join(brute.WORD.findall(t)[:40]) for _, t in corpus[:40]]
    model = kneser_ney.train(docs(spark, texts), entries=100)
    words = sorted({w for t in texts for w in brute.tokens_of(t) if w})
    for head in ("", f"{words[0]} ", " ".join(texts[0].split()[:2]) + " ", "unseen " + texts[1].split()[0] + " "):
        total = 0.0
        for w in [*words, "never-seen", None]:
            text = head + (w or "")
            data = np.frombuffer(text.encode(), np.uint8)
            h, at = kneser_ney.tokens(data, np.array([0, len(data)]))
            total += model.levels(h, at)[1][len(head.split())]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_columns_by_name(spark):
    """Queries keep to their contracts' columns and run on whole tables."""
    n = table(spark, "documents").count()
    for name in ("op1_bpe_encode", "op2_quality_rules", "op7_source_mix", "op9_secret_scan"):
        assert queries.queries()[name](spark, SF).agg(F.count(F.lit(1))).first()[0] == n


def test_word_rows_meet_in_as_many_ranges_as_the_corpus_needs(spark, corpus, monkeypatch):
    """A common word has a row from nearly every range of pairs: ranges of rows grow with them, not with the table's
    partitions, so that no task comes to hold a share of the whole corpus."""
    model = kneser_ney.train(docs(spark, [t for _, t in corpus]), entries=100)
    rows = [f for f in os.listdir(model.folder) if f.startswith("rows-")]
    assert model.bits > model.word_bits + kneser_ney.ROW_PART + 1
    assert model.word_ranges < len(rows) <= model.row_ranges == 1 << (model.bits - kneser_ney.ROW_PART)
    data = np.frombuffer(" ".join(t for _, t in corpus[:20]).encode(), np.uint8)
    h, at = kneser_ney.tokens(data, np.array([0, len(data)]))
    whole = model.levels(h, at)[1]
    monkeypatch.setattr(kneser_ney, "LOOKUPS", 5)  # contexts of many parts don't come to be held at once
    assert (model.levels(h, at)[1] == whole).all()


def test_workers_let_go_of_mapped_pages(tmp_path, monkeypatch):
    """Files of more than ``PAGES`` bytes in all aren't held together, and read the same again."""
    monkeypatch.setattr(kneser_ney, "PAGES", 3 << 20)
    for k in range(6):
        kneser_ney._write(str(tmp_path), f"x-{k}", np.arange(k, k + (1 << 17)).astype(np.uint64))
    for _ in range(2):
        for k in range(6):
            assert kneser_ney._mapped(str(tmp_path), f"x-{k}")[0].sum() == sum(range(k, k + (1 << 17)))
            assert sum(map(len, kneser_ney._HELD.values())) <= 3 << 20
