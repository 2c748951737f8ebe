"""Rows that share an id are nodes of their own in the near-duplicate operators."""

import random

import numpy as np

from pricelens.llm import common, op4_minhash, op5_vectors

from . import brute


def expected(rows, links):
    """(id, component) of each row, by place."""
    root = brute.roots(range(len(rows)), links)
    least = {}
    for k, i in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    return [(i, least[root[k]]) for k, i in enumerate(rows)]


def test_documents_of_one_id(spark, monkeypatch):
    rng = random.Random(11)
    a, b = ([f"{c}{rng.randrange(5000)}" for _ in range(60)] for c in "ab")
    rows = [(7, a), (7, b), (2, a[:58])]
    for k in range(150):  # few ids, several texts under each, near copies across ids
        w = list(rng.choice((a, b)) if k % 3 else [f"n{rng.randrange(9000)}" for _ in range(50)])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(9000)}"
        rows += [(rng.randrange(10, 40), w)] * rng.choice((1, 1, 2))
    texts = [(i, " ".join(w)) for i, w in rows]
    sets = [brute.shingles(t, 2) for _, t in texts]
    links = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for large in (10_000, 5):
        monkeypatch.setattr(op4_minhash, "join_back", lambda *a, n=large: common.join_back(*a, large=n))
        got = op4_minhash.near_duplicates(spark.createDataFrame(texts[:3], "doc_id long, text string").repartition(2), 80, 2).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (7, 2, False), (7, 7, True)]
        got = op4_minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 80, 2).collect()
        want = expected([i for i, _ in texts], links)
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(s), c, i == c) for (i, c), s in zip(want, sets, strict=True))


def test_vectors_of_one_id(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 64))
    rows = [(7, a), (7, b), (2, a + rng.normal(size=64) * 0.02), (9, c)]
    got = op5_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(2), 0.95).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(2, 1, 2, True), (7, 0, 7, True), (7, 1, 2, False), (9, 0, 9, True)]
    rows = [(int(rng.integers(10, 60)), v) for v in rng.normal(size=(900, 32))]
    rows += [(int(rng.integers(10, 60)), rows[k % 40][1] + rng.normal(size=32) * 0.02) for k in range(400)] + rows[:30]
    got = op5_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3), 0.95).collect()
    u = np.stack([v / np.linalg.norm(v) for _, v in rows])
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    want = expected([i for i, _ in rows], list(zip(*map(list, np.nonzero(hit)), strict=True)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, int(n), c) for (i, c), n in zip(want, hit.sum(1), strict=True))
