"""Pieces of dialogues whose turn numbers don't tell turns apart, tables of suffixes, recall at the threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import op3_chat, op5_vectors, op6_urls


def test_a_part_of_many_rows_is_cut(spark):
    rows = [(1, None, f"p{k % 3}", f"{k:04d}") for k in range(500)] + [(2, 5, "a", "same")] * 200 + [(3, 0, "a", "x" * 300_000), (3, 1, "b", None)]
    got = op3_chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert max(r.n_turns for r in got) == op3_chat.PART
    for conv, who in ((1, "p1"), (2, "a"), (3, "b")):
        mine = sorted((r for r in got if (r.conv_id, r.speaker) == (conv, who)), key=lambda r: (r.part, r.piece))
        said = sorted((t or -1, r, x or "") for c, t, r, x in rows if c == conv)
        want = "".join(f"<|im_start|>assistant\n{x}<|im_end|>\n" if r == who else f"<|im_start|>user name={r}\n{x}<|im_end|>\n" for _, r, x in said)
        assert "".join(r.rendered for r in mine) == want
        marked = [r.rendered[int(a):int(b)] for r in mine for a, b in (m.split(":") for m in r.mask.split(",") if m)]
        assert marked == [x for _, r, x in said if r == who]


def test_suffixes_as_a_table(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.github.io", "github.io", "x.b.github.io", "c.example.com", "d.co.uk", "e.d.co.uk", "com", "q.w.long.suffix.zz")], "host string")
    table = spark.createDataFrame([("github.io",), ("co.uk",), ("long.suffix.zz",), ("com",)], "suffix string")
    assert dict(map(tuple, op6_urls.domains(hosts, table).collect())) == {"a.github.io": "a.github.io", "github.io": "github.io", "x.b.github.io": "b.github.io", "c.example.com": "example.com", "d.co.uk": "d.co.uk", "e.d.co.uk": "d.co.uk", "com": "com", "q.w.long.suffix.zz": "w.long.suffix.zz"}
    assert dict(map(tuple, op6_urls.domains(hosts).collect()))["a.github.io"] == "github.io"
    bad = [(1, "http://a.github.io/", '<a href="//evil.net/">'), (2, "http://b.github.io/", ""), (None, "http://evil.net/x", None), (None, None, "x")]
    pages = spark.createDataFrame(bad, "page_id long, url string, html string")
    got = op6_urls.url_verdicts(pages, suffixes=table).collect()
    assert sorted((r.page_id or 0, r.host) for r in got) == [(0, ""), (0, "evil.net"), (1, "a.github.io"), (2, "b.github.io")]
    by = {r.host: r for r in got}
    assert by["evil.net"].verdict == "block" and by["a.github.io"].distrust > 0 and by["b.github.io"].distrust == 0  # neighbours below a suffix don't share


@pytest.mark.parametrize("pivots", [400, 4096, 16_384])
def test_pairs_at_the_threshold_are_candidates(pivots):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(600, 64)))
    across = rng.normal(size=a.shape)
    across = unit(across - (across * a).sum(1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * across
    p = unit(rng.normal(size=(pivots, 64)))
    ta, tb = op5_vectors.nearest_pivots(a, p), op5_vectors.nearest_pivots(b, p)
    caught = np.mean([op5_vectors.agreement(ta[i: i + 1], tb[i: i + 1])[0, 0] >= op5_vectors.LEAST for i in range(len(a))])
    assert caught >= 0.95, caught


def test_recall_of_vectors_that_lie_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(2500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across = rng.normal(size=a.shape)
    across -= (across * a).sum(1, keepdims=True) * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, size=(2500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, c * a + np.sqrt(1 - c * c) * across)))]
    got = op5_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 0.95)
    assert got.agg(F.sum("n_links")).first()[0] >= 0.95 * 5000
