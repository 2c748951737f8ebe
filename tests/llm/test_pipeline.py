import re

import corpus_pipeline as cp
from pricelens.llm import op2_quality, op7_mixing, op9_secrets
from pricelens.llm.queries import vocabulary

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    # Stage 1: base rules by brute force, further rules by their own table.
    kept = {r["doc"]["doc_id"] for r in op2_quality.quality_rules(docs).collect() if r.kept}
    assert kept and all(not brute.quality(rows[i]["text"])[5] for i in kept)
    # Stage 2: one document of each component.
    comp = brute.near([(i, rows[i]["text"]) for i in sorted(kept)], 5, 80)
    kept = {i for i in kept if comp[i][1] == i}
    # Stage 3: spans are replaced.
    found = {r.doc_id: r.spans for r in op9_secrets.secret_spans(docs.where(docs.doc_id.isin(sorted(kept)))).collect()}
    for i in kept:
        text, at, out = rows[i]["text"], 0, []
        assert [(x.start, x.kind, x.end) for x in found[i] if x.kind < 3] == brute.spans(text)
        for x in found[i]:
            if x.start >= at:
                out += [text[at:x.start], cp.MARK]
            at = max(at, x.end)
        rows[i]["text"] = "".join(out) + text[at:]
    # Stages 4 and 5.
    clean = spark.createDataFrame([tuple(rows[i].values()) for i in sorted(kept)], docs.schema)
    copies = {r.doc_id: r.copies for r in op7_mixing.mix_sources(clean).collect()}
    tk = Tokenizer.from_file(vocabulary())
    want = sorted((i, tuple(tk.encode(rows[i]["text"], add_special_tokens=False).ids)) for i in kept for _ in range(copies[i]))
    got = sorted((r.doc_id, tuple(r.ids)) for r in cp.run(spark, SF).collect())
    assert got == want and got
    assert not any(re.search("AKIA[A-Z0-9]{12,}", rows[i]["text"]) for i in kept)


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if k < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def _prose(k, n=120):
    """Text that the quality rules keep, different for each k."""
    return " ".join(w for i in range(n // 4) for w in ("the", f"story{k}x{i}", "of", f"rivers{k * 7 + i}"))


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    key = ' api_key = "abcdEFGH12345678" and ' + "0af9" * 10
    texts = [(1, _prose(1)), (1, _prose(1)), (1, _prose(2)), (None, _prose(3) + key), (None, _prose(3) + key), (4, None), (5, ""), (6, " \n\t"), (7, _prose(4, 40_000) + key), (8, _prose(5)), (9, _prose(5)), (10, "few words"), (11, key)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, copies int, h long, k string, kept boolean, spans string, size long, _id long, _doc string"
    rows = [(i, t, None, None if n % 3 else "s", len(t or ""), "d", 9, 7, None, False, "x", n, 5, None) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    show = lambda d: sorted(map(repr, d.select("doc_id", "text", "source", "size").collect()))
    held = lambda ok: sorted(repr(r) for r in docs.select("doc_id", "text", "source", "size").collect() if ok(r))

    got = cp.keep_quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert show(got) == held(lambda r: (r.doc_id in (1, 7, 8, 9) or r.doc_id is None) and not brute.quality(r.text)[5])

    got = cp.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids, key=lambda i: i or 0) == [None, 1, 1, 4, 5, 6, 7, 8, 10, 11]  # two texts of id 1 stay, a copy goes
    assert sorted(r.text for r in got.where("doc_id = 1").collect()) == sorted([_prose(1), _prose(2)])
    assert show(got) == show(cp.drop_near_duplicates(spark, docs.repartition(5), SF))

    got = cp.redact_secrets(spark, docs, SF)
    assert got.columns == docs.columns
    want = []
    for r in docs.collect():
        cut = op9_secrets.cut(r.text, [(s, e) for s, _, e in brute.spans(r.text)], cp.MARK) if r.text else r.text
        want.append((r["size"], cut, len(cut or "")))
    assert sorted(got.select("size", "text", "n_chars").collect()) == sorted(want)
    assert sum("[SECRET]" in (t or "") for _, t, _ in want) == 4 and not any("abcdEFGH" in (t or "") for _, t, _ in want)

    got = cp.mix(spark, docs, SF)
    assert got.columns == docs.columns
    times = {(r.doc_id, r.source): r.copies for r in op7_mixing.mix_sources(docs).collect()}
    assert show(got) == sorted(repr(r) for r in docs.select("doc_id", "text", "source", "size").collect() for _ in range(times[r.doc_id, r.source]))

    got = {r.n_tokens for r in cp.encode(spark, docs, SF).where("doc_id in (4, 5, 6)").collect()}
    assert got == {0} and cp.encode(spark, docs, SF).count() == len(rows)
