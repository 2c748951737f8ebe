"""The stored ledger: appends, publication, verification from a known commit, and what damage it finds."""

import glob
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from pricelens.sources.ledger_store import GENESIS, Conflict, LedgerStore, commit_head


def rows(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("event_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("line"))


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, f"file://{tmp_path}/ledger", segment=10)


def bad(x):
    return {(r.batch, r.seg, r.first_bad) for r in x.where("first_bad is not null").collect()}


def test_appends_give_the_chain_of_one_append(spark, store, tmp_path):
    one = LedgerStore(spark, f"file://{tmp_path}/one", segment=10)
    one.append(rows(spark, 0, 95))
    for a, b in ((0, 14), (14, 20), (20, 21), (21, 95)):
        head = store.append(rows(spark, a, b))
        assert (head.last_id, head.total) == (b - 1, b)
    key = ["event_id", "line", "prev_hash", "row_hash"]
    assert sorted(map(tuple, store.rows().select(*key).collect())) == sorted(map(tuple, one.rows().select(*key).collect()))
    prev, want = "", []
    for i in range(95):
        prev = prev if i % 10 else f"segment {i // 10}"
        prev = hashlib.sha256(f"{prev}row {i}".encode()).hexdigest()
        want.append(prev)
    assert [r.row_hash for r in store.rows().orderBy("event_id").collect()] == want
    commits = store.commits()
    assert [c.batch for c in commits] == [0, 1, 2, 3] and commits[0].head == commit_head(GENESIS, 0, 14, 13, commits[0].digest)
    assert bad(store.verify(head=commits[-1].head)) == set() and store.append(rows(spark, 5, 5)) is None


def test_rows_must_follow(spark, store):
    store.append(rows(spark, 0, 30))
    for wrong in (rows(spark, 29, 40), rows(spark, 10, 12), rows(spark, 30, 35).union(rows(spark, 30, 31))):
        with pytest.raises(Conflict):
            store.append(wrong)
    assert store.rows().count() == 30 and len(store.commits()) == 1
    assert store.append(rows(spark, 30, 40)).batch == 1  # what failed writers left isn't read
    assert store.rows().count() == 40


def test_a_commit_is_published_once(spark, store):
    store.append(rows(spark, 0, 30))
    record = store.head().asDict()
    with pytest.raises(Conflict):
        store._publish(0, record)
    assert [c.asDict() for c in store.commits()] == [record]


def test_verification_reads_only_what_follows_its_anchor(spark, store):
    for a, b in ((0, 25), (25, 47), (47, 60)):
        store.append(rows(spark, a, b))
    anchor = store.commits()[1]
    later = store.rows(after=anchor.batch)
    assert {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in later.inputFiles()} == {"batch=2"}
    got = store.verify(anchor, store.head().head)
    assert sorted((r.batch, r.seg, r.n_rows) for r in got.collect()) == [(2, -1, 13), (2, 4, 3), (2, 5, 10)] and bad(got) == set()
    assert bad(store.verify(store.head(), store.head().head)) == set()
    assert bad(store.verify(store.head(), "other")) == {(2, -1, "head")}


def damage(spark, tmp_path, batch, change):
    """Rewrite the rows of a commit's folder in place."""
    folder = glob.glob(f"{tmp_path}/ledger/rows/batch={batch}/*")[0]
    aside = f"{tmp_path}/{uuid.uuid4().hex}"
    kept = [r.asDict() for r in spark.read.parquet(folder).collect()]
    new = spark.createDataFrame([tuple(r.values()) for r in change(kept)], "event_id long, line string, prev_hash string, row_hash string, seg long")
    new.coalesce(1).write.mode("overwrite").parquet(f"{aside}-new")
    os.rename(folder, f"{aside}-old")
    os.rename(f"{aside}-new", folder)


def test_damage_is_found(spark, store, tmp_path):
    for a, b in ((0, 25), (25, 47), (47, 60)):
        store.append(rows(spark, a, b))
    commits = store.commits()
    damage(spark, tmp_path, 1, lambda rs: [r | {"line": "changed"} if r["event_id"] == 33 else r for r in rs])
    assert bad(store.verify()) == {(1, 3, "33")} and bad(store.verify(commits[1])) == set()
    damage(spark, tmp_path, 2, lambda rs: [r for r in rs if r["event_id"] != 59])  # a segment's end: its digest shows it
    assert bad(store.verify(commits[1])) == {(2, -1, "digest")}

    def rebuilt(rs):
        prev, out = commits[1].last_head, []
        for r in sorted(rs, key=lambda r: r["event_id"]):
            prev = f"segment {r['seg']}" if r["event_id"] % 10 == 0 else prev
            line = r["line"] + "!"
            out.append(r | {"line": line, "prev_hash": prev, "row_hash": hashlib.sha256((prev + line).encode()).hexdigest()})
            prev = out[-1]["row_hash"]
        return out

    damage(spark, tmp_path, 2, rebuilt)
    assert bad(store.verify(commits[1])) == {(2, -1, "digest")}


def test_lost_and_changed_commits_are_found(spark, store, tmp_path):
    for a, b in ((0, 25), (25, 47), (47, 60)):
        store.append(rows(spark, a, b))
    at = f"{tmp_path}/ledger/commits/{1:012d}.json"
    with open(at) as f:
        text = f.read()
    os.remove(at)
    assert bad(store.verify()) == {(2, -1, "link"), (2, 4, "47")}
    with open(at, "w") as f:
        f.write(text.replace('"n_rows": 22', '"n_rows": 21'))
    for crc in glob.glob(f"{tmp_path}/ledger/commits/.*1.json.crc"):
        os.remove(crc)
    assert bad(store.verify()) == {(1, -1, "digest")}
