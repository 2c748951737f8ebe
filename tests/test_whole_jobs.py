"""Whole jobs that cuts had shortened, against loops on small inputs."""

import hashlib
import math
from collections import defaultdict
from datetime import timedelta

import numpy as np
import pytest

from pricelens import plans
from pricelens.fixtures import matches
from pricelens.operators import intervals as I
from pricelens.operators.lineage import shared_folder
from pricelens.operators.replay import SeenResults
from pricelens.plans.ledger import build_chain, leak_audit, ledger_top, verify_chain
from pricelens.plans.metrics import closing_losses
from pricelens.plans.news import OUTCOMES, mentions
from pricelens.streaming import rounds as R
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _weights(keys, draws):
    """Weights by plain integers, a key and draw at a time."""

    def mixed(x):
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = (x ^ x >> shift) * by % 2**32
        return x ^ x >> 16

    out = np.zeros((draws, len(keys)), int)
    for j, k in enumerate(keys):
        h = hashlib.md5(f"{I.SEED}|{k}".encode()).hexdigest()
        for d in range(draws):
            u = mixed(mixed((int(h[:8], 16) + d * 0x9E3779B9) % 2**32) ^ int(h[8:16], 16)) / 2**32
            out[d, j] = sum(u >= sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(9))
    return out


def test_interval_of_a_mean_rests_on_2000_draws(spark):
    rows = defaultdict(list)
    for r in closing_losses(spark, SF).collect():
        rows[r.league].append((r.match_id, r.ll))
    got = {r.league: r for r in plans.queries()["a8_bootstrap_mean"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    league = min(rows, key=lambda k: len(rows[k]))
    keys, ll = zip(*rows[league], strict=True)
    w = _weights(keys, 2000)
    low, high = np.percentile(w @ np.array(ll) / w.sum(1), [2.5, 97.5])
    assert abs(got[league].low - low) < 2e-6 and abs(got[league].high - high) < 2e-6
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01


def test_intervals_of_many_groups_and_measures(spark, monkeypatch):
    """Several rows a key, nulls in measures and groups, groups that tasks have to hand on early, an empty table."""
    rng = np.random.default_rng(1)
    rows = [(int(k), None if g == 7 else f"g{g}", bool(g % 2), float(a), None if b > 1 else float(b)) for k, g, a, b in zip(rng.integers(0, 60, 900), rng.integers(0, 9, 900), rng.normal(size=900), rng.normal(size=900), strict=True)]
    rows += [(1, "alone", True, 2.0, None)]
    x = spark.createDataFrame(rows, "k long, g string, odd boolean, a double, b double").repartition(5)
    w = _weights(range(60), 300)
    for held in (256, 1):
        monkeypatch.setattr(I, "HELD", held)
        got = {(r.g, r.odd): r for r in I.intervals(x, {"a": F.col("a"), "b": F.col("b")}, "k", ["g", "odd"], draws=300).collect()}
        assert got.keys() == {(r[1], r[2]) for r in rows}
        for g, r in got.items():
            for n, at in (("a", 3), ("b", 4)):
                mine = [(y[0], y[at]) for y in rows if (y[1], y[2]) == g and y[at] is not None]
                assert r[f"{n}_n"] == len(mine)
                if not mine:
                    assert r[n] is r[f"{n}_low"] is r[f"{n}_high"] is None
                    continue
                k, v = (np.array(c) for c in zip(*mine, strict=True))
                with np.errstate(invalid="ignore"):
                    means = (w[:, k] @ v) / w[:, k].sum(1)
                low, high = np.nanpercentile(means, [2.5, 97.5])
                assert abs(r[n] - v.mean()) < 1e-6 and abs(r[f"{n}_low"] - low) < 2e-6 and abs(r[f"{n}_high"] - high) < 2e-6
    assert I.intervals(x.limit(0), {"a": F.col("a")}, "k", ["g"]).count() == 0


def test_interval_of_a_slope_rests_on_2000_draws(spark):
    assert {r.draws for r in plans.queries()["a9_slope_interval"](spark, SF).collect()} == {2000}


def test_goal_models_are_fitted_on_every_decision_day(spark):
    days = defaultdict(list)
    for r in matches(spark, SF).select("grp", "match_date").collect():
        days[r.grp].append(r.match_date)
    # Friday to Monday belong to the Friday, other days to the Tuesday.
    decided = {(g, d - timedelta((d.weekday() - (1 if 1 <= d.weekday() <= 3 else 4)) % 7)) for g, ds in days.items() for d in ds}
    enough = {(g, d) for g, d in decided if sum(1 <= (d - x).days <= 1095 for x in days[g]) >= 30}
    got = {(r.grp, r.fit_day): r for r in plans.queries()["m5_goal_model_fit"](spark, SF).collect()}
    assert got.keys() == enough and all(r.settled and r.teams for r in got.values())


def test_every_match_gets_its_latest_event(spark):
    events, want = defaultdict(list), {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).collect():
        events[r.user_id % 25].append((r.s, r.event_id))
    for r in matches(spark, SF).select("match_id", "grp").collect():
        if past := [e for e in events[r.grp] if e[0] < 1704067200 + r.match_id * 977 % 2592000]:
            want[r.match_id] = max(past)[1]
    assert dict(map(tuple, plans.queries()["w2_latest_before"](spark, SF).collect())) == want and any(k % 20 for k in want)


def test_all_fixtures_are_candidates(spark):
    fx, teams, want = matches(spark, SF).select("match_id", "match_date", "home", "away").collect(), defaultdict(set), set()
    for r in mentions(spark, SF).collect():
        teams[r.doc_id, r.day].add(r.team)
    for (doc, day), mine in teams.items():
        found = [(-len(mine & {r.home, r.away}), r.match_date, r.match_id) for r in fx if 1 <= (r.match_date - day).days <= 8 and mine & {r.home, r.away}]
        want |= {(doc, i, -n) for n, _, i in sorted(found)[:6]}
    assert set(map(tuple, plans.queries()["j9_candidate_fixtures"](spark, SF).collect())) == want


def test_openings_and_statuses_read_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", F.to_date(F.col("ts").cast("timestamp")).alias("day")).collect()
    phases, places = defaultdict(list), defaultdict(list)
    for r in events:
        phases[f"{r.user_id}|{r.day}"].append(r.event_type)
        places[r.user_id].append((r.user_id * 5 + len(r.event_type)) % 8)
    got = {r.phase: (r.openings, r.verdict) for r in plans.queries()["q10_single_opening"](spark, SF).collect()}
    assert got == {k: (len(v), "rerun" if v == ["error"] else "refused") for k, v in phases.items()} and len({v for _, v in got.values()}) == 2
    assert dict(map(tuple, plans.queries()["n10_final_status"](spark, SF).collect())) == {k: OUTCOMES[min(v)] for k, v in places.items()}


def test_cut_and_rebuilt_segments_are_found(spark):
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("line"))
    chain = build_chain(rows, 10).persist()
    top, low = ledger_top(chain), F.col("level") == 0
    bad = lambda c, **k: {(r.seg, r.first_bad) for r in verify_chain(c, 10, **k).where("first_bad is not null").collect()}
    assert bad(chain, head=top) == set()
    assert bad(chain.where(~(low & (F.col("event_id") == 39)))) == {(3, "tail")}
    assert bad(chain.where(~(low & (F.col("seg") == 9)))) == {(9, "missing")}
    other = build_chain(rows.withColumn("line", F.concat("line", F.lit("!"))), 10)
    rebuilt = chain.where(~(low & (F.col("seg") == 4))).unionByName(other.where(low & (F.col("seg") == 4)))
    assert bad(rebuilt) == {(4, "tail")}
    assert bad(build_chain(rows.where("event_id < 90"), 10), head=top) == {(-1, "head")}
    assert ledger_top(build_chain(rows, 10, start=top)) != top
    assert {s for s, _ in bad(build_chain(rows, 10, start=top))} == set(range(10))


class _Peeks(SeenResults):
    """Counts the match it decides on as seen."""

    def predict(self, row):
        return (float(self.n + 1),)


def test_leaks_are_found(spark):
    got = leak_audit(spark, SF).collect()
    assert got and not any(r.leak for r in got) and max(r.n_seen for r in got) > 10
    assert all(r.leak for r in leak_audit(spark, SF, _Peeks).collect())


def test_streams_resume(spark, tmp_path):
    """A second run with the folder of the first writes only what is new; a key is written once over both."""
    rows = lambda ids: spark.createDataFrame([(i, 1704067200 + i) for i in ids], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    src, at = str(tmp_path / "in"), str(tmp_path / "job")
    rows(range(10)).write.parquet(src)
    run = lambda: R.run(R.ingest(spark.readStream.schema("event_id long, ts timestamp").parquet(src).withColumn("at", F.col("ts")), "event_id").select("event_id"), at=at)
    assert run().count() == 10 and run().count() == 10
    rows(range(5, 15)).write.mode("append").parquet(src)
    assert sorted(r.event_id for r in run().collect()) == list(range(15))


def test_shared_folder_of_a_cluster_must_be_named():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        shared_folder(Session)
