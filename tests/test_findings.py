"""Findings: their bodies, ids, replacement by producer and order."""

import hashlib
import json
import random

from pairloom.operators import findings as D

PAIR = "left struct<uid:string,instrument:string>, right struct<uid:string,instrument:string>, score double, tier int, reasons array<string>, verdict string, recheck_reason string, challenge_survives boolean, collides boolean, near boolean, linked boolean, note string"
SIGNALS = {"linked": "graph_adjacency", "near": "semantic_similarity"}


def made(spark, rows, producer="p1", subtype="s"):
    return D.assemble(spark.createDataFrame(rows, PAIR), category="C1", producer=producer, subtype=subtype, signals=SIGNALS, facts=["note"])


def row(a, b, score=0.5, tier=1, verdict=None, recheck=None, survives=None, near=True, linked=False):
    return ((a, "w1"), (b, "w1" if b < "m" else "w2"), score, tier, ["r"], verdict, recheck, survives, True, near, linked, "n")


def test_bodies(spark):
    rows = [row("b", "a"), row("a", "b", score=0.9), row("a", "z", verdict="INSUFFICIENT_EVIDENCE", linked=True), row("a", "c", survives=False, verdict="INSUFFICIENT_EVIDENCE"), row("a", "d", recheck="why", survives=False, tier=9, near=None)]
    got = {r.finding_id: (r.rank_score, json.loads(r.body)) for r in made(spark, rows).select("finding_id", "rank_score", D.F.to_json("body").alias("body")).collect()}
    of = lambda a, b: "F-C1-" + hashlib.sha256(f"{a}::{b}".encode()).hexdigest()[:12]
    assert set(got) == {of("a", x) for x in "bzcd"}
    score, b = got[of("a", "b")]
    assert score == 0.9 and b["status"] == "candidate" and b["incompatibility_established"] is True and b["scope"] == "internal_coherence" and b["criteria_fired"] == ["semantic_similarity"] and b["note"] == "n" and b["confidence_label"] == "High"
    z = got[of("a", "z")][1]
    assert z["status"] == "unverifiable" and z["scope"] == "cross_law" and z["criteria_fired"] == ["graph_adjacency", "semantic_similarity"] and z["incompatibility_established"] is None
    assert got[of("a", "c")][1]["status"] == "challenge_failed"
    d = got[of("a", "d")][1]
    assert d["status"] == "needs_recheck" and d["confidence_label"] is None and d["criteria_fired"] == [] and [p["uid"] for p in d["provisions"]] == ["a", "d"]


def test_each_producer_replaces_its_own(spark, tmp_path):
    rng = random.Random(1)
    rows = [row(f"a{i}", f"k{i}", score=rng.choice([0.1, 0.5, 0.9, None]), verdict=rng.choice([None, "INSUFFICIENT_EVIDENCE"])) for i in range(40)]
    one, two = made(spark, rows[:25], "p1"), made(spark, rows[10:40], "p2", "t")
    old = one.unionByName(two)
    new = made(spark, rows[:5], "p1").unionByName(made(spark, rows[:3], "p2", "t"))
    after = D.replace_own(old, new, ["p1"])
    assert after.filter("producer = 'p1'").count() == 5 and after.filter("producer = 'p2'").count() == 30
    placed = D.ranked(after, ["p2", "p1"]).select("producer", "subtype", "finding_id", "rank_score", "place", D.F.try_variant_get("body", "$.status", "string").alias("status")).orderBy("place").collect()
    key = lambda r: (r.status != "candidate", r.rank_score is None, -(r.rank_score or 0), ["p2", "p1"].index(r.producer), r.subtype, r.finding_id)
    assert [r.place for r in placed] == list(range(1, 36)) and placed == sorted(placed, key=key)
    path = str(tmp_path / "findings")
    D.write_own(old, path)
    D.write_own(new.filter("producer = 'p1'"), path)
    stored = D.read_findings(spark, path)
    assert {(r.producer, r.finding_id) for r in stored.collect()} == {(r.producer, r.finding_id) for r in after.collect()}
    assert D.ranked(after.limit(0), []).count() == 0
