"""Posting lists in blocks, best pairs of all keys, and connections of candidates against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest

from pairloom.functions.text import pair_hash
from pairloom.operators import pairs as P
from pairloom.operators import review
from pairloom.plans import registry


def made(seed):
    rng = random.Random(seed)
    return sorted({(o, rng.choice("xyz") if o % 2 else "x", f"k{int(rng.paretovariate(0.7))}") for o in range(90) for _ in range(5)})


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_pairs_of_long_lists(spark, monkeypatch, block):
    rows = [(o, "xy"[o % 2], k) for o, _, k in made(1)]
    frame = spark.createDataFrame([*rows, rows[0], (None, "x", "k1"), (3, "y", None)], "owner long, lang string, key string")
    monkeypatch.setattr(P.posting_pairs, "__defaults__", (block,))
    lists = defaultdict(set)
    for o, g, k in rows:
        lists[k].add((o, g))
    n = len({o for o, *_ in rows})
    spec = {k: round(1 - math.log(1 + len(v)) / math.log(1 + n), 6) for k, v in lists.items()}
    for group in (None, "lang"):
        want = defaultdict(list)
        for k, v in lists.items():
            for a, ga in v:
                for b, gb in v:
                    if a < b and spec[k] >= 0.1 and len(v) > 1 and (group is None or ga != gb):
                        want[a, b].append(spec[k])
        got = {(r.i, r.j): (r.shared, r.score) for r in P.inverted_index_pairs(frame.filter("owner is not null"), group, min_score=0.1).collect()}
        assert got == {p: (len(s), max(s)) for p, s in want.items()}
    units = spark.createDataFrame([(o, k, float(o % 5 + len(k))) for o, _, k in rows], "owner long, key string, weight double")
    best = {}
    for k, v in lists.items():
        for a, _ in v:
            for b, _ in v:
                if a < b:
                    w = min(a % 5, b % 5) + len(k)
                    best[a, b] = min(best.get((a, b), (0, "")), (-float(w), k))
    assert {(r.i, r.j): (-r.w, r.unit) for r in P.best_unit_pair(units).collect()} == best


def test_best_pairs_leave_out_no_key(spark):
    rows = [(o, "xy"[o % 2], k) for o, _, k in made(2)]
    frame = spark.createDataFrame(rows, "owner long, lang string, key string")
    every = P.inverted_index_pairs(frame, "lang").withColumn("pair", pair_hash(P.F.col("i"), P.F.col("j"))).collect()
    want = sorted(every, key=lambda r: (-r.score, r.pair))
    for n in (1, 17, 5000):
        assert {tuple(r) for r in P.most_related(frame, n, "lang").collect()} == {tuple(r) for r in want[:n]}
    assert P.most_related(frame.limit(0), 3).count() == 0


def test_connected_candidates(spark):
    rng = random.Random(3)
    edges = [(int(rng.paretovariate(0.6)) % 40, rng.randrange(60)) for _ in range(600)] + [(1, None), (None, 2)]
    pairs = [(i, j, "c") for i in range(45) for j in range(i + 1, 45)]
    after = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            after[a].add(b)
    got = P.connected(spark.createDataFrame(pairs, "i long, j long, kind string"), spark.createDataFrame(edges * 2, "src long, dst long")).collect()
    assert len(got) == len(pairs)
    for r in got:
        direct, common = r.j in after[r.i] or r.i in after[r.j], len(after[r.i] & after[r.j])
        assert (r.direct, r.common, r.linked, r.kind) == (direct, common, direct or common > 0, "c")


def test_top_tier_reads_the_rarest_keys_first(spark, monkeypatch):
    rows = [(o, "xy"[o % 2], f"k{o // 2 if o < 40 else 'all'}") for o in range(60)] + [(o, "xy"[o % 2], "kall") for o in range(40)]
    keys = spark.createDataFrame(rows, "owner long, lang string, key string")
    want = list(map(tuple, review.greedy_budget_cap(P.inverted_index_pairs(keys, "lang", min_score=0.0), 6, 3, 0.0).collect()))
    seen, real = [], P.posting_pairs
    monkeypatch.setattr(P, "posting_pairs", lambda posted, *more: seen.append(posted.agg({"df": "max"}).first()[0]) or real(posted, *more))
    assert list(map(tuple, registry._top_tier(P.postings(keys, "lang", once=True), 6, 3, 0.0).collect())) == want
    assert seen == [2]
    every = list(map(tuple, review.greedy_budget_cap(P.inverted_index_pairs(keys, "lang", min_score=0.0), 30, 40, 0.0).collect()))
    assert list(map(tuple, registry._top_tier(P.postings(keys, "lang"), 30, 40, 0.0).collect())) == every and len(every) == 33


def test_keys_are_made_once_for_both_sides(spark):
    keys = spark.range(20).selectExpr("id AS owner", "explode(array(id % 3, 5 + id % 7)) AS key")
    out = P.inverted_index_pairs(keys)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in P.inverted_index_pairs(keys.union(keys)).collect()} == {tuple(r) for r in P.inverted_index_pairs(keys, once=True).collect()}


def test_best_actor_pair_of_lines_met_once(spark, tmp_path):
    lines = [(1, 1, 5), (1, 2, 5), (1, 2, 6), (1, 3, 7), (2, 1, 6), (2, 1, 5), (3, 1, 9), (3, 2, 6), (4, 2, 7), (4, 1, 6), (5, 1, 7), (5, 2, None), (5, 3, 8), (None, 1, 5), (None, 2, 5), (6, None, 5), (6, 1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, 1), (6, 1), (7, 2), (8, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    out = registry.best_actor_pair(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 5, 5, 3), (4, 6, 7, 1), (5, 7, 8, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
