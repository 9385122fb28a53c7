"""Pairs and contexts made without all rows of a group in one place, against plain versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from pairloom.operators import blocks as B
from pairloom.operators import containment as C
from pairloom.operators import definitions as D
from pairloom.operators import norms as N
from pairloom.operators import pairs as P
from pairloom.operators import ranks as K
from pairloom.operators import shared as H
from pairloom.sources import relations as S


def test_connected_groups_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "LIST", 3)
    rng = random.Random(1)
    nodes = [(k, k % 3) for k in range(24)] + [(90, None), (3, 0)]
    edges = [(rng.randrange(24), rng.choice([rng.randrange(24), 100 + rng.randrange(4)])) for _ in range(120)] + [(None, 1), (1, None)]
    out, want = {}, {}
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    for i, j in itertools.combinations(range(24), 2):
        if i % 3 == j % 3:
            direct, common = j in out.get(i, ()) or i in out.get(j, ()), len(out.get(i, set()) & out.get(j, set()))
            want[i, j] = (direct, common, direct or common > 0)
    got = P.connected_groups(spark.createDataFrame(nodes, "node long, group int"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(want) and {(r.i, r.j): (r.direct, r.common, r.linked) for r in got} == want


def test_near_pairs_meet_in_neighbouring_ranges(spark):
    rng = random.Random(2)
    rows = [(k, k % 2, rng.choice([rng.uniform(-200, 200), 0.0, 50.0, 64.0, 14.0, -36.0])) for k in range(150)] + [(900, 0, None), (901, None, 0.0), (902, 0, float("nan"))]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if None not in a + b and a[1] == b[1] and abs(a[2] - b[2]) < 50}
    got = P.near_pairs(spark.createDataFrame(rows, "id long, g int, v double"), ["g"], "id", "v", 50).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_distinct_counts_take_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 1, -0.0), (1, None, 2.0), (2, 5, 1.0), (None, 1, None), (None, 2, None)], "k int, a int, b double")
    out = K.distinct_counts(rows, "k", {"x": "a", "y": "b"}, 2)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 2), (None, 2, 0)}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_vectors_in_blocks_equal_plain_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 20)
    monkeypatch.setattr(B, "ROWS", 7)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)] + [[0.0] * 4]
    rows = [(k, rng.choice([0, 1, None]), rng.choice(base)) for k in range(70)] + [(200, 1, None), (201, 1, [1.0, None, 2.0, 3.0]), (202, 0, [1.0])]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    good = [r for r in rows if r[2] and None not in r[2] and dot(r[2], r[2]) > 0]
    want = {}
    for a, b in itertools.combinations(good, 2):
        if len(a[2]) == len(b[2]) and None not in (a[1], b[1]) and a[1] != b[1]:
            sim = round(dot(a[2], b[2]) / (dot(a[2], a[2]) * dot(b[2], b[2])) ** 0.5, 6)
            if sim >= 0.3:
                want[a[0], b[0]] = sim
    got = P.floor_pairs(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0.3).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.sim for r in got} == want


def test_only_related_norms_meet_and_all_their_signals_are_named(spark):
    rows = [(k, f"L{k % 4}" if k % 9 else None, [None, "a", "b", "c"][k % 4 : k % 4 + 1 + k % 2], k % 3 == 0, k % 2 == 0, ["f+"] if k % 5 == 0 else ["f-", "g"] if k % 5 == 1 else None) for k in range(40)]
    norms = spark.createDataFrame(rows, "norm_id long, instrument string, actors array<string>, weak boolean, hard boolean, poles array<string>")
    linked, want = {(k, (k * 7) % 40) for k in range(40)}, {}
    for x, y in itertools.combinations(rows, 2):
        a, b, apart = set(x[2]) - {None}, set(y[2]) - {None}, x[1] != y[1]
        p, q = set(x[5] or []), set(y[5] or [])
        signals = [n for n, on in (("cited", (x[0], y[0]) in linked or (y[0], x[0]) in linked), ("hard", apart and x[4] and y[4]), ("poles", apart and ({"f+"} <= p and {"f-"} <= q or {"f-"} <= p and {"f+"} <= q)), ("weak", apart and x[3] and y[3])) if on]
        process = ("a" in a and "c" in b) or ("c" in a and "a" in b)
        relation = "same_actor" if a & b else "same_process" if process else None
        if signals and (relation == "same_actor" or (relation and {"hard", "poles"} & set(signals))):
            want[x[0], y[0]] = (relation, signals)
    got = N.signal_candidates(norms, ["weak", "hard"], "poles", {"cited": spark.createDataFrame(sorted(linked), "i long, j long")}, [("a", "c")], ["hard", "poles"]).collect()
    assert any(v[0] == "same_process" and "weak" in v[1] for v in want.values())
    assert len(got) == len(want) and {(r.i, r.j): (r.relation, r.signals) for r in got} == want


def test_wordings_and_spans_meet_once(spark):
    norms = spark.createDataFrame([(1, "u", 1, "ab"), (2, "u", 1, "b"), (3, "u", 2, "x"), (4, "u", 3, "x"), (5, None, 1, "b"), (6, "u", 1, None), (7, "u", 1, "abc")], "norm_id long, unit string, number int, span string")
    texts = spark.createDataFrame([("u", 1, 10, "xabx"), ("u", 1, 11, "b"), ("u", 1, 12, "abc"), ("u", 1, 13, "zb"), ("u", 2, 20, "y"), (None, 1, 30, "b")], "unit string, number int, idx long, text string")
    out = N.paragraph_backfill(norms, texts)
    assert {tuple(r) for r in out.collect()} == {(1, None, "ambiguous"), (2, None, "ambiguous"), (3, 20, "number"), (4, None, "none"), (5, None, "none"), (6, None, "ambiguous"), (7, 12, "span")}


def test_definitions_are_not_broadcast(spark):
    norms = spark.createDataFrame([(1, "w", "de groep van groepen"), (2, "w", "de groep van groepen"), (3, "v", "groep")], "norm_id long, instrument string, text string")
    terms = spark.createDataFrame([("w", "groep"), ("w", "groepen"), ("w", "de groep")], "instrument string, term string")
    out = N.relevant_definitions(norms, terms)
    assert {tuple(r) for r in out.collect()} == {(k, *r) for k in (1, 2) for r in (("de groep", 1), ("groepen", 2))}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_contexts_in_blocks_equal_one_by_one(spark, monkeypatch):
    rng = random.Random(4)
    texts = [rng.choice(["", "kort", "een twee drie " * 3, "x" + " " * 40, "lang " * 9]) for _ in range(30)]
    monkeypatch.setattr(N, "CONTEXTS", 30)

    def plain(i):
        left, parts = 90, []
        for k, t in enumerate(texts):
            if k != i:
                t = t if len(t) <= left else t[: max(left, 5)].rstrip(" ") + " [...]"
                left = max(left - len(t), 0)
                parts.append(f"[lid {k + 1}] {t}")
        return "\n\n".join(parts)

    rows = [("a", k, None, t) for k, t in enumerate(texts)] + [("b", 0, "1", "alleen")]
    got = N.context_with_budget(spark.createDataFrame(rows, "article string, pos int, label string, text string"), 90, least=5).collect()
    assert {(r.article, r.pos): r.context for r in got} == {("b", 0): None, **{("a", k): plain(k) for k in range(30)}}


def test_relations_parse_once(spark):
    xml = '<w><gerelateerde-regelgeving><regeling><verwijzing-door><gerelateerde-regeling><extref bwb-id="B1" doc="x&amp;artikel=1" label="l">t</extref></gerelateerde-regeling></verwijzing-door></regeling></gerelateerde-regelgeving></w>'
    found = S.relations(spark.createDataFrame([("a", xml), ("b", "<w/>"), ("c", None)], "instrument string, xml string"))
    assert [tuple(r)[:5] for r in found.collect()] == [("a", "instrument", None, "verwijzing-door", "B1")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_patterns_are_tried_only_where_their_words_stand(spark):
    assert set(D.GATES) == {*D.SENTENCES, *D.LABELS, "onder_verstaan"}
    units = spark.createDataFrame([(1, "De (soort) groep. De instantie (Hierna te noemen: dienst) doet dit.")], "id int, text string")
    assert [r.term for r in D.definitions(units, ["id"]).collect()] == ["dienst"]


def test_spans_are_looked_for_in_one_reading(spark, monkeypatch):
    spans = [(1, "b een c"), (2, "b een c twee d"), (3, "een"), (4, "n c"), (5, "b een ... twee d"), (6, "c twee drie vier vijf zes"), (7, ""), (8, "b een ... b een c"), (9, "c twee drie vier vijf zesd")]
    texts = [(1, "ab een cd"), (2, "B  een c twee drie vier vijf zesde"), (3, "b een c"), (4, "geen"), (5, None), (6, "b een c twee d")]
    want = {(1, 1), (1, 3), (1, 4), (1, 7), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6), (2, 7), (2, 9), (3, 1), (3, 3), (3, 4), (3, 7), (4, 3), (4, 7), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5), (6, 7)}
    for most in (20_000, 2, 1):
        monkeypatch.setattr(C, "MOST", most)
        out = C.verbatim_pairs(spark.createDataFrame(spans, "span_id long, span string"), spark.createDataFrame(texts, "text_id long, text string"))
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_scored_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(N, "ALIKE", 2)
    monkeypatch.setattr(N, "MEET", 3)
    rng = random.Random(5)
    made = [[(f"u{rng.randrange(4)}", pos, rng.choice("abc"), rng.choice(["a", "b", "d", None]), rng.sample("abcde", 2), rng.choice([["c1"], ["c1", "c2"], []])) for pos in range(rng.choice([1, 1, 2]))] for _ in range(6)]
    rows = [(owner, *u) for owner in range(30) for u in made[rng.randrange(6)]] + [(30, "x", 0, "q", None, None, None), (31, "x", 0, "d", "q", ["d"], None), (None, "x", 0, "q", None, ["q"], None)]
    roles, unit = {}, {(r[0], r[2]): r for r in rows}
    for owner, _, pos, head, tail, nouns, concepts in rows:
        for name, keys in (("head", [head]), ("tail", [tail]), ("noun", nouns or []), ("ev", concepts or [])):
            for k in keys:
                if k:
                    roles.setdefault(("ev:" if name == "ev" else "w:") + k, {}).setdefault((owner, pos), set()).add(name)
    n, want = len({r[0] for r in rows} - {None}), {}
    for key, at in roles.items():
        s = 1 - math.log(1 + len({o for o, _ in at})) / math.log(1 + n)
        for (i, pi), (j, pj) in itertools.product(at, at):
            if None not in (i, j) and i < j:
                x, y = at[i, pi], at[j, pj]
                kind = "eurovoc" if "ev" in x else "head" if "head" in x & y else "tail" if {"head", "tail"} & x and {"head", "tail"} & y else "noun"
                one = (-s * N.ROLE_WEIGHTS[kind], pi, pj, key.split(":", 1)[1], unit[i, pi][1], unit[j, pj][1], kind)
                want[i, j] = min(want.get((i, j), one), one)
    units = spark.createDataFrame(rows, "owner long, unit string, pos int, head string, tail string, nouns array<string>, concepts array<string>")
    out = N.object_pair_scores(units)
    got = out.collect()
    assert len(got) == len(want) and {(r.i, r.j): (r.score, r.unit_i, r.unit_j, r.key, r.relation) for r in got} == {p: (round(-v[0], 4), v[4], v[5], v[3], v[6]) for p, v in want.items()}
    assert "hashpartitioning(i#" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_small_and_large_keys_are_scored_by_arrays(spark, monkeypatch):
    monkeypatch.setattr(N, "MEET", 32)
    rng = random.Random(8)
    rows = []
    for owner in range(90):
        for pos in range(rng.choice([1, 2, 3])):
            nouns = rng.choice([None, [f"n{rng.randrange(9)}", rng.choice(["x", None, "n1"])], ["n1", "n2", "n1"]])
            rows.append((f"o{owner:02}", rng.choice(["u", None, f"u{owner}"]), pos if owner % 7 else None if pos else 0, rng.choice(["big", f"h{rng.randrange(20)}", None]), rng.choice(["big", f"h{rng.randrange(20)}", None]), nouns, rng.choice([None, [f"h{rng.randrange(30)}"]])))
    at, parts = {}, {}
    for owner, unit, pos, head, tail, nouns, concepts in rows:
        parts.setdefault((owner, pos), []).append((head, tail, set(nouns or [])))
        for name, keys in (("head", [head]), ("tail", [tail]), ("noun", nouns or []), ("ev", concepts or [])):
            for k in filter(None, keys):
                at.setdefault(("ev:" if name == "ev" else "w:") + k, {}).setdefault((owner, pos, unit), set()).add(name)
    null, best = lambda v: (v is not None, v or 0), {}
    for key, found in at.items():
        s = 1 - math.log(1 + len({f[0] for f in found})) / math.log(91)
        for (i, pi, ui), (j, pj, uj) in itertools.product(found, found):
            if i < j:
                x, y = found[i, pi, ui], found[j, pj, uj]
                kind = "eurovoc" if "ev" in x else "head" if "head" in x & y else "tail" if {"head", "tail"} & x and {"head", "tail"} & y else "noun"
                one = (-s * N.ROLE_WEIGHTS[kind], null(pi), null(pj), key.split(":")[1], (ui is not None, ui or ""), (uj is not None, uj or ""), kind, ui, uj, pi, pj)
                best[i, j] = min(best.get((i, j), one), one)
    want = []
    for (i, j), b in best.items():
        for (ha, ta, na), (hb, tb, nb) in itertools.product(*[parts[o, p] if p is not None else [] for o, p in ((i, b[9]), (j, b[10]))]):
            way = ("same" if na == nb else "a_narrower" if na > nb else "b_narrower" if nb > na else "") if ha == hb else "a_narrower" if ta is not None and ta == hb else "b_narrower" if tb is not None and tb == ha else ""
            want.append((i, j, round(-b[0], 4), b[3], b[6], b[7], b[8], way))
    units = spark.createDataFrame(rows, "owner string, unit string, pos int, head string, tail string, nouns array<string>, concepts array<string>")
    got = [(r.i, r.j, r.score, r.key, r.relation, r.unit_i, r.unit_j, r.direction) for r in N.object_pair_scores(units).collect()]
    assert len(want) > 300 and sorted(got, key=repr) == sorted(want, key=repr)


def test_pairs_of_one_result_are_one_row(monkeypatch):
    monkeypatch.setattr(H, "PAIRS", 1_000)
    side = pa.table({"key": ["w:a"] * 300, "owners": [[2 * k, 2 * k + 1] for k in range(300)], "ek": [["w:a"]] * 300, "es": [[0.5]] * 300, "ep": [[1]] * 300, "eu": [["u"]] * 300, "er": [[6]] * 300, "pp": [[1]] * 300, "ph": [["a"]] * 300, "pt": pa.array([[None]] * 300, pa.list_(pa.string())), "pn": [[["a"]]] * 300})
    schema = pa.schema([("owners_i", pa.list_(pa.int64())), ("owners_j", pa.list_(pa.int64())), ("unit_i", pa.string()), ("unit_j", pa.string()), ("key", pa.string()), ("kind", pa.int32()), ("specificity", pa.float64()), ("way", pa.int32())])
    out = H.best_matches(side, side, N.ROLE_WEIGHTS, schema)
    assert out.num_rows == 300
    assert {(i, j) for r in out.to_pylist() for i in r["owners_i"] for j in r["owners_j"] if i < j} == set(itertools.combinations(range(600), 2))


def test_articles_are_shuffled_once_and_not_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(N, "CONTEXTS", 3)
    rows = [("a" if k < 50 else "b", k, None, f"tekst \u00e9{k} " * (k % 5)) for k in range(51)]
    out = N.context_with_budget(spark.createDataFrame(rows, "article string, pos int, label string, text string"), 40, least=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Exchange")
    got = {r.pos: r.context for r in out.collect()}
    assert len(got) == 51 and got[50] is None and got[0].startswith("[lid 2] tekst \u00e91 \n\n[lid 3] tekst \u00e92 tekst \u00e92 \n\n") and got[49].endswith("[lid 49] tekst [...]")


def test_pairs_of_a_family_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(N, "ALIKE", 2)
    monkeypatch.setattr(N, "MEET", 3)
    rng = random.Random(9)
    rows = [(k, rng.choice(["L1", "L2", "L3", None]), rng.choice([None, [], ["a"], ["c"], ["a", "b"], ["b", None], ["a", "c"]]), rng.random() < 0.5, rng.choice([True, False, None]), rng.choice([None, ["f+"], ["f-", "g+"], ["g-", "f+", "f-"], ["f"]])) for k in range(70)]
    norms = spark.createDataFrame(rows, "norm_id long, instrument string, actors array<string>, weak boolean, hard boolean, poles array<string>")
    near, cited = {(rng.randrange(70), rng.randrange(70)) for _ in range(300)}, {(0, k) for k in range(70)}
    for linked in ({}, {"near": near, "cited": cited}):
        want = {}
        for x, y in itertools.combinations(rows, 2):
            a, b, apart = set(x[2] or []) - {None}, set(y[2] or []) - {None}, x[1] != y[1]
            p, q = set(x[5] or []), set(y[5] or [])
            on = {"hard": apart and x[4] and y[4], "poles": apart and any(f"{f}{s}" in p and f"{f}{t}" in q for f in "fg" for s, t in ("+-", "-+")), "weak": apart and x[3] and y[3], **{n: (x[0], y[0]) in l or (y[0], x[0]) in l for n, l in linked.items()}}
            signals = sorted(n for n in on if on[n])
            relation = "same_actor" if a & b else "same_process" if ("a" in a and "c" in b) or ("c" in a and "a" in b) else None
            if signals and (relation == "same_actor" or (relation and {"hard", "near"} & set(signals))):
                want[x[0], y[0]] = (relation, signals)
        out = N.signal_candidates(norms, ["weak", "hard"], "poles", {n: spark.createDataFrame(sorted(l), "i long, j long") for n, l in linked.items()}, [("a", "c")], ["hard", "near"])
        got = out.collect()
        assert len(got) == len(want) and {(r.i, r.j): (r.relation, r.signals) for r in got} == want
        assert "hashpartitioning(i#" not in out._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 10)
    rng = random.Random(6)
    rows = [(k, k % 3 if k % 7 else None, [float(rng.choice([1, 2, 4])) * x for x in rng.choice([(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])]) for k in range(60)]
    out = P.knn_two_budgets(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 2, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan
    first = {tuple(v): min(k for k, _, u in rows if u == v) for _, _, v in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    want = set()
    for i, li, vi in rows:
        for same, budget in ((True, 2), (False, 4), (None, 4)):
            kind = lambda lj: None if None in (li, lj) else li == lj  # noqa: B023, E731
            found = [(-round(dot(vi, vj) / math.sqrt(dot(vi, vi) * dot(vj, vj)), 9), first[tuple(vj)], j) for j, lj, vj in rows if j != i and kind(lj) is same]
            slots = sorted({f[:2] for f in found})
            want |= {(i, j, same, slots.index((s, h)) + 1) for s, h, j in found if slots.index((s, h)) < budget and s < 0}
    got = [(r.i, r.j, r.same, r["rank"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_what_may_be_nearest_is_sent_on():
    found = pd.DataFrame({"x": [1] * 40 + [2], "y": range(41), "lx": ["a"] * 41, "ly": ["a", "b"] * 20 + [None], "first_y": [k // 4 for k in range(40)] + [0], "cosine": [0.5 + 1e-11 * k for k in range(40)] + [0.1]})
    kept = B.nearest(2, 3, "first").thin(found)
    assert list(kept["y"]) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 40]
    assert list(B.rounded(np.array([0.0000000005, 0.1234567885, -0.0000000005, float("nan")]), 9)) == [1.0, 123456789.0, -1.0, 2.0**62]
