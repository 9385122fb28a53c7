"""Every registered query against its SQL, and properties of the pair operators."""

import glob
import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.functions import text as T
from pairloom.operators import containment, norms, pairs, review
from pairloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_pairs_do_not_depend_on_row_order(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (2, "b"), (4, None)], "owner long, key string")
    a = pairs.inverted_index_pairs(keys, most=3).toPandas()
    b = pairs.inverted_index_pairs(keys.repartition(3).orderBy("key"), most=3).toPandas()
    assert rows(a) == rows(b) and (a.i < a.j).all() and len(a) == 2


def test_budget_and_cap(spark):
    p = spark.createDataFrame([(i, j, 1.0 / (i + j)) for i in range(6) for j in range(i + 1, 6)], "i long, j long, score double")
    out = review.greedy_budget_cap(p, 5, 2, 0.0).toPandas()
    held = [*out.i, *out.j]
    assert len(out) <= 5 and max(map(held.count, held)) <= 2


def test_pairs_of_common_keys(spark):
    held = {k: {"all"} | ({"copy"} if k < 13 else set()) | {f"few{k // 2}"} for k in range(40)}
    keys = spark.createDataFrame([(k, x) for k, xs in held.items() for x in xs], "owner long, key string")
    df = {x: sum(x in xs for xs in held.values()) for xs in held.values() for x in xs}
    score = lambda x: round(1 - math.log(1 + df[x]) / math.log(41), 6)
    for floor in (0.0, 0.2, 0.5):
        want = {}
        for i, j in itertools.combinations(held, 2):
            both = [x for x in held[i] & held[j] if score(x) >= floor]
            if both:
                want[i, j] = (len(both), max(map(score, both)))
        got = {(r.i, r.j): (r.shared, r.score) for r in pairs.inverted_index_pairs(keys, min_score=floor).collect()}
        assert got == want


def test_ties_at_the_cutoff(spark):
    p = spark.createDataFrame([(2 * k, 2 * k + 1, 1.0 if k < 5 else 0.75 if k < 40 else 0.5) for k in range(60)], "i long, j long, score double")
    out = review.greedy_budget_cap(p, 20, 1, 0.6).toPandas().sort_values("rank")
    assert list(out.selection) == ["top"] * 20 + ["tie_extension"] * 2 and list(out["rank"]) == [*range(1, 23)]
    assert set(out.score[out.selection == "tie_extension"]) == {0.75}
    assert len(review.greedy_budget_cap(p, 5, 1, 0.6).toPandas()) == 5


def test_calibration_shares(spark):
    p = spark.createDataFrame([(k, k + 1, 0.45) for k in range(3)] + [(k, k + 1, 0.7) for k in range(100, 140)] + [(k, k + 1, 0.1) for k in range(200, 240)], "i long, j long, score double")
    drawn = review.calibration_sample(p, 15, [0.5, 0.4, 0.25])
    bands = [b for *_, b in drawn]
    assert (bands.count(0), bands.count(1), bands.count(2), bands.count(3)) == (6, 3, 0, 6)
    assert sorted(drawn) == sorted(review.calibration_sample(p.repartition(5), 15, [0.5, 0.4, 0.25]))


def test_review_queue_of_all_keys(spark):
    """The same as the greedy rule over all pairs; thirteen and more documents share some keys."""
    rng = random.Random(5)
    held = {k: {f"few{k // 2}"} | {f"mid{rng.randrange(30)}" for _ in range(2)} for k in range(400)}
    keys = spark.createDataFrame([(k, "ab"[k % 2], x) for k, xs in held.items() for x in xs], "owner long, lang string, key string")
    df = Counter(x for xs in held.values() for x in xs)
    everything = [(i, j, max(round(1 - math.log(1 + df[x]) / math.log(401), 6) for x in held[i] & held[j])) for i, j in itertools.combinations(held, 2) if i % 2 != j % 2 and held[i] & held[j]]
    frame = spark.createDataFrame(everything, "i long, j long, score double")
    for budget in (150, 260):
        got = registry.review_queue(keys, budget, 3, 0.3, 6).collect()
        want = review.greedy_budget_cap(frame, budget, 3, 0.3).collect()
        assert sorted(r[:5] for r in got if r.selection != "calibration") == sorted(r[:5] for r in want)
        taken = {(r.i, r.j) for r in want}
        rest = spark.createDataFrame([e for e in everything if e[:2] not in taken and e[2] >= 0.3], "i long, j long, score double")
        drawn = [(r.i, r.j) for r in got if r.selection == "calibration"]
        assert sorted(drawn) == sorted(e[:2] for e in review.calibration_sample(rest, 6, [0.3])) and len(drawn) == 6


def test_copies_take_one_slot(spark):
    rng = random.Random(2)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(14)] + [[0.0] * 3 + [1.0]]
    data = [(k, k % 3, some[k % len(some)]) for k in range(45)] + [(100 + k, k % 2 + 1, some[0]) for k in range(12)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)
    first = {tuple(v): min(k for k, _, u in data if u == v) for _, _, v in data}
    want = set()
    for i, li, vi in data:
        for same, budget in ((True, 3), (False, 8)):
            found = sorted((-cos(vi, vj), first[tuple(vj)], j) for j, lj, vj in data if j != i and (li == lj) == same)
            slots = sorted({f[:2] for f in found})
            want |= {(i, j, same, slots.index((s, h)) + 1) for s, h, j in found if slots.index((s, h)) < budget and s < 0}
    frame = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    got = pairs.knn_two_budgets(frame, 3, 8).select("i", "j", "same", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_whole_passages_and_ordered_pieces(spark, con):
    def verbatim(span, text):  # as the reference says it
        plain = lambda s: re.sub(r"\s+", " ", s).strip().lower()
        at, text = 0, plain(text)
        for part in [p for p in map(plain, re.split(r"\.{3,}|…", span)) if p] or [plain(span)]:
            k = text.find(part, at)
            if k < 0:
                return False
            at = k + len(part)
        return True

    passage = "Alpha beta gamma delta epsilon zeta eta theta"
    texts = [(1, f"x {passage}  y"), (1, "other"), (None, f"pre{passage.upper()}post"), (3, "theta alpha beta gamma delta"), (4, passage[:24]), (5, None), (6, "")]
    spans = [(1, passage), (2, "alpha beta ... eta\ntheta"), (3, "theta … alpha beta"), (4, "alpha"), (5, "..."), (6, "ALPHA beta gamma delta epsilon zeta et"), (7, passage + " iota"), (8, None)]
    texts += [(100 + i, t) for i, t in con.sql("select doc_id, text from documents").fetchall()]
    spans += [(100 + i, t) for i, t in con.sql("select item_id, text from benchmark").fetchall()]
    want = {(i, k) for i, t in texts if t is not None for k, s in spans if s is not None and verbatim(s, t)}
    got = containment.verbatim_pairs(spark.createDataFrame(spans, "span_id long, span string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(i and i >= 100 and k >= 100 for i, k in want)


def test_deadlines_are_whole_words(spark):
    want = {"binnen veertien dagen": (14, "day"), "binnen achttien maanden": (18, "month"), "binnen vierentwintig uur": (24, "hour"), "uiterlijk twee werkdagen": (2, "working day"), "binnen 72 uur": (72, "hour"), "1,5 uur": None, "zeventien": None, "drie dagenlang": None}
    got = {r["p"]: r["d"] for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", T.deadline(F.col("p")).alias("d")).collect()}
    assert {p: d and (d["value"], d["unit"]) for p, d in got.items()} == want


def test_normalise_is_nfkc_of_latin_text(spark):
    texts = ["\u201cA\u0301e\u0308\u201d \u2013 o\u0302\ufb01\u00a0x", "\uff21\uff42\uff11", "e\u0301e\u0300 n\u0303", None, "", " a \t b\n"]
    plain = {"\u201c": '"', "\u201d": '"', "\u2013": "-"}
    want = [t and " ".join("".join(plain.get(x, x) for x in unicodedata.normalize("NFKC", t)).lower().split()) for t in texts]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.normalise(F.col("t"))).collect()]
    assert got == want


def test_zero_vectors_have_no_cosine(spark):
    v = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    assert [(r.i, r.j) for r in pairs.floor_pairs(v, 0.5).collect()] == [(2, 3)]
    assert {(r.i, r.j) for r in pairs.knn_two_budgets(v, 2, 2).collect()} == {(2, 3), (3, 2)}


def test_addressees_of_siblings(spark):
    rows = [(1, "a", 1, 1, "X"), (2, "a", 1, 1, None), (3, "a", 1, 2, "Y"), (4, "a", 1, 3, None), (5, "a", 1, 2, "Y"), (6, "b", None, 1, "X"), (7, "b", None, 1, None), (8, "a", 1, None, None)]
    out = norms.infer_addressee(spark.createDataFrame(rows, "norm_id long, instrument string, article int, paragraph int, addressee string"))
    assert {r.norm_id: (r.inferred, r.inferred_by) for r in out.collect() if r.addressee is None} == {2: ("X", "paragraph"), 4: ("Y", "article"), 7: (None, None), 8: ("Y", "article")}


def test_object_pair_of_narrower_units(spark):
    rows = [(1, "plan", 1, "plan", None, ["plan"], []), (2, "risk plan", 1, "plan", None, ["plan", "risk"], []), (3, "plan audit", 1, "audit", "plan", ["audit"], ["c1"]), (4, "none", 1, None, None, None, ["c1"])]
    units = spark.createDataFrame(rows, "owner long, unit string, pos int, head string, tail string, nouns array<string>, concepts array<string>")
    got = {(r.i, r.j): (r.relation, r.direction) for r in norms.object_pair_scores(units).collect()}
    assert got == {(1, 2): ("head", "b_narrower"), (1, 3): ("tail", "b_narrower"), (2, 3): ("tail", "b_narrower"), (3, 4): ("eurovoc", "")}
