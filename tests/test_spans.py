"""Spans of labels and alignment of two readings against plain versions."""

import random
import re
from itertools import product

import pytest

from pairloom.operators import agreement as A
from pairloom.operators import spans as S

SCHEMA = "doc_id long, text string, doc string, own string, spans string"
WORDS = ["de", "bank", "raad", "van", "toezicht", "systeem", "systemen", "AI-systeem", "Bank", "melden", "gemeld", "(x)", "été", "a_b", "3", ",", ".", ";"]


def texts():
    rng = random.Random(9)
    out = [None, "", " ", "de  raad\n\tvan toezicht", "bankraad", "De AI-systemen, AI - systeem", "x" * 20_000 + " bank", "bank " * 3000]
    return out + [" ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) for _ in range(150)]


LEXICON = [("1", "raad van toezicht", "plain", None), ("2", "raad", "plain", None), ("3", "van toezicht de", "plain", None), ("4", "systeem", "term", None), ("5", "AI-systeem", "term", None), ("6", "bank de", "plain", "nl"), ("7", "bank", "term", None), ("8", "meld", "verb", None), ("9", "de bank van", "plain", None), ("10", "bank", "plain", None), ("2", "toezicht", "plain", None), ("11", "(x)", "plain", None), ("12", "été", "plain", None), ("13", "raad bank", "phrase", None)]


def plain_hits(text, doc):
    """Every phrase as a regular expression over the text, one at a time."""
    out = set()
    for label, phrase, kind, scope in LEXICON:
        if scope is not None and scope != doc:
            continue
        words = phrase.split()
        gap = r"[\t-\r \xa0]+"
        ways = [words] + ([[*words[:-1], "te", words[-1]]] if kind == "phrase" else [])
        for way in ways:
            for spelled in product(*[dict.fromkeys(S.forms(w.lower(), kind)) for w in way]):
                body = gap.join(map(re.escape, spelled))
                edge = [r"(?<!\w)" if spelled[0][0].isalnum() else "", r"(?!\w)" if spelled[-1][-1].isalnum() else ""]
                out |= {(m.start(1), m.end(1), label) for m in re.finditer(f"{edge[0]}(?=({body}){edge[1]})", text, re.I)}
    return out


def plain_choice(hits, once, alike, size):
    kept = []
    for s, e, label in sorted(hits, key=lambda h: (-size(h), h[0], h[2])):
        over = [k for k in kept if k[0] < e and s < k[1]]
        if once and any(k[2] == label for k in kept):
            continue
        if not over or (alike and all(k[:2] == (s, e) for k in over)):
            kept.append((s, e, label))
    return sorted(kept)


@pytest.mark.parametrize(("once", "alike", "most"), [(False, False, 1000), (True, False, 1000), (False, True, 1000), (False, False, 4)])
def test_spans_equal_plain_search(spark, monkeypatch, once, alike, most):
    monkeypatch.setattr(S, "MOST", most)  # 4: several passes over the texts
    rows = [(i, t, "nl" if i % 2 else "eu", "7" if i % 3 == 0 else None, "clash") for i, t in enumerate(texts())]
    lexicon = spark.createDataFrame([*LEXICON, LEXICON[0], (None, "x", "plain", None), ("14", None, "plain", None)], "label string, phrase string, kind string, scope string")
    got = S.label_spans(spark.createDataFrame(rows, SCHEMA), lexicon, scope="doc", skip="own", once=once, alike=alike).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        hits = {h for h in plain_hits(text, r.doc) if h[2] != r.own}
        assert [(x.start, x.end, x.label) for x in r.spans] == plain_choice(hits, once, alike, lambda h: h[1] - h[0]), r.text
        assert all(x.matched == text[x.start : x.end] for x in r.spans)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "label string, phrase string")
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert S.label_spans(docs, none).first().spans == []
    assert S.label_spans(docs.filter("id > 1"), none).count() == 0


def test_verbs_with_particles(spark):
    apart = spark.createDataFrame(
        [("appoint", ["wijst", "wijzen"], "aan", "wijzen", False, None), ("adopt", ["stelt"], "vast", "stellen", False, ["dat", "of"]), ("cease", ["houdt"], "op", "houden", True, None)],
        "label string, finite array<string>, particle string, infinitive string, anchored boolean, not_before array<string>",
    )
    lexicon = spark.createDataFrame([("show", "wijs", "verb"), ("on", "aan", "plain"), ("firm", "vast", "plain")], "label string, phrase string, kind string")
    cases = {
        "Onze Minister wijst een autoriteit aan.": [("appoint", "wijst … aan", "separable")],
        "De lidstaat wijst; aan": [("show", "wijst", "lexicon"), ("on", "aan", "lexicon")],
        "om een autoriteit aan te wijzen": [("appoint", "aan te wijzen", "separable_te")],
        "De raad stelt vast, dat het zo is": [("firm", "vast", "lexicon")],
        "De raad stelt regels vast": [("adopt", "stelt … vast", "separable")],
        "zij houdt op met werken": [("cease", "houdt … op", "separable")],
        "zij houdt op de dag rekening": [],
        "zij houdt de dag op": [("cease", "houdt … op", "separable")],
    }
    got = S.label_spans(spark.createDataFrame([(k,) for k in cases], "text string"), lexicon, apart=apart, prepositions=["met", "van"]).collect()
    for r in got:
        assert [(x.label, x.matched, x.source) for x in r.spans] == cases[r.text], r.text


def test_term_forms():
    assert "systemen" in S.forms("systeem", "term") and "incidenten" in S.forms("incident", "term") and "incidentten" not in S.forms("incident", "term")
    assert {"meld", "melden", "gemeld"} <= set(S.forms("meld", "verb")) and "melding" not in S.forms("meld", "verb") and "melding" in S.forms("meld", "noun")


FIELDS = {"deontic": "same", "actor": "text", "action_lemma": "lemma", "object": "text", "trigger_event": "text", "deadline_raw": "deadline", "recipient": "list"}
NORM = "unit long, pos long, deontic string, actor string, action_lemma string, object string, trigger_event string, deadline_raw string, recipient array<string>, score string"


def norms(seed, n):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    made = []
    for u in range(n):
        for p in range(rng.choice([0, 1, 1, 2, 3, 7])):
            made.append((u if u else None, p, some("OBLIGATION", "RIGHT", "PERMISSION", None), some(None, "de aanbieder", "aanbieder van diensten", ""), some("melden", "Melden ", "verstrekken", None), some("het incident", "een ernstig incident", None), some(None, "na kennis"), some(None, "binnen 24 uur", "binnen 1 dag", "onverwijld"), some(None, ["a b", "c"], ["b c"], []), "clash"))
    return made


def plain_align(one, two):
    words = lambda x: set((x or "").lower().split())
    share = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))
    lemma = lambda x: " ".join((x or "").lower().split())

    def score(a, b):
        s = (a[2] == b[2]) + (lemma(a[4]) != "" and lemma(a[4]) == lemma(b[4]))
        for f in (5, 3, 6):
            if words(a[f]) and words(b[f]):
                s += share(words(a[f]), words(b[f]))
        return s

    out, u1, u2 = [], set(), set()
    for s, i, j in sorted(((score(a, b), i, j) for i, a in enumerate(one) for j, b in enumerate(two)), key=lambda t: (-t[0], t[1], t[2])):
        if s > 0 and i not in u1 and j not in u2:
            u1.add(i)
            u2.add(j)
            out.append((i, j))
    return out + [(i, None) for i in range(len(one)) if i not in u1] + [(None, j) for j in range(len(two)) if j not in u2]


def test_alignment_and_resolution(spark):
    one, two = norms(1, 60), norms(2, 60)
    made = A.align(spark.createDataFrame(one, NORM), spark.createDataFrame(two, NORM), ["unit"], fields=FIELDS)
    rows = made.orderBy("unit", "norm_index").collect()
    for unit in {r[0] for r in one + two}:
        a, b = ([r for r in side if r[0] == unit] for side in (one, two))
        mine = [r for r in rows if r.unit == unit]
        assert [(r.one and r.one.pos, r.two and r.two.pos) for r in mine] == plain_align(a, b)
        assert [r.norm_index for r in mine] == list(range(len(mine)))
    settled = {(r.unit, r.norm_index): r for r in A.resolve(made, ["unit"], fields=FIELDS).collect()}
    for r in rows:
        s = settled[r.unit, r.norm_index]
        if r.one is None or r.two is None:
            assert s.uncertain and s.reason == "found by one of two passes" and s.deontic == (r.one or r.two).deontic and s.alternative is None
            continue
        second = r.two.deontic in A.ACTIONABLE and r.one.deontic not in A.ACTIONABLE
        base, other = (r.two, r.one) if second else (r.one, r.two)
        assert s.deontic == base.deontic and s.uncertain == bool(r.diffs) and (s.alternative and s.alternative.pos) == (other.pos if r.diffs else None)
        assert s.deontic_alternative == (other.deontic if other.deontic != base.deontic else None)


def test_fields_that_differ(spark):
    a = (1, 0, "RIGHT", "de aanbieder", "melden", "x", None, "binnen 24 uur", ["a b", "c"], "")
    b = (1, 0, "RIGHT", "aanbieder", "Melden", "y", None, "binnen 24 uren", ["c a b"], "")
    c = (1, 0, "RIGHT", "aanbieder", "verstrekken", None, "na x", "binnen 1 dag", [], "")
    df = lambda r: spark.createDataFrame([r], NORM)
    assert A.align(df(a), df(b), ["unit"], fields=FIELDS).first().diffs == ["object"]
    assert A.align(df(a), df(c), ["unit"], fields=FIELDS).first().diffs == ["action_lemma", "object", "trigger_event", "deadline_raw", "recipient"]
    assert A.align(df(a).limit(0), df(b).limit(0), ["unit"], fields=FIELDS).count() == 0


def test_queue_with_failed_passes(spark):
    one = spark.createDataFrame([(u, 5, *["RIGHT"] * 6, None, "") for u in (1, 2)], NORM)
    two = spark.createDataFrame([(u, 3, *["RIGHT"] * 6, None, "") for u in (1, 3)], NORM)
    queue = spark.createDataFrame([(1, True, True, True), (2, True, True, False), (3, True, False, True), (4, True, True, False), (5, True, False, False), (6, False, True, True), (7, True, True, True)], "unit long, located boolean, grounded_1 boolean, grounded_2 boolean")
    kept, dropped = A.resolve_queue(queue, one, two, ["unit"], fields=FIELDS)
    assert {(r.unit, r.norm_index, r.reason, r.uncertain) for r in kept.collect()} == {(1, 0, "agreed", False), (2, 0, "single grounded pass", True), (3, 0, "single grounded pass", True)}
    assert dict(map(tuple, dropped.collect())) == {4: "single_pass_empty_unconfirmed", 5: "no_grounded_pass", 6: "provision_not_relocated"}
