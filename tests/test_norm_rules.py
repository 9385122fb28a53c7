"""Row-by-row choices, contexts, terms and references against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from pairloom.functions import text as T
from pairloom.operators import norms as N
from pairloom.operators import review as V

KEY = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()


def graph(rng, n, nodes):
    return [(i, j, rng.choice([0.2, 0.5, 0.7, 0.7, 0.9])) for i, j in {tuple(sorted((int(rng.paretovariate(0.5)) % nodes, rng.randrange(nodes)))) for _ in range(n)} if i < j]


@pytest.mark.parametrize("rows_a_pass", [10_000, 1])
@pytest.mark.parametrize(("budget", "cap"), [(40, 2), (7, 1), (100_000, 3), (0, 2)])
def test_greedy_equals_row_by_row(spark, monkeypatch, rows_a_pass, budget, cap):
    monkeypatch.setattr(V, "PASS", rows_a_pass)
    pairs = graph(random.Random(7), 900, 120)
    held, want, cut = Counter(), [], None
    for i, j, s in sorted((p for p in pairs if p[2] >= 0.5), key=lambda p: (-p[2], KEY(p[0], p[1]))):
        if len(want) >= budget and (not budget or len(want) >= budget + budget // 10 or cut - s >= 1e-9):
            break
        if held[i] < cap and held[j] < cap:
            held.update((i, j))
            want.append((i, j, s, len(want) + 1, "top" if len(want) < budget else "tie_extension"))
            cut = s if len(want) == budget else cut
    frame = spark.createDataFrame(pairs + pairs[:5], "i long, j long, score double").repartition(3)
    assert list(map(tuple, V.greedy_budget_cap(frame, budget, cap, 0.5).collect())) == want


@pytest.mark.parametrize("rows_a_pass", [10_000, 1])
def test_draw_equals_row_by_row(spark, monkeypatch, rows_a_pass):
    monkeypatch.setattr(V, "PASS", rows_a_pass)
    rng = random.Random(8)
    pool = [(rng.choice("xxxyyz"), i, j, "clash") for i, j, _ in graph(rng, 500, 60)]
    rows = spark.createDataFrame([*pool, pool[0], (None, 1, 2, ""), ("x", None, 2, "")], "s string, i long, j long, draw_by string")
    for quota in (9, {"x": 30, "z": 4}):
        sizes, held, want = Counter(p[0] for p in [*pool, pool[0]]), Counter(), []
        for s in sorted(sizes, key=lambda s: (sizes[s], s)):
            n = 0
            for p in sorted({p for p in pool if p[0] == s}, key=lambda p: KEY("draw", p[1], p[2])):
                if n < (quota if isinstance(quota, int) else quota.get(s, 0)) and held[p[1]] < 2 and held[p[2]] < 2:
                    held.update(p[1:3])
                    n += 1
                    want.append((*p, n))
        assert list(map(tuple, V.draw_with_uses(rows, "s", quota, 2).collect())) == want
    assert V.draw_with_uses(rows.limit(0), "s", 3, 2).count() == 0


def test_context_cuts_but_drops_none(spark):
    rng = random.Random(9)
    rows = []
    for a in range(12):
        for k in range(rng.choice([1, 2, 5, 9])):
            rows.append((a if a else None, k, rng.choice([None, "", "3a"]), rng.choice([None, "", "x " * rng.randrange(60), "word " * rng.randrange(30)])))
    got = {(r.article, r.pos): r.context for r in N.context_with_budget(spark.createDataFrame(rows, "article long, pos int, label string, text string"), 120, least=20).collect()}
    for a in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == a]
        for target in mine:
            parts, left = [], 120
            for k, r in enumerate(mine):
                if r is target:
                    continue
                t = r[3] or ""
                if len(t) > left:
                    t = t[: max(left, 20)].rstrip() + " [...]"
                parts.append(f"[lid {r[2] or k + 1}] {t}")
                left = max(left - len(t), 0)
            assert got[a, target[1]] == ("\n\n".join(parts) if len(mine) > 1 else None)


def test_terms_stand_within_words(spark):
    norms = spark.createDataFrame([(1, "w", "Het aanzienlijk  Risico van de systeembeheerder"), (2, "w", "ris"), (3, "v", "risico"), (4, "w", None)], "norm_id long, instrument string, text string")
    terms = spark.createDataFrame([("w", "risico"), ("w", "aanzienlijk risico"), ("w", "systeem"), ("w", "van"), ("w", "beheer"), ("u", "risico"), ("w", None)], "instrument string, term string")
    assert {(r.norm_id, r.rank, r.term) for r in N.relevant_definitions(norms, terms).collect()} == {(1, 1, "aanzienlijk risico"), (1, 2, "systeem")}


def test_deference_to_a_paragraph(spark):
    rows = [("w", "27", "2", "In afwijking van het eerste lid", "w", "27", "1", None), ("w", "27", "1", None, "w", "27", "3", "onverminderd het Eerste  lid en derde lid"), ("w", "27", "2", "eerste lid", "v", "27", "1", None), ("w", "27", "2", "eerste lid", "w", "28", "1", None), ("w", "27", "2", "eerste lid", "w", "27", "1a", "tweede leden"), (None, "27", "2", "eerste lid", None, "27", "1", "")]
    names = [f"{c}_{e} string" for e in "ab" for c in ("instrument", "article", "number", "deference")]
    got = N.paragraph_deference(spark.createDataFrame(rows, ", ".join(names))).collect()
    assert [r.deferring for r in got] == [rows[0][3], rows[1][7], None, None, None, None]


def test_references_both_ways(spark):
    norm = "norm_id long, instrument string, article string, number string, text string, refs array<int>"
    norms = spark.createDataFrame([(1, "w", "9", "1", "een", []), (2, "w", "9", "2", "twee", [1, 2, 11]), (3, "w", "9", "11", "elf", [1]), (4, "w", "8", "1", "acht", None)], norm)
    paragraphs = spark.createDataFrame([("w", "9", "1", "een", [5]), ("w", "9", "3", "Lid 1 is niet van toepassing", [1, 3]), ("w", "9", "11", "elf anders", []), ("w", "8", "4", None, [1])], "instrument string, article string, number string, text string, refs array<int>")
    got = {}
    for r in N.related_paragraphs(norms, paragraphs).orderBy("norm_id", "place").collect():
        got.setdefault(r.norm_id, []).append((r.direction, r.number, r.texts))
    both = ["elf", "elf anders"]
    assert got == {1: [("back", "2", ["twee"]), ("back", "3", ["Lid 1 is niet van toepassing"]), ("back", "11", both)], 2: [("forward", "1", ["een"]), ("forward", "11", both)], 3: [("forward", "1", ["een"]), ("back", "2", ["twee"])]}


def test_a_deadline_needs_its_opening(spark):
    cases = {"vier jaar ervaring": None, "binnen 24 uur nadat hij kennis kreeg, en": (24.0, "hour"), "uiterlijk  drie dagen": (3.0, "day"), "binnen het uur": None, "onverwijld": (None, "undelayed")}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", T.deadline(T.F.col("c")).alias("d"), T.deadline_start(T.F.col("c")).alias("s")).collect()
    assert {r.c: r.d and tuple(r.d) for r in rows} == cases
    assert {r.s for r in rows} == {"", "hij kennis kreeg"}
