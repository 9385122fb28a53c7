"""Definitions in prose against a plain line scan, and uses of terms against regular expressions."""

import random
import re

from pairloom.operators import definitions as D

SCHEMA = "doc long, text string, term string"
MARK = D.MARK
FL = re.I
INTRO_TERM, INTRO = re.compile(r"\bverstaan\s+onder\s+([^:\n]{2,80}):\s*$", FL), re.compile(r"\b(?:wordt|worden)\b[^.:\n]{0,150}?\bverstaan\s+onder\s*:?\s*$", FL)
STOP = re.compile(r"^\s*(?:(?:artikel|hoofdstuk|afdeling|paragraaf|titel)\s+[\dIVXLC]+[a-z.]*|§.*)\s*$", FL)
ITEM = re.compile(rf"^\s*(?:({MARK})\s+)?([{D.OPEN}][^{D.CLOSE}\n]{{1,80}}[{D.CLOSE}][^:;\n]{{0,40}}?|[^\W\d_][^:;\n]{{1,80}}?)\s*:\s*(\S.*)?$")


def clean(term):
    return re.sub(r"^(?:een|de|het) ", "", " ".join(re.sub(f"[{D.QUOTES}]", "", term).split()))


def scan(text):
    """One pass over the lines with plain variables."""
    out, open_, blanks, kind, item, held = [], False, 0, None, None, None
    for line in text.split("\n"):
        single = INTRO_TERM.search(line)
        if single or INTRO.search(line):
            out.append(item)
            open_, blanks, kind, held = True, 0, "single" if single else None, None
            item = [clean(single[1]), []] if single else None
        elif not open_:
            continue
        elif not line.strip():
            blanks += 1
            if blanks == 3:
                out.append(item)
                open_, item = False, None
        elif STOP.match(line):
            out.append(item)
            open_, item = False, None
        else:
            blanks = 0
            alone = re.fullmatch(rf"\s*({MARK})\s*", line)
            if alone:
                held = alone[1]
                continue
            m = ITEM.match(line)
            mark = (m and m[1]) or held
            mine = "none" if not mark else "dash" if mark == "–" else "num" if mark[0].isdigit() else "alpha"
            fresh = False
            if m and len(clean(m[2]).split()) <= 10:
                kind = kind or mine
                fresh = kind == mine
            if fresh:
                out.append(item)
                item = [clean(m[2]), [m[3] or ""]]
            elif item:
                item[1].append((held + " " if held and held != "–" else "") + line.strip())
            held = None
    return [(t, " ".join(d)) for t, d in filter(None, [*out, item]) if " ".join(d).strip()]


PARTS = ["In deze wet wordt verstaan onder:", "a. aanbieder: wie aanbiedt;", "– „dienst” van een ander: wat telt,", "–", "b.", "1°. iets: deel", "vervolg van de tekst", "", "", "  ", "Artikel 5a", "wordt verstaan onder publieke dienst:", "de gebruiker: wie gebruikt", "c) geen term", "§ 3", "een heel lange reeks van woorden die niet een term kan zijn hier: x", " ", "raad:", "12) bestuur: top"]


def test_lists_equal_a_plain_scan(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choices(PARTS, k=rng.randrange(1, 25))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], ""), (5, None, ""), (6, texts[6], "again"), (7, "", "")]
    got = D.list_definitions(spark.createDataFrame(rows, SCHEMA), ["doc"]).orderBy("at").collect()
    for i, t in [*enumerate(texts), (None, texts[0])]:
        assert [(r.term, r.definition.strip()) for r in got if r.doc == i] == [(a, b.strip()) for a, b in scan(t)], t


def test_sentences_and_labels(spark):
    cases = {
        "In dit artikel wordt verstaan onder openbare onderneming: onderneming met invloed.\nmeer": [("openbare onderneming", "onderneming met invloed.", "verstaan_onder")],
        "wordt verstaan onder dienst: wat hier volgt:\n1. een\n2. twee": [("dienst", "wat hier volgt: 1. een 2. twee", "verstaan_onder")],
        "Van overwegende zeggenschap is sprake indien iemand beslist.": [("overwegende zeggenschap", "iemand beslist.", "is_sprake")],
        "Van macht is sprake indien\na. dit\nb. dat": [("macht", "a. dit b. dat", "is_sprake")],
        "Van deze zaak is sprake als het zo is.": [],
        "Voor zover wordt verwezen naar de wet, wordt hieronder verstaan: het besluit;": [("wet", "het besluit", "hieronder_verstaan")],
        "Onder een dienst, bedoeld in lid 1, wordt mede verstaan een werk.": [("dienst", "een werk.", "onder_verstaan")],
        "Daarbij wordt onder «grote raad» verstaan: de raad zelf": [("grote raad", "de raad zelf", "onder_verstaan")],
        "Onder leiding verstaan zij veel": [],
        "Eerst dit. de Algemene wet bestuursrecht (hierna: de Awb) geldt": [("Awb", "de Algemene wet bestuursrecht", "hierna")],
        "a) voor bepaalde doeleinden verwerkt („doelbinding”); b": [("doelbinding", "voor bepaalde doeleinden verwerkt", "tussen_haakjes")],
        "": [],
    }
    got = D.definitions(spark.createDataFrame([(i, t, "") for i, t in enumerate(cases)], SCHEMA), ["doc"]).collect()
    for i, (text, want) in enumerate(cases.items()):
        assert [(r.term, r.definition, r.pattern) for r in got if r.doc == i] == want, text


def test_first_of_a_term_stands(spark):
    text = "wordt verstaan onder:\na. Dienst: eerst;\nb. dienst: later;\nc. leeg: ;,\n\n\n\nHet werk („dienst”)"
    got = D.definitions(spark.createDataFrame([(1, text, "")], SCHEMA), ["doc"]).collect()
    assert [(r.term, r.definition) for r in got] == [("Dienst", "eerst")]


def test_bullets_and_blank_lines(spark):
    cases = {"Intro:\n1) „AI”: Een  systeem;\n2) risico: kans\n3) geen": [("ai", "een systeem;"), ("risico", "kans")], "Wet: x\n\nterm: uitleg: meer\n\n" + "y" * 101 + ": z\n\nTerm: nieuw": [("wet", "x"), ("term", "nieuw")], "": [], "- a: b\n– c:": [("a", "b"), ("c", "")]}
    rows = spark.createDataFrame([(i, t, "") for i, t in enumerate(cases)] + [(9, None, "")], SCHEMA).select("doc", D.bullet_definitions(D.F.col("text")).alias("d")).orderBy("doc").collect()
    for r, want in zip(rows, cases.values(), strict=False):
        assert [(x.term, x.definition) for x in r.d] == want
    assert not rows[-1].d


def test_uses_equal_regular_expressions(spark):
    rng = random.Random(5)
    words = ["raad", "raden", "Raad", "raads", "raadsel", "van", "toezicht", "AI-systeem", "AI systeem", "é", "raad van toezicht"]
    texts = [(g, a, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for g in ("w1", "w2") for a in range(12)] + [("w1", 99, None), (None, 1, "raad")]
    terms = [(g, t, 3) for g in ("w1", "w2") for t in ("Raad", "raad van toezicht", "van toezicht", "AI-systeem", "é", "nooit", "§")] + [("w1", "raad", 5), ("w1", None, 1)]
    got = D.term_uses(spark.createDataFrame(terms, "instrument string, term string, article long"), spark.createDataFrame(texts, "instrument string, article long, text string")).collect()
    seen = {(r.instrument, r.term.lower()): r for r in got}
    assert len(got) == len(seen) == 14
    for (g, t), r in seen.items():
        pat = re.compile(rf"\b{re.escape(t)}\w{{0,2}}\b", re.I)
        counts = [len(pat.findall(x)) for gg, a, x in texts if gg == g and a != 3 and x] if t != "§" else []
        assert (r.uses, r.used_in) == (sum(counts), sum(c > 0 for c in counts)), (g, t)
