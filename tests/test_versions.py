"""Relations of laws, paragraphs of consolidated text and overlays of versions."""

import random

from pairloom.operators import versions as V
from pairloom.sources import relations as R

WTI = """<wetstechnische-informatie><gerelateerde-regelgeving><regeling>
<verwijzing-door><gerelateerde-regeling geldig-van="2020-01-01" geldig-tot="2021-01-01"><extref bwb-id="B1" doc="jci1.3:c:B1&amp;artikel=5&amp;lid=2" label="L1"> Wet één </extref><extref doc="x"/></gerelateerde-regeling>
<gerelateerd-regelingelement><extref bwb-id="B2">tekst <b>vet</b></extref></gerelateerd-regelingelement></verwijzing-door>
<grondslag-voor><gerelateerde-regeling><extref bwb-id="B3">g</extref></gerelateerde-regeling></grondslag-voor></regeling>
<regelingelementen><regelingelement groep="artikel" label-id="77"><verwijzing-door><gerelateerde-regeling geldig-van="2019-05-05"><extref bwb-id="B4" doc="&amp;hoofdstuk=2">h</extref></gerelateerde-regeling></verwijzing-door><wettelijke-bevoegdheid-voor><gerelateerde-regeling><extref bwb-id="B5">w</extref></gerelateerde-regeling></wettelijke-bevoegdheid-voor></regelingelement>
<regelingelement groep="hoofdstuk" label-id="9"><verwijzing-door><gerelateerde-regeling><extref bwb-id="B6">no</extref></gerelateerde-regeling></verwijzing-door></regelingelement></regelingelementen></gerelateerde-regelgeving></wetstechnische-informatie>"""
WANT = {
    ("instrument", None, "verwijzing-door", "B1", "artikel", "5", "L1", "Wet één", "2020-01-01", "2021-01-01"),
    ("instrument", None, "verwijzing-door", None, None, None, None, "", "2020-01-01", "2021-01-01"),
    ("instrument", None, "verwijzing-door", "B2", None, None, None, "tekst", None, None),
    ("instrument", None, "grondslag-voor", "B3", None, None, None, "g", None, None),
    ("article", "77", "verwijzing-door", "B4", "hoofdstuk", "2", None, "h", "2019-05-05", None),
    ("article", "77", "wettelijke-bevoegdheid-voor", "B5", None, None, None, "w", None, None),
}


def shown(rows):
    return {(r.level, r.label_id, r.kind, r.bwb_id, r.unit_kind, r.unit_value, r.label, r.text.split("\n")[0].strip(), r.valid_from, r.valid_until) for r in rows}


def test_relations(spark, tmp_path):
    docs = spark.createDataFrame([("a", WTI, "clash"), ("b", None, ""), ("c", "<wetstechnische-informatie/>", ""), ("d", "", ""), ("e", "<broken", "")], "instrument string, xml string, kind string")
    rows = R.relations(docs).collect()
    assert shown(rows) == WANT and {r.instrument for r in rows} == {"a"} and len(rows) == 6
    (tmp_path / "BWBR1.xml").write_text(WTI, encoding="utf-8")
    files = R.read_relations(spark, str(tmp_path)).collect()
    assert shown(files) == WANT and {r.instrument for r in files} == {"BWBR1"}


def test_paragraphs(spark):
    rows = [("x", i, t) for i, t in enumerate(["", "intro", "1. een\n  a", None, "vervolg", "2a.  twee", "3.geen", "x 4. y"])] + [("y", 1, "los"), (None, 1, "1. nul")]
    made = V.joined_paragraphs(spark.createDataFrame(rows, "article string, pos int, text string"), ["article"])
    assert {(r.article, r.place, r.number, r.text) for r in made.collect()} == {("x", 0, None, "intro"), ("x", 1, "1", "een a\n\nvervolg"), ("x", 2, "2a", "twee\n\n3.geen\n\nx 4. y"), ("y", 0, None, "los"), (None, 0, "1", "nul")}
    text = {r.article: r.text for r in V.article_text(made, ["article"]).collect()}
    assert text["x"] == "intro\n\n1\neen a\n\nvervolg\n\n2a\ntwee\n\n3.geen\n\nx 4. y"


def test_overlay(spark):
    rng = random.Random(3)
    base = [(k, f"t{k}", f"c{k}") for k in range(30)] + [(None, "null", "c")]
    changes = [(rng.randrange(40), f"n{i}", rng.randrange(6), rng.choice(["replace", "add", "repeal"]), "clash") for i in range(60)] + [(None, "new", 2, "replace", ""), (3, "never", None, "replace", "")]
    b = spark.createDataFrame(base, "article long, text string, chapter string")
    c = spark.createDataFrame(changes, "article long, text string, version int, change string, origin string")
    for at in (None, 3, -1):
        want = {k: (k, t, ch, None, "kept") for k, t, ch in base}
        for k in {r[0] for r in changes}:
            mine = [r for r in changes if r[0] == k and r[2] is not None and (at is None or r[2] <= at)]
            if mine:
                last = min(mine, key=lambda r: (-r[2], r[3] == "repeal", r[3], r[1]))
                if last[3] == "repeal":
                    want.pop(k, None)
                else:
                    want[k] = (k, last[1], want[k][2] if k in want else None, last[2], "replaced" if k in want else "added")
        got = V.overlay(b, c, ["article"], at=at).collect()
        assert {tuple(r) for r in got} == set(want.values()) and len(got) == len(want)
    assert V.overlay(b.limit(0), c.limit(0), ["article"]).count() == 0
