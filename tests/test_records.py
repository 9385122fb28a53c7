"""Records of norms from provisions of several shapes."""

import json

from pairloom.sources import records as R

A = {"instrument_id": "32016R0679", "article": 5, "heading": "", "chapter": "Hoofdstuk IIb. X", "jurisdiction": "EU", "uid": "u5", "paragraphs": [{"number": 1, "text": "een"}, {"number": "1", "text": "dubbel"}, {"number": None, "text": ""}, {"number": "2"}], "norms": [{"deontic": "OBLIGATION", "paragraph_index": 1, "number": "1"}, {"deontic": "RIGHT"}, {"deontic": "PROHIBITION", "number": 1, "action": "x"}, {"deontic": "COMPETENCE", "paragraph_index": 9}, {"deontic": "OBLIGATION", "paragraph_number": "2"}]}
B = {"number": "3", "text": "alles", "chapter": "CHAPTER 4", "norms": [{"deontic": "OBLIGATION"}]}


def test_shapes_and_resolution(spark, tmp_path):
    files = {"list.json": [A, {"article": "x", "norms": [{"deontic": "OBLIGATION"}]}], "one.json": {**B, "instrument_id": "W"}, "annex.json": {"bijlage_35": {"substantive_text": {"provisions": [B, {**B, "instrument_id": "own"}]}}}, "other.json": {"a": 1}, "named.json": [B], "empty.json": []}
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data), encoding="utf-8")
    (tmp_path / "broken.json").write_text("{", encoding="utf-8")
    found = R.read_records(spark, str(tmp_path), fallback={"named.json": "F"})
    assert {(r.source, r.place, r.instrument_id) for r in found.select("source", "place", "instrument_id").collect()} == {("list.json", 0, "32016R0679"), ("list.json", 1, None), ("one.json", 0, "W"), ("annex.json", 0, "BWBR0049497"), ("annex.json", 1, "own"), ("named.json", 0, "F")}
    assert R.without_instrument(found).count() == 1
    got = {r.norm_id: (r.ordinal, r.paragraph, r.resolution, r.hierarchy) for r in R.norm_records(found).collect()}
    assert set(got) == {"32016R0679:5:1:1", "32016R0679:5:1:3", "32016R0679:5:whole:4", "32016R0679:5:2:5", "W:3:whole:1", "BWBR0049497:3:whole:1", "own:3:whole:1", "F:3:whole:1"}
    assert got["32016R0679:5:1:1"][1:3] == ("dubbel", "paragraph_index") and got["32016R0679:5:1:3"][1:3] == ("een", "paragraph_number")
    assert got["32016R0679:5:whole:4"][1:3] == ("een\n\ndubbel", "all_paragraphs") and got["32016R0679:5:2:5"][1:3] == ("", "paragraph_number")
    assert got["W:3:whole:1"][:3] == (1, "alles", "provision_text")
    h = got["32016R0679:5:1:3"][3]
    assert (h.chapter_number, h.article_heading, h.graph_uid, h.jurisdiction, h.paragraph_number) == (None, "Article 5", "u5", "EU", "1")
    assert got["BWBR0049497:3:whole:1"][3].graph_uid == "nl:BWBR0049497:bijlage35-p3@2026-08-15" and got["W:3:whole:1"][3].chapter_number == "4"
    assert R.norm_records(found, eligible=None).count() == 9


def test_slim(spark):
    files = spark.createDataFrame([("f", json.dumps([A]))], "source string, value string")
    norms = R.slim(R.norm_records(R.provisions(files)), ["action", "paragraph_index"]).orderBy("ordinal").select(R.F.to_json("norm").alias("n")).collect()
    assert [json.loads(r.n) for r in norms][:2] == [{"deontic": "OBLIGATION", "number": "1"}, {"deontic": "PROHIBITION", "number": 1}]
    assert R.norm_records(R.provisions(files.limit(0))).count() == 0


def test_paragraphs_are_met_by_key_and_whole_texts_stand_once_for_many_norms(spark, monkeypatch):
    monkeypatch.setattr(R, "TURN", 2)
    norms = [{"deontic": "OBLIGATION", **({"paragraph_index": k} if k % 3 == 0 else {"number": "b"} if k % 3 == 1 else {})} for k in range(9)]
    law = {"instrument_id": "W", "article": "1", "paragraphs": [{"number": "a", "text": "een"}, {"number": "b", "text": "twee"}, {"number": "b", "text": "drie"}], "norms": norms}
    files = spark.createDataFrame([("x", json.dumps([law])), ("y", json.dumps(law))], "source string, value string")
    got = sorted((r.source, r.ordinal, r.paragraph, r.resolution) for r in R.norm_records(R.provisions(files)).collect())
    one = [(k + 1, *(("een", "paragraph_index") if k == 0 else ("twee", "paragraph_number") if k % 3 == 1 else ("een\n\ntwee\n\ndrie", "all_paragraphs"))) for k in range(9)]
    assert got == [(s, *r) for s in ("x", "y") for r in one]
