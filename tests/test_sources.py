import pytest

from pairloom.sources import files, sinks


def put(at, text):
    at.write_text(text, encoding="utf-8")
    return str(at)


def pairs_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_lines_name_what_is_bad(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"id": 1, "v": "x"}\n\n{"id": 2, "v": null}\n')
    assert pairs_of(files.read_lines(spark, good, "id long, v string", ["id"])) == [(1, "x"), (2, None)]
    for bad in ('{"id": 1', '{"v": "x"}'):
        with pytest.raises(Exception, match="bad record in b.jsonl"):
            files.read_lines(spark, put(tmp_path / "b.jsonl", bad), "id long, v string", ["id"]).collect()


@pytest.mark.parametrize(("text", "keys"), [('[{"id": 1}, {"id": 2}]', [None, None]), ('{"norms": [{"id": 1}, {"id": 2}]}', [None, None]), ('{"a": {"id": 1}, "b": {"id": 2}}', ["a", "b"])])
def test_array_forms(spark, tmp_path, text, keys):
    rows = files.read_array(spark, put(tmp_path / "a.json", text), "id long").orderBy("id").collect()
    assert [(r["key"], r["id"]) for r in rows] == list(zip(keys, [1, 2], strict=True))


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2}]', '{"id": 1},\n{"id": 2},\n', '{"id": 1}\n{"id": 2}', '{"id": 1}, {"id": 2}'])
def test_loose_forms(spark, tmp_path, text):
    assert pairs_of(files.read_loose(spark, put(tmp_path / "a.json", text), "id long")) == [(1,), (2,)]


def test_table_and_edges(spark, tmp_path):
    assert pairs_of(files.read_table(spark, put(tmp_path / "t.tsv", "# remark\neit\tbody\n"), "ending string, class string")) == [("eit", "body")]
    xml = '<g><edges><edge source="a" target="b" type="cites"/><edge source="b" target="c"/></edges></g>'
    assert pairs_of(files.read_edges(spark, put(tmp_path / "g.gexf", xml))) == [("a", "b", "cites"), ("b", "c", None)]


def test_pairs_get_their_place(spark):
    rows = spark.createDataFrame([(i, j) for i in range(5) for j in range(i + 1, 5)], "i int, j int")
    assert sorted(r["pair_id"] for r in files.read_pairs(rows, 5).collect()) == list(range(10))
    with pytest.raises(Exception, match="out of range"):
        files.read_pairs(rows, 3).collect()


def test_source_selection(spark):
    cat = spark.createDataFrame([("Laws/A.json",), ("eu/b.json",)], "path string")
    assert pairs_of(files.select_sources(cat, ["LAWS"])) == [("Laws/A.json",)]
    with pytest.raises(ValueError, match="none"):
        files.select_sources(cat, ["none"])


def test_markup(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<h1>A&amp;B</h1><script>x</script><p>one <b>two</b></p><p></p>tail"), (2, None), (3, "")], "page_id long, html string")
    assert pairs_of(files.html_blocks(pages)) == [(1, 1, "h1", "A&B"), (1, 2, "p", "one two"), (1, 3, "", "tail")]
    xml = '<wet><hoofdstuk label="1"><paragraaf label="1.1"><artikel label="2"><kop>T</kop><al>x  y</al><al/></artikel></paragraaf><artikel label="3"/></hoofdstuk><artikel label="4"><al>z</al></artikel></wet>'
    rows = files.xml_articles(spark, put(tmp_path / "w.xml", xml)).orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "2", "1", "1.1", "T", ["x y"]), (2, "3", "1", None, None, []), (3, "4", None, None, None, ["z"])]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, part string")
    assert sinks.write_counted(rows, str(tmp_path / "c"), 2) == 2
    with pytest.raises(ValueError, match="expected"):
        sinks.write_counted(rows, str(tmp_path / "d"), 3)
    for _ in range(2):
        sinks.append_new(rows.union(rows), str(tmp_path / "e"), "k")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    sinks.replace_part(rows, str(tmp_path / "f"), "part")
    sinks.replace_part(spark.createDataFrame([(9, "b")], "k long, part string"), str(tmp_path / "f"), "part")
    assert pairs_of(spark.read.parquet(str(tmp_path / "f"))) == [(1, "a"), (9, "b")]
    sinks.merge_run(rows, spark.createDataFrame([(2, "z")], "k long, part string"), str(tmp_path / "g"), "k")
    assert pairs_of(spark.read.parquet(str(tmp_path / "g"))) == [(1, "a"), (2, "z")]
    sinks.write_lines(rows, str(tmp_path / "h"))
    sinks.write_table(rows, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "h")).count() == spark.read.csv(str(tmp_path / "i"), sep=";", header=True).count() == 2
