"""Grids of tables in mark-up."""

from pairloom.sources import tables as G

SPANS = """<bijlage><table><tgroup><colspec colname="1"/><colspec colname="2"/><colspec colname="3"/>
<thead><row><entry colname="1" morerows="1">Artikel</entry><entry namest="2" nameend="3">Bestuurlijke boete</entry></row>
<row><entry colname="1">Artikel</entry><entry colname="2">eerste</entry><entry colname="3"/></row></thead>
<tbody><row><entry colname="1" morerows="1"><al>3 <nadruk>lid</nadruk>
 1</al></entry><entry colname="2">x</entry></row><row><entry colname="2">y</entry><entry colname="3">z</entry></row><row/>
<row><entry colname="1"/><entry namest="2" nameend="3">both</entry><entry colname="9">lost</entry></row></tbody></tgroup></table>
<p><table><tgroup><colspec colname="k"/><tbody><row><entry colname="k">out <table><tgroup><colspec colname="q"/><tbody><row><entry colname="q">in</entry></row></tbody></tgroup></table></entry></row></tbody></tgroup></table></p>
<table><row/></table><table><tgroup><colspec colname="z"/></tgroup></table></bijlage>"""


def test_spans_headers_and_nested_tables(spark):
    docs = spark.createDataFrame([(1, SPANS, "clash"), (None, SPANS, "clash"), (2, None, ""), (3, "", ""), (4, "<broken", ""), (5, "<a/>", "")], "doc_id long, xml string, header string")
    grid = G.table_grid(docs)
    rows = {k: sorted((r.table_no, r.row_no, r.column_no, r.header, r.text) for r in grid.collect() if r.doc_id == k) for k in (1, None)}
    h = ["Artikel", "Bestuurlijke boete – eerste", "Bestuurlijke boete"]
    body = [["3 lid 1", "x", "(geen)"], ["3 lid 1", "y", "z"], ["3 lid 1", "y", "z"], ["(geen)", "both", "both"]]
    want = [(1, i, j, h[j], body[i][j]) for i in range(4) for j in range(3)] + [(2, 0, 0, "k", "out in"), (3, 0, 0, "q", "in")]
    assert rows == {1: want, None: want}
    assert {(r.table_no, r.parent) for r in grid.collect()} == {(1, None), (2, None), (3, 2)}
    lines = {(r.table_no, r.row_no): r.line for r in G.table_lines(grid.filter("doc_id = 1")).collect()}
    assert lines[1, 1] == "Artikel: 3 lid 1 | Bestuurlijke boete – eerste: y | Bestuurlijke boete: z" and lines[3, 0] == "q: in"
    assert G.table_grid(docs.limit(0)).count() == 0


def test_columns_of_one_header(spark):
    xml = '<table><tgroup><colspec colname="a"/><colspec colname="b"/><colspec colname="c"/><thead><row><entry colname="a">H</entry><entry colname="b">K</entry><entry colname="c">H</entry></row></thead><tbody><row><entry colname="a">1</entry><entry colname="b">2</entry><entry colname="c">3</entry></row></tbody></tgroup></table>'
    docs = spark.createDataFrame([(1, xml)], "doc_id long, xml string")
    assert G.table_lines(G.table_grid(docs)).first().line == "H: 3 | K: 2"


def test_marks_of_a_large_table_come_in_pieces(monkeypatch):
    import tracemalloc

    rows = "".join(f'<row><entry colname="a">x{n}</entry><entry colname="b">y &amp; <b>z</b></entry></row>' for n in range(20_000))
    xml = f'<d><table><tgroup><colspec colname="a"/><colspec colname="b"/><tbody>{rows}</tbody></tgroup></table></d>'
    tracemalloc.start()
    last = None
    for k, cell in enumerate(G._cells(xml), 1):
        last = cell
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert k == 60_001 and last == (1, None, "tbody", 19_999, 1, 1, "y & z", ["a", "b"])
    assert most < 3 * len(xml)
