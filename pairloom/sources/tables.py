"""Tables in mark-up laid out as grids: spans of rows and columns, headers of several rows, nested tables.

A small parser in the tasks gives one row for each cell as it stands in the mark-up; what
spans and blanks mean is worked out on those rows with windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a cell that no row above fills, and what joins the rows of a header.
NOTHING, JOINED = "(geen)", " – "
#: Characters that a parser is fed with at once, and rows that a task sends on at once.
FED, MARKS = 1 << 16, 10_000
_CELL = "table_no int, parent int, part string, row_no int, first int, last int, text string, columns array<string>"
_GAPS = re.compile(r"\s+")


class _Reader:
    """What a parser is fed with: tables are numbered as they open; the rows and entries of those that `known` (those of a first reading) says have a grid go to `made`."""

    def __init__(self, known: list[dict] | None = None):
        self.known, self.tables, self.made = known, [], []
        self.around, self.texts = [(None, None, None)], []  # of each open element its role, its table and its row; the texts of open entries

    def start(self, tag: str, attrib: dict) -> None:
        up, table, row = self.around[-1]
        role = None
        if tag == "table":
            table, role = {"number": len(self.tables) + 1, "inside": table and table["number"], "names": [], "grid": False, "group": False, "thead": 0, "tbody": 0}, "table"
            self.tables.append(table)
            self._make(table, "grid", 0)
        elif up == "table" and tag == "tgroup" and not table["group"]:
            table["group"], role = True, "group"
        elif up == "group" and tag == "colspec":
            table["names"].append(attrib.get("colname"))
        elif up == "group" and tag in ("thead", "tbody"):
            role = tag
            table["grid"] |= tag == "tbody"
        elif up in ("thead", "tbody") and tag == "row":
            role, row = "row", (up, table[up])
            table[up] += 1
            self._make(table, *row)  # rows without cells count too
        elif up == "row" and tag == "entry":
            role = "entry"
            self.texts.append((attrib, []))
        self.around.append((role, table, row))

    def data(self, text: str) -> None:
        if self.known is not None:
            for _, parts in self.texts:
                parts.append(text)

    def end(self, tag: str) -> None:
        role, table, row = self.around.pop()
        if role == "entry":
            attrib, parts = self.texts.pop()
            self._make(table, *row, attrib, "".join(parts))

    def _make(self, table: dict, part: str, n: int, attrib: dict | None = None, text: str = "") -> None:
        of = self.known and self.known[table["number"] - 1]
        if not of or not of["grid"]:
            return
        names = of["names"]
        if attrib is None:
            self.made.append((table["number"], table["inside"], part, n, -1, -1, None, names))
            return
        ends = [attrib.get(k) or attrib.get("colname") for k in ("namest", "nameend")]
        if not all(e in names for e in ends):
            ends = [attrib.get("colname")] * 2
        if ends[0] in names:
            self.made.append((table["number"], table["inside"], part, n, names.index(ends[0]), names.index(ends[1]), _GAPS.sub(" ", text).strip(), names))


def _cells(xml: str) -> Iterator[tuple]:
    """A row for each row and entry of each table, nested tables too; read twice, FED characters at a time, so that no tree is held.

    The first reading tells the columns of each table and whether it has a grid, and that all is well formed.
    """
    known = None
    for _ in range(2):
        reader = _Reader(known)
        parser = ElementTree.XMLParser(target=reader)
        for k in range(0, len(xml), FED):
            parser.feed(xml[k : k + FED])
            yield from reader.made
            reader.made.clear()
        parser.close()
        yield from reader.made
        known = reader.tables


def table_marks(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """key and the cells of each CALS table as they stand: table_no from 1 in document order, parent (the table around it), part, row_no, first and last column, text, columns.

    Null, empty and broken mark-up has no tables; neither has a table without a group of columns or a body.
    """

    def made(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[key, "table_no", "parent", "part", "row_no", "first", "last", "text", "columns"]).astype({"parent": "Int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in zip(frame["k"], frame["x"], strict=True):
                try:
                    for cell in _cells(text) if text else ():
                        rows.append((k, *cell))
                        if len(rows) == MARKS:
                            yield made(rows)
                            rows = []
                except ElementTree.ParseError:  # in the first reading, before any row
                    continue
            yield made(rows)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(xml).alias("x")).mapInPandas(run, f"{key} {kind}, {_CELL}")


def table_grid(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key, table_no, parent, row_no, column_no, header and text: a row for each place of each table's body, all counted from 0 but table_no.

    A cell fills all columns that it spans, and every row below it down to the next cell of the column: rows
    spanned and cells left out are the same in such mark-up.  A place with nothing above, or
    an empty cell, has the text "(geen)".  A column's header is what its header rows say from the top,
    joined, a label repeated by the next row once; without any, the column's name.  Of
    two cells on one place the last counts.  Keys identify documents; a null key is one too.
    """
    marks = table_marks(docs, key, xml)
    at = [key, "table_no"]
    by = Window.partitionBy(*at, "column_no")
    # Every column of every row once; columns of a table are few, so this grows with its size.
    rows = marks.filter("part <> 'grid' AND first < 0").select(*at, "parent", "part", "row_no", F.posexplode("columns").alias("column_no", "name"))
    spread = marks.filter("first >= 0").withColumn("order", F.monotonically_increasing_id())
    spread = spread.select(*at, "part", "row_no", "order", "text", F.explode(F.sequence(F.least("first", "last"), F.greatest("first", "last"))).alias("column_no"))
    spread = spread.groupBy(*at, "part", "row_no", "column_no").agg(F.max_by("text", "order").alias("text"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*at, "part", "row_no", "column_no")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    full = rows.alias("r").join(spread.alias("c"), on, "left").select("r.*", "c.text")

    heads = full.filter("part = 'thead' AND text <> ''").withColumn("above", F.lag("text").over(by.orderBy("row_no"))).filter("above IS NULL OR above <> text")
    heads = heads.groupBy(*at, "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), JOINED).alias("label"))
    down = F.last("text", ignorenulls=True).over(by.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    body = full.filter("part = 'tbody'").withColumn("text", F.coalesce(F.nullif(down, F.lit("")), F.lit(NOTHING)))
    known = F.col(f"b.{key}").eqNullSafe(F.col(f"h.{key}")) & (F.col("b.table_no") == F.col("h.table_no")) & (F.col("b.column_no") == F.col("h.column_no"))
    return body.alias("b").join(heads.alias("h"), known, "left").select(f"b.{key}", "b.table_no", "parent", "row_no", "b.column_no", F.coalesce("label", "name").alias("header"), "b.text")


def table_lines(grid: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, row_no and line: a row of a grid as `header: text | header: text`; of columns with one header the last text stands at the first one's place."""
    one = grid.groupBy(key, "table_no", "row_no", "header").agg(F.min("column_no").alias("place"), F.max_by("text", "column_no").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "header", "text").alias("part"))))
    return one.groupBy(key, "table_no", "row_no").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " | ").alias("line"))
