"""Readers of line, array, table, edge and mark-up files; bad input fails with its place named."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """One JSON object a non-blank line; a malformed line, or a null in `required`, fails with file and line content."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.trim("value") != "")
    rows = lines.select("file", "value", F.from_json("value", f"{schema}, _pl_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_pl_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._pl_bad").isNotNull()
    for name in required or []:
        bad = bad | F.col(f"r.{name}").isNull()
    # The check is the row itself, so no branch of the plan can leave it out.
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad record in "), "file", F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("r"))
    return rows.select(checked.alias("r")).select("r.*").drop("_pl_bad")


def read_array(spark: SparkSession, path: str, schema: str, wrapper: str = "norms") -> DataFrame:
    """Records of JSON files that hold an array, an object with the array under `wrapper`, or a map of records by id.

    A map's keys go to the column `key`, null for the other two forms.
    """
    whole = spark.read.text(path, wholetext=True)
    record = f"struct<{schema}>"
    text = F.trim("value")
    as_list = F.from_json(text, f"array<{record}>")
    wrapped = F.from_json(F.get_json_object(text, f"$.{wrapper}"), f"array<{record}>")
    keyed = F.from_json(text, f"map<string,{record}>")
    none = F.lit(None).cast("string")
    entry = F.when(text.startswith("["), F.transform(as_list, lambda r: F.struct(none.alias("key"), r.alias("r")))).when(F.get_json_object(text, f"$.{wrapper}").isNotNull(), F.transform(wrapped, lambda r: F.struct(none.alias("key"), r.alias("r")))).otherwise(F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("r"))))
    return whole.select(F.explode(entry).alias("e")).select("e.key", "e.r.*")


def read_loose(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold an array, objects with commas between, or lines with a comma at their end."""
    text = F.regexp_replace(F.trim("value"), r",\s*$", "")
    lines = F.regexp_replace(text, r"\}\s*,?\s*\n\s*\{", "},{")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), lines, F.lit("]")))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A separated table whose lines that start with # are remarks; a line of the wrong shape fails."""
    return spark.read.csv(path, schema=schema, sep=sep, comment="#", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and type of the edge elements of an XML graph; the type attribute is kept, null where absent."""
    schema = "_source string, _target string, _type string"
    return spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path).toDF("src", "dst", "type")


def read_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """pair_id, i, j of pairs that may lack the id; then it is the place of (i, j) in the triangle over n rows.

    Pairs out of range or not in order fail.
    """
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    if "pair_id" not in pairs.columns:
        pairs = pairs.withColumn("pair_id", i * n - F.expr("cast(i as bigint) * (cast(i as bigint) + 1) div 2") + j - i - 1)
    ok = (i >= 0) & (i < j) & (j < n)
    return pairs.select(F.when(ok, F.col("pair_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("pair out of range"), "i", "j")).cast("long")).alias("pair_id"), i.alias("i"), j.alias("j"))


def select_sources(catalogue: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows of a catalogue whose path holds one of the patterns, in any case; a pattern without any row fails."""
    hit = lambda p: F.contains(F.lower("path"), F.lit(p.lower()))
    if not patterns:
        return catalogue
    counts = catalogue.agg(*[F.count_if(hit(p)).alias(str(k)) for k, p in enumerate(patterns)]).first()
    missing = [p for k, p in enumerate(patterns) if not counts[k]]
    if missing:
        raise ValueError(f"no source matches {missing}")
    keep = hit(patterns[0])
    for p in patterns[1:]:
        keep = keep | hit(p)
    return catalogue.filter(keep)


class _Blocks(HTMLParser):
    """Block elements of a page in order: (tag, text), white space to one space."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "li", "td", "th", "title", "div"}
    SILENT = {"script", "style"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self._open: list[str] = []
        self._text: list[str] = []

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        tag = next((t for t in reversed(self._open) if t in self.BLOCKS), "")
        if text:
            self.out.append((tag, text))
        self._text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self._close()
        if tag in self.BLOCKS or tag in self.SILENT:
            self._open.append(tag)

    def handle_endtag(self, tag):
        if tag in self._open:
            if tag in self.BLOCKS:
                self._close()
            while self._open and self._open.pop() != tag:
                pass

    def handle_data(self, data):
        if not (self._open and self._open[-1] in self.SILENT):
            self._text.append(data)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, tag and text of the blocks of each page; null and empty pages have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, page in zip(frame["k"], frame["html"], strict=True):
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                parser._close()
                rows += [(k, n, tag, text) for n, (tag, text) in enumerate(parser.out, 1)]
            yield pd.DataFrame(rows, columns=[key, "position", "tag", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("html")).mapInPandas(run, f"{key} {kind}, position long, tag string, text string")


def xml_articles(spark: SparkSession, path: str, article: str = "artikel", groups: tuple[str, ...] = ("hoofdstuk", "paragraaf")) -> DataFrame:
    """file, position, article, chapter, section, heading and paragraphs of each article element, with the headings it stands under."""
    label = {g: k for k, g in enumerate(groups)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, xml in zip(frame["file"], frame["value"], strict=True):
                stack = [(ElementTree.fromstring(xml), [None] * len(groups))]
                n = 0
                while stack:
                    node, under = stack.pop()
                    if node.tag in label:
                        under = under[: label[node.tag]] + [node.get("label") or (node.findtext("kop") or "").strip() or None] + [None] * (len(groups) - label[node.tag] - 1)
                    if node.tag == article:
                        n += 1
                        parts = [re.sub(r"\s+", " ", "".join(x.itertext())).strip() for x in node.iter("al")]
                        rows.append((file, n, node.get("label"), under[0], under[1] if len(under) > 1 else None, (node.findtext("kop") or "").strip() or None, [p for p in parts if p]))
                        continue
                    stack += [(child, under) for child in reversed(node)]
            yield pd.DataFrame(rows, columns=["file", "position", "article", "chapter", "section", "heading", "paragraphs"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.mapInPandas(run, "file string, position long, article string, chapter string, section string, heading string, paragraphs array<string>")
