"""Consolidated text: paragraphs put together from running siblings, and an overlay of later versions of articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The number that opens a paragraph.
NUMBER = r"^(\d+[a-z]?)\.\s+"


def joined_paragraphs(siblings: DataFrame, key: Sequence[str], *, pos: str = "pos", text: str = "text") -> DataFrame:
    """key, place from 0, number and text of paragraphs: a sibling that opens with a number starts one, the others go on with it.

    Siblings without text are left out; those before the first number are a paragraph without one.  Parts are
    joined by an empty line.  Siblings of one position keep the order of their texts.
    """
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    rows = siblings.withColumn("_pl_text", clean).filter("_pl_text <> ''").withColumn("_pl_number", F.nullif(F.regexp_extract("_pl_text", NUMBER, 1), F.lit("")))
    by = Window.partitionBy(*key).orderBy(pos, "_pl_text")
    rows = rows.withColumns({"_pl_run": F.sum(F.col("_pl_number").isNotNull().cast("int")).over(by), "_pl_at": F.row_number().over(by)})
    part = F.struct(F.col("_pl_at"), F.trim(F.regexp_replace("_pl_text", NUMBER, "")).alias("t"))
    out = rows.groupBy(*key, "_pl_run").agg(F.max("_pl_number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_pl_run")) - 1
    return out.withColumn("place", place).select(*key, "place", "number", "text")


def article_text(paragraphs: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, text and paragraphs (array of number and text) of each article, numbers on lines of their own."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "number", "text"))), lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text")))
    out = paragraphs.groupBy(*key).agg(rows.alias("paragraphs"))
    shown = F.transform("paragraphs", lambda p: F.concat_ws("\n", p["number"], p["text"]))
    return out.select(*key, F.array_join(shown, "\n\n").alias("text"), "paragraphs")


def overlay(base: DataFrame, changes: DataFrame, key: Sequence[str], *, version: str = "version", at: str | None = None, change: str = "change") -> DataFrame:
    """base with later versions of its articles: each article as its last change leaves it, and where that comes from.

    changes has the columns of base, version, and change: `replace` or `add` (both put the article in) or
    `repeal` (which takes it out).  Of an article's changes up to `at` (all, if null) the greatest version counts; of one version,
    a repeal gives way to a text, and equal changes to the first by all columns.  origin is `kept`, `replaced` or `added`; version null for a kept article.
    A change whose version is null counts for nothing.  Columns that only base has are kept; keys that are null match each other.
    """
    some = changes.filter(F.col(version).isNotNull())
    if at is not None:
        some = some.filter(F.col(version) <= at)
    columns = [c for c in base.columns if c not in key]
    held = [c for c in columns if c in some.columns]
    order = [F.desc(version), F.when(F.col(change) == "repeal", 1).otherwise(0), change, *held]
    last = some.withColumn("_pl_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_pl_r = 1")
    on = None
    for k in key:
        same = F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = same if on is None else on & same
    there, put = F.col("b._pl_here").isNotNull(), F.col("c._pl_r").isNotNull()
    met = base.withColumn("_pl_here", F.lit(1)).alias("b").join(last.alias("c"), on, "full").filter(~put | (F.col(f"c.{change}") != "repeal"))
    value = lambda c: F.when(put, F.col(f"c.{c}")).otherwise(F.col(f"b.{c}")) if c in held else F.col(f"b.{c}")
    origin = F.when(~put, "kept").when(there, "replaced").otherwise("added")
    return met.select(*[F.when(put, F.col(f"c.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key], *[value(c).alias(c) for c in columns if c != version], F.col(f"c.{version}").alias("version"), origin.alias("origin"))
