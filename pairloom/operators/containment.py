"""Quoted spans in whole texts: candidates by the words inside a span, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a window by which a span and a text meet.
WINDOW = 4
#: Most spans that are broadcast at once, and held by a task.
MOST = 20_000


def plain(text: Column) -> Column:
    """Lower case, with one space for each run of white space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def pieces(span: Column) -> Column:
    """What a span shortened with ... or … leaves, in order; the whole span if that is nothing."""
    parts = F.filter(F.transform(F.split(span, r"\.{3,}|…"), plain), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(plain(span)))


def in_order(parts: Column, text: Column) -> Column:
    """Whether all parts stand in the text, each after the one before."""

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(part)).otherwise(0)

    return F.aggregate(parts, F.lit(1), step) > 0


def _windows(words: Column) -> Column:
    n = F.size(words) - WINDOW + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def _holds(text: str, parts: list[str]) -> bool:
    at = 0
    for part in parts:
        at = text.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return True


def _search(shared):
    """(text_id, n) of each text and each span, by its number, that it holds; a text is read once for all spans.

    A span is tried where the words inside its longest piece (WINDOW of them at most) stand, found by the first of them;
    spans without such words are looked for in each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner: dict[str, dict[int, dict[tuple, list]]] = {}
        anywhere = []
        for n, parts in enumerate(shared.value):
            words = max((p.split(" ") for p in parts), key=len)[1:-1][:WINDOW]
            if words:
                inner.setdefault(words[0], {}).setdefault(len(words), {}).setdefault(tuple(words), []).append(n)
            else:
                anywhere.append(n)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = text.split(" ")
                near = set(anywhere)
                for i in [i for i, w in enumerate(words) if w in inner]:
                    for size, runs in inner[words[i]].items():
                        near.update(runs.get(tuple(words[i : i + size]), ()))
                held = [n for n in near if _holds(text, shared.value[n])]
                at += [k] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32())], names=["text_id", "n"])

    return run


def _few(quoted: DataFrame, whole: DataFrame) -> DataFrame:
    """(text_id, span_id) of spans that are few enough for each task to hold."""
    spark = quoted.sparkSession
    some = quoted.select("span_id", "parts").collect()  # about MOST at most
    field = whole.schema["text_id"]
    found = whole.select("text_id", "text").mapInArrow(_search(spark.sparkContext.broadcast([list(r["parts"]) for r in some])), T.StructType([field, T.StructField("n", T.IntegerType())]))
    names = spark.createDataFrame([(n, r["span_id"]) for n, r in enumerate(some)], T.StructType([T.StructField("n", T.IntegerType()), quoted.schema["span_id"]]))
    return found.join(F.broadcast(names), "n").select("text_id", "span_id")


def verbatim_pairs(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, span_id) where the whole of span (span_id, span) is verbatim in text (text_id, text).

    A piece may begin and end within a word, but the words inside it are words of the text, so a
    span is tried only where those of its longest piece stand.  Spans go over the texts MOST at a time, each text read once for
    them; if more than MOST have WINDOW + 2 words, these meet windows of the texts by shuffle.  Spans and texts that are null are left out.
    """
    quoted = spans.filter("span is not null").select("span_id", pieces(F.col("span")).alias("parts")).distinct()
    inner = F.transform("parts", lambda p: F.slice(F.split(p, " "), 2, F.greatest(F.size(F.split(p, " ")) - 2, F.lit(0))))
    found = F.flatten(F.filter(F.transform(inner, _windows), lambda w: w.isNotNull()))
    quoted = quoted.withColumn("h", F.get(found, F.lit(0)))
    whole = texts.filter("text is not null").select("text_id", plain(F.col("text")).alias("text"))
    sizes = quoted.agg(F.count("h").alias("long"), F.count(F.lit(1)).alias("all")).first()
    near, rest = [], quoted
    if sizes["long"] > MOST:
        keyed = whole.withColumn("k", F.xxhash64("text")).dropDuplicates(["text_id", "k"])
        met = keyed.select("text_id", "k", F.explode(F.array_distinct(_windows(F.split("text", " ")))).alias("h"))
        met = met.join(quoted.filter("h is not null").hint("shuffle_hash"), "h").select("text_id", "k", "span_id", "parts").distinct()
        same = F.col("w.text_id").eqNullSafe(F.col("m.text_id")) & (F.col("w.k") == F.col("m.k"))
        full = met.alias("m").join(keyed.alias("w"), same)
        near, rest = [full.filter(in_order(F.col("m.parts"), F.col("w.text"))).select("w.text_id", "m.span_id")], quoted.filter("h is null")
    left = sizes["all"] - (sizes["long"] if near else 0)
    blocks = -(-left // MOST)
    for k in range(blocks):  # a block of the spans, held against all texts
        near.append(_few(rest.filter(F.pmod(F.xxhash64("parts"), F.lit(blocks)) == k), whole))
    if not near:
        return whole.select("text_id").join(quoted.select("span_id"), F.lit(False))
    out = near[0]
    for more in near[1:]:
        out = out.union(more)
    return out.distinct()
