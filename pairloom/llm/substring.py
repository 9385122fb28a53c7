"""Repeated passages: windows repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import Words, _range_hash, mix, released, signed, tokenize, tune, windows

#: doc_ids from here on stand for null ones, told apart by 40 bits of a hash of the text: after all others.
NULLS = (1 << 63) - (1 << 40)
_SECOND = 0x5851F42D4C957F2D


def _segments(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, first and last window start (word indices) of each segment, and the half-window hashes.

    The anchor of a window is the half-length window in it of least hash, the first of equals.
    A segment is the run of windows of one row with one anchor.  The anchor depends on the
    window's words alone, so equal windows have equal anchors at equal places in them.
    """
    half, n = window // 2, len(words.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = windows(words.hashes, half)
    row = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    ok = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(ok):
        return none, none, none, none, h
    view = np.lib.stride_tricks.sliding_window_view(h, window - half + 1)
    anchor = np.concatenate([ok[a : a + 65536] + view[ok[a : a + 65536]].argmin(axis=1) for a in range(0, len(ok), 65536)])
    new = np.ones(len(ok), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[ok[1:]] != row[ok[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    return row[ok[first]], anchor[first], ok[first], ok[last], h


def _place(words: Words, row: np.ndarray, at: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Word position in the row, and the row's tag, in one long that sorts by position."""
    return ((at - words.of[row]) << 32) | tag[row]


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and row of each element of a list column; null lists are empty."""
    size = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(col)), size)


def _chosen(words: Words, row: np.ndarray, anchor: np.ndarray, col) -> np.ndarray:
    """Which segments have their anchor's position in the row's list."""
    values, rows = _lists(col)
    wide = np.int64(1) << 32
    return np.isin(row * wide + (anchor - words.of[row]), rows * wide + values)


#: Salts of rows that need not meet the others of their key.
SALTS = 256


def _spread(keys: list[np.ndarray], o: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows to go on with, their salts, and how many rows the key of each has in the batch.

    Salt 0 is for the least (o, position) of a key in the batch.  The others are known to be
    repeats, so only one row a batch has to meet those of other batches: a key of very many
    copies does not end in one task.  Rows alike in all go on once.
    """
    order = np.lexsort((p, o, *keys))
    if not len(order):
        return order, np.zeros(0, np.int32), np.zeros(0, np.int64)
    o, at = o[order], p[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    twin = np.zeros(len(order), bool)
    twin[1:] = ~new[1:] & (o[1:] == o[:-1]) & (at[1:] == at[:-1])
    order, new, o, at = order[~twin], new[~twin], o[~twin], at[~twin] >> 32
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    least = (o == o[head]) & (at == at[head])
    salt = np.where(least, 0, 1 + np.arange(len(order)) % SALTS).astype(np.int32)
    return order, salt, np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1]


def _emit(name: str, window: int):
    """Rows of `anchors` (h, w, o, p, salt), `segments` or `windows` (a, h, o, p, salt) of texts, the latter two at the anchors of `ats`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, tag = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            words = tokenize(batch.column(2))
            row, anchor, lo, hi, h = _segments(words, window)
            if name == "anchors":
                key, by, p = h[anchor], o[row], _place(words, row, anchor, tag)
                on, salt, size = _spread([key], by, p)
                cols = [signed(key[on]), np.minimum(size, 2).astype(np.int32), by[on], p[on], salt]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "w", "o", "p", "salt"])
                continue
            on = _chosen(words, row, anchor, batch.column(3))
            row, anchor, lo, hi = row[on], anchor[on], lo[on], hi[on]
            if name == "segments":
                start, end, at, first = lo, hi + window, anchor, h[anchor]
            else:
                size = hi - lo + 1
                start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                end, row, at = start + window, np.repeat(row, size), start
                first = _range_hash(mix(words.hashes + np.uint64(_SECOND)), start, end) if len(start) else np.zeros(0, np.uint64)
            whole = mix(_range_hash(words.hashes, start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
            by, p = o[row], _place(words, row, at, tag)
            on, salt, _ = _spread([whole, first], by, p)
            cols = [signed(first[on]), signed(whole[on]), by[on], p[on], salt]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "h", "o", "p", "salt"])

    return released(run)


def _rows(docs: DataFrame) -> DataFrame:
    """o (doc_id, from NULLS on for null), tag (crc32 of the text) and text: what a document is known by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(order_id(F.col("doc_id"), text).alias("o"), F.crc32(text).alias("tag"), text.alias("text"))


def order_id(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULLS) + F.shiftrightunsigned(F.xxhash64(text), 24))


def shown_id(o: Column) -> Column:
    return F.when(o < NULLS, o)


def _by_row(found: DataFrame, name: str) -> DataFrame:
    """Positions of (o, p) gathered by document: never more than it has words."""
    return found.select("o", F.col("p").bitwiseAND(0xFFFFFFFF).alias("tag"), F.shiftright("p", 32).cast("int").alias("at")).groupBy("o", "tag").agg(F.collect_set("at").alias(name))


def _repeated(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs; anchors whose whole segment, and windows that, also start earlier.

    Each level shuffles its rows once, by key and salt, and judges them with window functions
    over that; texts are shuffled once, by document, and each level's finds go to them.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    tune(docs.sparkSession)
    rows = _rows(docs)
    sure = F.col("salt") > 0
    # Length window / 2: anchors that occur once alone end here.
    anchors = rows.mapInArrow(_emit("anchors", window), "h long, w int, o long, p long, salt int")
    often = F.sum("w").over(Window.partitionBy("h", "salt"))
    alive = _by_row(anchors.withColumn("n", often).filter(sure | (F.col("n") > 1)), "ats")
    # Length window: whole segments first, so a passage of many copies is one row for each.
    extended = rows.join(alive, ["o", "tag"]).select("o", "tag", "text", "ats")
    segments = extended.mapInArrow(_emit("segments", window), "a long, h long, o long, p long, salt int").repartition("a", "salt")
    kinds, kind = Window.partitionBy("a", "salt"), Window.partitionBy("a", "salt", "h")
    place = F.struct("o", F.shiftright("p", 32))
    held = segments.withColumns({"first": F.min(place).over(kind), "h0": F.min("h").over(kinds), "h1": F.max("h").over(kinds)})
    is_first = ~sure & (place == F.col("first"))
    later = _by_row(held.filter(~is_first), "later")
    # A window's earliest start lies in the first segment of some kind: where an anchor has several
    # kinds, those are told apart by window; of one kind alone, all its windows are new.
    lone = rows.join(_by_row(held.filter(is_first & (F.col("h0") != F.col("h1"))), "ats"), ["o", "tag"]).select("o", "tag", "text", "ats")
    single = lone.mapInArrow(_emit("windows", window), "a long, h long, o long, p long, salt int").repartition("h", "a", "salt")
    starts = _by_row(single.withColumn("first", F.min(place).over(Window.partitionBy("h", "a", "salt"))).filter(sure | (place != F.col("first"))), "starts")
    return rows, later, starts


def _covered(words: Words, window: int, later, starts) -> np.ndarray:
    row, anchor, lo, hi, _ = _segments(words, window)
    on = _chosen(words, row, anchor, later)
    values, rows = _lists(starts)
    begin = np.concatenate([lo[on], values + words.of[rows]])
    end = np.concatenate([hi[on], values + words.of[rows]]) + window
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """o, tag (as in _rows), n_words, n_removed, kept_text, kept_sha256 of all documents.

    Removed are the words covered by a window of so many words whose sequence also starts
    earlier: in a document of smaller doc_id, or before in the same.  Windows are judged on
    the input.  Found level by level: half-length windows first, one in each window (the one
    of least hash), and only where such a one repeats is it extended to the full length.

    Nothing is capped or sampled: of a passage of many copies all but one in a batch of texts
    are known to be repeats at once, and only that one has to meet those of other batches.  Words
    are compared by 64-bit hashes, windows by 96 bits of them.  A null text has no words; a
    null doc_id comes after all others, told apart by text (doc_ids of 2^63 - 2^40 and more are
    taken for null ones); rows alike in doc_id and text are one document, and of rows of one
    doc_id and other texts the word that stands further on is the later one.  Kept
    words are joined by one space; a text that loses nothing stays as it is in kept_text.
    """
    rows, later, starts = _repeated(docs, window)
    joined = rows.join(later, ["o", "tag"], "left").join(starts, ["o", "tag"], "left").select("o", "tag", "text", "later", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = tokenize(batch.column(2))
            gone = _covered(words, window, batch.column(3), batch.column(4))
            data, out = words.data.tobytes(), []
            for i, text in enumerate(batch.column(2).to_pylist()):
                a, b = words.of[i], words.of[i + 1]
                on = np.flatnonzero(~gone[a:b]) + a
                left = b" ".join([data[s:e] for s, e in zip(words.starts[on].tolist(), words.ends[on].tolist(), strict=True)])
                whole = len(on) == b - a
                out.append((b - a, b - a - len(on), text if whole else left.decode("utf-8", "replace"), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["o", "tag", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.mapInArrow(released(run), "o long, tag long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of all documents; without_repeats says how."""
    return without_repeats(docs, window).select(shown_id(F.col("o")).alias("doc_id"), "n_words", "n_removed", "kept_text", "kept_sha256")


def longest_repeats(docs: DataFrame, window: int = 20) -> list[tuple[int, int]]:
    """(length, documents) of each level: lengths double until no document has a repeated window."""
    out, left = [], docs.select("doc_id", "text")
    while True:
        rows, later, starts = _repeated(left, window)
        hit = later.select("o", "tag").union(starts.select("o", "tag")).distinct()
        n = hit.count()
        if not n:
            return out
        out.append((window, n))
        # The earlier copies must stay: all documents with as many words as the next length asks.
        left = left.filter(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")) >= 2 * window)
        window *= 2


def dedup_documents(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all documents."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
