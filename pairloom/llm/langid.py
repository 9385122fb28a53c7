"""Language identification: nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import raw, tune

#: Width of the hashed n-gram space, n-gram lengths, labelled texts per language to fit on,
#: centroids per language, and the cosine under which a prediction is marked as rejected.
WIDTH, ORDERS, FIT_ROWS, CENTROIDS, REJECT = 8192, (1, 2, 3), 400, 4, 0.25
_BYTES = 1 << 19


def _fold_table() -> np.ndarray:
    """Each code point to its lower-case letter, or 32 if it is no letter."""
    import sys

    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


_table: np.ndarray | None = None


def ngram_counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed letter n-grams (rows by WIDTH), and whether each text has a letter.

    All other characters count as one space between words; n-grams reach over it by one side.
    """
    global _table
    if _table is None:
        _table = _fold_table()
    data, at = raw(texts)
    n = len(at) - 1
    counts, has = np.zeros((n, WIDTH), np.float32), np.zeros(n, bool)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _BYTES, "right")) - 1)
        whole = data[at[lo] : at[hi]]
        head = (whole & 0xC0) != 0x80  # first bytes of code points
        begins = np.concatenate([[0], np.cumsum(head)])[at[lo : hi + 1] - at[lo]]
        points = np.frombuffer(whole.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        folded = _table[points]
        rows = np.repeat(np.arange(hi - lo), np.diff(begins))
        has[lo:hi] = np.bincount(rows[folded != 32], minlength=hi - lo) > 0
        # One space stands before and after each text, and runs of spaces shrink to one.
        prev = np.concatenate([[32], folded[:-1]])
        prev[begins[:-1][begins[:-1] < len(folded)]] = 32
        keep = (folded != 32) | (prev != 32)
        folded, rows = folded[keep].astype(np.uint64), rows[keep]
        for order in ORDERS:
            if len(folded) < order:
                continue
            h = np.zeros(len(folded) - order + 1, np.uint64)
            for k in range(order):
                h = (h * np.uint64(1_000_003)) ^ folded[k : len(folded) - order + 1 + k]
            h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            same = rows[: len(h)] == rows[order - 1 :]
            if order == 1:
                same &= folded != 32
            cell = rows[: len(h)][same] * WIDTH + (h[same] >> np.uint64(51)).astype(np.int64)
            counts[lo:hi] += np.bincount(cell, minlength=(hi - lo) * WIDTH).reshape(hi - lo, WIDTH)
        lo = hi
    return counts, has


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids, from seeds that lie far apart; the same for the same vectors."""
    k = min(k, len(vectors))
    chosen = [vectors.mean(axis=0)]
    near = vectors @ (chosen[0] / max(np.linalg.norm(chosen[0]), 1e-12))
    seeds = []
    for _ in range(k):
        i = int(np.argmin(near))
        seeds.append(vectors[i])
        near = np.maximum(near, vectors @ vectors[i])
    centres = np.array(seeds)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = vectors[own == j].mean(axis=0)
                centres[j] = m / max(np.linalg.norm(m), 1e-12)
    return centres


class CentroidModel:
    def __init__(self, langs: list[str], centres: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.idf = langs, centres, idf

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine to the nearest centroid, 0 to 1) and whether it is rejected."""
        counts, has = ngram_counts(texts)
        if not self.langs:
            return ["und"] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
        cos = np.clip(weigh(counts, self.idf) @ self.centres.T, 0, 1).astype(np.float64)
        best = np.argmax(cos, axis=1)
        score = np.where(has, cos[np.arange(len(has)), best], 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score, ~has | (score < REJECT)


def fit(train: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> CentroidModel:
    """Fit on at most fit_rows texts per language of train (doc_id, text, lang).

    The sample is the rows of least hash of doc_id in each language.  Rows of null or empty
    text and of null language are left out; without rows the model predicts `und` alone.
    """
    from pyspark.sql import Window

    rows = train.filter("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64(F.lit(9), "doc_id").alias("k"), F.xxhash64("text").alias("t"))
    first = rows.select("lang", "k", "t").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "t"))).filter(F.col("r") <= fit_rows)
    picked = first.groupBy("lang").agg(F.max(F.struct("k", "t")).alias("last"))
    last = {r["lang"]: (r["last"]["k"], r["last"]["t"]) for r in picked.collect()}
    sample: list[tuple[str, str]] = []
    for name, (k, t) in sorted(last.items()):
        got = rows.filter((F.col("lang") == name) & ((F.col("k") < k) | ((F.col("k") == k) & (F.col("t") <= t)))).select("text").limit(fit_rows).collect()
        sample += [(name, r["text"]) for r in got]
    if not sample:
        return CentroidModel([], np.zeros((0, WIDTH), np.float32), np.ones(WIDTH, np.float32))
    sample.sort()
    counts, has = ngram_counts(pa.array([t for _, t in sample], pa.large_string()))
    idf = (np.log((1 + len(sample)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = weigh(counts, idf)
    langs, centres = [], []
    for name in sorted(last):
        own = vectors[[i for i, (x, _) in enumerate(sample) if x == name and has[i]]]
        if len(own):
            c = spherical_kmeans(own, centroids)
            langs += [name] * len(c)
            centres.append(c)
    return CentroidModel(langs, np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, WIDTH), np.float32), idf)


def identify(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """docs without text, plus lang_pred, score and rejected.

    Whole texts are read.  A null text or one without a letter is `und` with score 0.  Columns
    named like the added ones are replaced; the rest pass through.
    """
    tune(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                langs, score, out = model.predict(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score), pa.array(out)], names=[*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col(text).alias("_pl_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_pl_text")
    return rows.mapInArrow(run, fields + "lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of all documents, learned from those not held out."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
