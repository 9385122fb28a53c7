"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import held_out
from .textkit import cut, tune

#: Most labelled examples of each class, terms of the index, examples to a block, neighbours
#: that vote, and the least chi-squared and document count of a term.
EXAMPLES, TERMS, BLOCK, NEIGHBOURS, MIN_CHI2, MIN_DOCS = 1500, 4096, 64, 15, 30.0, 5
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    """A word itself, and its beginnings and other runs of four and five letters."""
    padded = f"<{word}>"
    runs = {padded[i : i + k] for k in (4, 5) for i in range(len(padded) - k + 1)}
    return [f"={word}", *runs]


class TermCounter:
    """Counts of index terms in whole texts; the terms of a word are kept while they fit."""

    def __init__(self, ids: dict[str, int]):
        self._ids, self._known = ids, {}

    def __call__(self, text: str | None) -> Counter:
        known, ids = self._known, self._ids
        if len(known) > CACHE_WORDS:
            known.clear()
        out: Counter = Counter()
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            terms = known.get(w)
            if terms is None:
                terms = known[w] = [ids[t] for t in word_terms(w) if t in ids]
            for t in terms:
                out[t] += n
        return out


class BlockMaxIndex:
    """Unit vectors of the examples by blocks, each with the greatest weight of every term.

    A block holds the postings of its examples as a small matrix over the terms it has.  A
    query's product with the block maxima bounds every cosine in a block; blocks are searched
    from the highest bound down and left out once the bound is below the query's k-th best,
    so the k nearest are exact.
    """

    def __init__(self, vectors: np.ndarray, block: int = BLOCK):
        order = np.lexsort((np.arange(len(vectors)), np.argmax(vectors, axis=1))) if len(vectors) else np.zeros(0, np.int64)
        self.blocks = []
        self.maxima = np.zeros((-(-len(vectors) // block), vectors.shape[1]), np.float32)
        for b, lo in enumerate(range(0, len(order), block)):
            rows = order[lo : lo + block]
            terms = np.flatnonzero(vectors[rows].any(axis=0))
            self.blocks.append((rows, terms, np.ascontiguousarray(vectors[np.ix_(rows, terms)].T)))
            self.maxima[b, terms] = vectors[np.ix_(rows, terms)].max(axis=0)

    def nearest(self, queries: np.ndarray, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (descending) and rows of the k nearest of each query; row -1 where there are fewer with a shared term."""
        best, who = np.zeros((len(queries), k), np.float32), np.full((len(queries), k), -1, np.int64)
        bounds = queries @ self.maxima.T
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            active = np.flatnonzero(bounds[:, b] > best[:, -1])
            if not len(active):
                continue
            rows, terms, postings = self.blocks[b]
            cos = queries[np.ix_(active, terms)] @ postings
            if leave is not None:
                cos[leave[active][:, None] == rows[None, :]] = 0
            both = np.concatenate([best[active], cos], axis=1)
            names = np.concatenate([who[active], np.broadcast_to(rows, cos.shape)], axis=1)
            names[both <= 0] = -1
            top = np.lexsort((names, -both), axis=1)[:, :k]
            best[active], who[active] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        return best, who


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares rising steps through y over x, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    sums: list[list[float]] = []
    for i in order:
        sums.append([w[i] * y[i], w[i], w[i] * x[i]])
        while len(sums) > 1 and sums[-2][0] * sums[-1][1] >= sums[-1][0] * sums[-2][1]:
            last = sums.pop()
            sums[-1] = [a + b for a, b in zip(sums[-1], last, strict=True)]
    return np.array([s[2] / s[1] for s in sums]), np.array([s[0] / s[1] for s in sums])


class NeighbourModel:
    def __init__(self, terms: list[str], idf: np.ndarray, vectors: np.ndarray, toxic: np.ndarray, weight: np.ndarray, doc_ids: list[int], prior: float):
        self.ids, self.idf, self.doc_ids = {t: i for i, t in enumerate(terms)}, idf, doc_ids
        self.toxic, self.weight = toxic, weight
        some = vectors.any(axis=1) if len(vectors) else np.zeros(0, bool)
        self.index, self.rows = BlockMaxIndex(vectors[some]), np.flatnonzero(some)
        rate = lambda of: float((weight[of] * toxic[of]).sum() + prior) / float(weight[of].sum() + 1)
        self.blank = rate(~some) if len(vectors) else 0.0  # of examples without any term
        self.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if some.any():
            raw, _, _ = self._votes(vectors[some], np.arange(int(some.sum())))
            self.points = isotonic(raw, toxic[some], weight[some])

    def _votes(self, queries: np.ndarray, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos, who = self.index.nearest(queries, NEIGHBOURS, leave)
        there, rows = who >= 0, self.rows[np.maximum(who, 0)] if len(self.rows) else who
        pull = np.where(there, self.weight[rows] * cos / (1.05 - np.minimum(cos, 1)), 0)
        # One vote of the rate among termless examples stands for what neighbours cannot tell.
        return ((pull * self.toxic[rows]).sum(axis=1) + 0.25 * self.blank) / (pull.sum(axis=1) + 0.25), cos, np.where(there, rows, -1)

    def score(self, texts: list[str | None], counter: TermCounter) -> tuple[np.ndarray, list[list[dict]]]:
        out, evidence = np.full(len(texts), self.blank), [[] for _ in texts]
        counts = [counter(t) for t in texts]
        hit = [i for i, c in enumerate(counts) if c]
        if hit and len(self.rows):
            q = np.zeros((len(hit), len(self.idf)), np.float32)
            for r, i in enumerate(hit):
                q[r, list(counts[i])] = list(counts[i].values())
            q = weigh(q, self.idf)
            raw, cos, rows = self._votes(q)
            out[hit] = np.interp(raw, *self.points)
            for r, i in enumerate(hit):
                evidence[i] = [{"doc_id": self.doc_ids[k], "cosine": round(float(c), 6), "toxic": int(self.toxic[k])} for c, k in zip(cos[r, :3], rows[r, :3], strict=True) if k >= 0]
        return np.clip(out, 0, 1), evidence


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> NeighbourModel:
    """Index the labelled examples: at most `examples` of each class, those of least hash of doc_id.

    labels has doc_id and toxic (0 or 1; null rows are left out).  Votes of a class count by
    its size over that of its sample.  Terms are the words, and runs of letters in words, that
    go with toxic examples (chi-squared, at most TERMS).  Repeated rows of a document count
    once.  Without labels or terms all scores are the share of toxic labels, or 0.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    picked = [(r["doc_id"], r["y"]) for r in known.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= examples).select("doc_id", "y").collect()]
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    y_of = dict(picked)
    ids_df = spark.createDataFrame([(i, y) for i, y in sorted(y_of.items())] or [(-1, 0)], "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids_df), "doc_id")  # at most 2 * examples ids

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: Counter = Counter()
                for w, n in Counter(_WORD.findall((text or "").lower())).items():
                    for t in word_terms(w):
                        seen[t] += n
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([y] * n, pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["doc_id", "y", "term", "n"])

    rows = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id").dropDuplicates(["doc_id"])
    # No row for an example without words: their ids are known from the labels.
    found = cut(rows.select("doc_id", "text", "y").mapInArrow(terms_of, "doc_id long, y int, term string, n long"))
    there = {r["doc_id"] for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(ids_df), "doc_id").distinct().collect()}
    kept = sorted(i for i in y_of if i in there)
    n1 = sum(y_of[i] for i in kept)
    n0 = len(kept) - n1
    a, b = F.col("a"), F.col("b")
    c, d, total = F.lit(n1) - a, F.lit(n0) - b, float(n0 + n1)
    chi2 = F.pow(a * d - b * c, F.lit(2.0)) * total / ((a + b) * (c + d) * max(n1, 1) * max(n0, 1) + 1e-9)
    counts = found.groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(F.lit(1) - F.col("y")).cast("double").alias("b"))
    best = counts.filter((a + b >= MIN_DOCS) & (a * max(n0, 1) > b * max(n1, 1))).withColumn("x", chi2).filter(F.col("x") >= MIN_CHI2)
    chosen = best.orderBy(F.desc("x"), "term").limit(TERMS).collect()
    terms = sorted(r["term"] for r in chosen)
    df = {r["term"]: r["a"] + r["b"] for r in chosen}
    idf = np.array([np.log((1 + total) / (1 + df[t])) + 1 for t in terms], np.float32)
    at, index = {i: k for k, i in enumerate(kept)}, {t: k for k, t in enumerate(terms)}
    matrix = np.zeros((len(kept), len(terms)), np.float32)
    if terms:
        chosen_df = spark.createDataFrame([(t,) for t in terms], "term string")
        for r in found.join(F.broadcast(chosen_df), "term").select("doc_id", "term", "n").toLocalIterator():
            matrix[at[r["doc_id"]], index[r["term"]]] = r["n"]
    toxic = np.array([y_of[i] for i in kept], np.float64)
    weight = np.array([sizes[y_of[i]] / max(1, n1 if y_of[i] else n0) for i in kept], np.float64)
    return NeighbourModel(terms, idf, weigh(matrix, idf) if terms else matrix, toxic, weight / max(weight.min(), 1e-12) if len(weight) else weight, kept, prior)


def score_documents(docs: DataFrame, model: NeighbourModel, text: str = "text") -> DataFrame:
    """docs without text, plus score, predicted and evidence (the three nearest examples).

    Whole texts are read; an empty or null text scores as the examples without any term.
    Columns named like the added ones are replaced; the rest pass through.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS
    added = ["score", "predicted", "evidence"]
    keep = [c for c in docs.columns if c != text and c not in added]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counter = TermCounter(model.ids)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                score, evidence = model.score(part.column(part.num_columns - 1).to_pylist(), counter)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, kind)], names=[*keep, *added])

    rows = docs.select(*keep, F.col(text).alias("_pl_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_pl_text")
    return rows.mapInArrow(run, fields + "score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")


def learn(docs: DataFrame, labels: DataFrame) -> NeighbourModel:
    """The model of all labels that are not held out."""
    return fit(docs, labels.filter(~held_out()))


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of all documents."""
    return score_documents(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs, labels)).select("doc_id", "held_out", "score", "predicted", "evidence")
