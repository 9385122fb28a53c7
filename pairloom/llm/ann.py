"""Nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import cut, tune

#: Vectors to fit on, sub-spaces and codes of each.
FIT_ROWS, SUBSPACES, CODES = 20_000, 16, 256
#: Share of the lists that a query probes, and 24 at least.  Set on vectors without any cluster
#: structure, where nothing less gives a recall of 0.9; vectors that cluster need far less.
PROBES, PROBE_SHARE = 24, 0.65
#: Rows of each part of the index that are ranked again exactly: the nearest by the distance
#: tables, so many and this share of the part at least.
RERANK, RERANK_SHARE = 200, 0.04
#: Index rows and query rows that meet in a task.
PART_ROWS, QUERY_ROWS = 20_000, 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k centroids by Lloyd's rounds; the same for the same rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * (x[a : a + 4096] @ centres.T), axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantizer:
    """Coarse centroids, and codebooks of the residuals by sub-space."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest_centre(sample, self.coarse)]
        dims = sample.shape[1]
        self.cuts = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, 6) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest_centre(x, self.coarse)
        rest = x - self.coarse[own]
        codes = [nearest_centre(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of the queries' parts with every code (queries by codes, for each sub-space)."""
        return [q[:, a:b] @ book.T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)


def small(x: np.ndarray) -> np.ndarray:
    """Vectors as the quantizer takes them: single precision, out of reach of its overflow; scores never come from these."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the rows that take part: not null, not zero, all components finite, of the common length; v in single precision if it came so, else in double."""
    v = F.col(vec_col)
    own = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "float" if own == "float" else "double"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast(kind)).alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, probes: int = PROBES, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    queries are rows of the same shape as vectors; a query is no candidate of its own.  The
    quantizer is fitted on at most FIT_ROWS rows of least hash; every row is indexed, but of
    rows with the very same vector only the k + 1 of smallest id, since no query can return
    another.  Lists are joined to parts of about PART_ROWS rows, and the queries that probe a
    part are dealt out in groups of about QUERY_ROWS, so that neither side of a task grows.
    A query probes probe_share of the lists, `probes` at least, more where those hold few rows.  Scores are exact,
    in double precision; ties go to the smaller id.  Rows whose vector is null, zero, of
    another length, or has null or non-finite components take no part, nor do null ids.
    Other columns are left out.  Repeated ids are rows of their own.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(FIT_ROWS).select("v").toArrow() if total else None
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    model = Quantizer(small(_matrix(sample.column(0).combine_chunks())), max(1, min(4096, int(total**0.5))))
    shared = spark.sparkContext.broadcast(model)  # bounded by 4096 lists and the codebooks
    asked = usable(queries, id_col, vec_col).filter(F.size("v") == model.coarse.shape[1])
    kinds = [x.schema["v"].dataType.simpleString() for x in (rows, asked)]
    copies = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.withColumn("r", F.row_number().over(copies)).filter(F.col("r") <= k + 1).drop("r")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = shared.value.encode(small(_matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "list", "codes"])

    index = cut(distinct.mapInArrow(encode, f"vec_id long, v {kinds[0]}, list int, codes binary"))
    sizes = np.zeros(len(model.coarse), np.int64)
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    # Lists in order fill parts; a list beyond PART_ROWS is split over several.
    part_of, splits, part, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes):
        if filled and filled + n > PART_ROWS:
            part, filled = part + 1, 0
        part_of[i], splits[i] = part, max(1, -(-int(n) // PART_ROWS))
        filled += int(n)
        if splits[i] > 1:
            part, filled = part + int(splits[i]), 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            q = small(_matrix(batch.column(1)))
            lists: list[np.ndarray] = []
            order = np.argsort(-(q @ model.coarse.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            need = np.maximum(max(probes, int(probe_share * len(sizes))), (held < min(10 * (k + 1), held[:, -1].max(initial=0))).sum(axis=1) + 1)
            who, part, probe = [], [], []
            for i, n in enumerate(need):
                by_part: dict[int, list[int]] = {}
                for x in order[i, :n]:
                    for s in range(splits[x]):
                        by_part.setdefault(int(part_of[x] + s), []).append(int(x))
                for p, xs in by_part.items():
                    who.append(i)
                    part.append(p)
                    probe.append(xs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), batch.column(1).take(pa.array(who, pa.int64())), pa.array(part, pa.int64()), pa.array(probe, pa.list_(pa.int32()))], names=["query_id", "q", "part", "lists"])

    routed = asked.select("vec_id", "v").mapInArrow(route, f"query_id long, q {kinds[1]}, part long, lists array<int>")
    routed = cut(routed)
    loads = routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / QUERY_ROWS).cast("long")).drop("n")
    table = spark.createDataFrame([(i, int(part_of[i]), int(splits[i])) for i in range(len(sizes))], "list int, part0 long, splits long")
    entries = index.join(F.broadcast(table), "list").withColumn("part", F.col("part0") + F.pmod(F.xxhash64("vec_id"), F.col("splits")))
    entries = entries.join(loads, "part").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    entries = entries.select("part", "group", "list", "vec_id", "v", "codes")
    routed = routed.join(loads, "part").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups"))).select("part", "group", "query_id", "q", "lists")

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        model = shared.value
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if ours.num_rows and theirs.num_rows:
            ids = ours.column("vec_id").to_numpy()
            order = np.lexsort((ids, ours.column("list").to_numpy()))
            ids, own = ids[order], ours.column("list").to_numpy()[order]
            v = _matrix(ours.column("v").combine_chunks())[order]
            codes = np.ascontiguousarray(np.frombuffer(b"".join(ours.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T)
            qs, qid = _matrix(theirs.column("q").combine_chunks()), theirs.column("query_id").to_numpy()
            lists, near = theirs.column("lists").to_pylist(), small(qs) @ model.coarse.T
            wide = v.astype(np.float64)
            again = max(RERANK, int(RERANK_SHARE * len(ids)))
            for a in range(0, len(qid), 512):
                tables = model.tables(small(qs[a : a + 512]))
                for i in range(a, min(a + 512, len(qid))):
                    asked = np.zeros(len(model.coarse), bool)
                    asked[lists[i]] = True
                    about = near[i][own]
                    for m, t in enumerate(tables):
                        about += np.take(t[i - a], codes[m])
                    rows = np.flatnonzero(asked[own])
                    if len(rows) > again:
                        about = about[rows]
                        edge = -np.partition(-about, again - 1)[again - 1]
                        sure, even = rows[about > edge], rows[about == edge]
                        rows = np.concatenate([sure, even[np.argsort(ids[even], kind="stable")][: again - len(sure)]])
                    rows = rows[ids[rows] != qid[i]]
                    score = wide[rows] @ qs[i].astype(np.float64)
                    top = np.lexsort((ids[rows], -score))[:k]
                    found.append((np.full(len(top), qid[i]), ids[rows][top], score[top]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = entries.groupBy("part", "group").cogroup(routed.groupBy("part", "group")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(vectors: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by 20."""
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=k)
