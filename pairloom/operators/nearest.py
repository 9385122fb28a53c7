"""The nearest label of each unit across two tables of vectors: exact, with clusters that the triangle inequality rules out.

Labels are put into clusters around some of themselves.  No label of a cluster is nearer to a
unit than the unit's angle to the centre less the cluster's radius; a unit is first
held against the cluster of its nearest centre, then only against those that could hold a nearer label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .blocks import packed_pairs

#: Centres: a fixed number, so that what every task holds is bounded.
CENTRES = 64
#: Units of a task, and labels that a cluster is cut to, so that no cluster is one task.
BLOCK, PIECE = 2_000, 5_000
#: Units of a block that are multiplied with a piece at once, and rows that a task sends at once.
ROWS, SENT = 128, 5_000
#: Angles are compared with this much room for rounding.
ROOM = 1e-7


def _unit(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and their directions."""
    good = np.array([x is not None and len(x) > 0 and None not in list(x) for x in v], bool)
    rows = np.array([np.asarray(x, float) for x in v[good]]) if good.any() else np.zeros((0, 1))
    size = np.sqrt((rows * rows).sum(axis=1))
    fine = np.isfinite(size) & (size > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return good, rows[fine] / size[fine, None]


def directions(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """id and the direction of each vector; rows whose vector is null, empty, zero or holds nulls or non-finite numbers go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good, v = _unit(f["vector"])
            yield pd.DataFrame({"id": f["id"][good], "v": list(v)})

    kind = rows.schema[id].dataType.simpleString()
    return rows.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(run, f"id {kind}, v array<double>")


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _clusters(v: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    angles = _angle(np.array(list(v)) @ centres.T)
    best = angles.argmin(axis=1)
    return best, angles[np.arange(len(best)), best]


def _block(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    """The vectors of a packed block, all of one length."""
    v = batch.column(name)[row].values
    flat = v.flatten().to_numpy()
    return flat.reshape(len(v), -1)


def _met(pairs: DataFrame, kinds: tuple[DataType, DataType]) -> DataFrame:
    """id, label, cosine and compared: the best label of each unit of packed pairs in all the pieces that a task holds.

    A pair has p, id, v and open (the clusters that each unit is held against) and cluster, label and w.
    """
    shape = T.StructType([T.StructField("id", kinds[0]), T.StructField("label", kinds[1]), T.StructField("cosine", T.DoubleType()), T.StructField("compared", T.LongType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                some = np.flatnonzero(state["compared"])
                for k in range(0, len(some), SENT):
                    take = some[k : k + SENT]
                    yield pa.RecordBatch.from_arrays([state["id"].take(pa.array(take)), pa.array(state["label"][take].tolist(), schema.field("label").type), pa.array(state["cosine"][take]), pa.array(state["compared"][take])], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                p = batch.column("p")[row].as_py()
                if p != at:
                    yield from done()
                    at, n = p, len(batch.column("id")[row].values)
                    state = {"id": batch.column("id")[row].values, "v": _block(batch, row, "v"), "label": np.full(n, None, object), "less": np.full(n, np.inf), "cosine": np.zeros(n), "compared": np.zeros(n, np.int64)}
                    open_ = batch.column("open")[row].values
                    owner = np.repeat(np.arange(n), open_.value_lengths().to_numpy())
                    clusters = open_.flatten().to_numpy()
                mine = owner[clusters == batch.column("cluster")[row].as_py()]
                if not len(mine):
                    continue
                names, others = np.array(batch.column("label")[row].values.to_pylist(), object), _block(batch, row, "w").T
                for k in range(0, len(mine), ROWS):  # so that few products stand at once
                    i = mine[k : k + ROWS]
                    sims = state["v"][i] @ others
                    top = sims.max(axis=1)
                    # Equal but for rounding counts as equal: the least label of the nearest.
                    label = names[(np.round(sims, 12) == np.round(top, 12)[:, None]).argmax(axis=1)]
                    less, before = -np.round(top, 12), state["less"][i]
                    better = less < before
                    tie = np.flatnonzero(less == before)
                    better[tie] = label[tie] < state["label"][i[tie]]
                    for c, new in (("label", label), ("less", less), ("cosine", top)):
                        state[c][i[better]] = new[better]
                    state["compared"][i] += len(names)
        yield from done()

    return pairs.mapInArrow(run, shape)


def nearest_labels(units: DataFrame, labels: DataFrame, *, id: str = "id", label: str = "label", vector: str = "vector", centres: int = CENTRES) -> DataFrame:
    """id, label, cosine and compared: the label nearest to each unit by cosine, ties (to 12 digits) to the least label, and with how many labels it was compared.

    units: id and vector; labels: label and vector, of one length.  Labels that hold one direction are
    compared once, as the least of them.  Vectors without a direction take no part; no labels, no rows.  ids are unique.
    Centres are labels drawn by hash.  Every unit is compared with whole clusters, cut to pieces and dealt out with
    blocks of units, until no other cluster can hold a nearer label: the result is that of all pairs.
    """
    spark = units.sparkSession
    some = directions(labels, label, vector)
    some = some.groupBy("v").agg(F.min("id").alias("id"))
    drawn = some.orderBy(F.xxhash64("id"), "id").limit(centres).toPandas()  # so many rows at most
    kinds = (units.schema[id].dataType.simpleString(), labels.schema[label].dataType.simpleString())
    if drawn.empty:
        return spark.createDataFrame([], f"id {kinds[0]}, label {kinds[1]}, cosine double, compared long")
    middle = np.array(list(drawn["v"]))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                c, a = _clusters(f["v"], middle)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "cluster": c, "angle": a})

    dealt = some.select("id", "v").mapInPandas(assign, f"id {kinds[1]}, v array<double>, cluster int, angle double")
    sizes = dealt.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row for each centre
    pieces = {r["cluster"]: -(-r["n"] // PIECE) for r in sizes}
    radius = np.full(len(middle), -np.inf)
    for r in sizes:
        radius[r["cluster"]] = r["radius"]
    many = F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]), F.col("cluster"))
    number = lambda part: F.col("cluster").cast("long") * 1_000_000_000 + part
    packed = dealt.groupBy(number(F.pmod(F.xxhash64("id"), many)).alias("q"), "cluster").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r")).select("q", "cluster", F.col("r.id").alias("label"), F.col("r.v").alias("w"))
    size = sum(r["n"] for r in sizes) * middle.shape[1] * 8

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                angles = _angle(np.array(list(f["v"])) @ middle.T)
                angles[:, ~np.isfinite(radius)] = np.inf
                near = angles.argmin(axis=1)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "home": near, "open": list(near[:, None])})

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                angles = _angle(np.array(list(f["v"])) @ middle.T)
                open_ = angles - radius <= _angle(f["cosine"].to_numpy())[:, None] + ROOM
                open_[np.arange(len(f)), f["home"].to_numpy()] = False
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "home": f["home"], "open": [np.flatnonzero(x) for x in open_]})

    shape = f"id {kinds[0]}, v array<double>, home int, open array<int>"
    start = directions(units, id, vector).mapInPandas(first, shape)
    counts = {r["home"]: r["count"] for r in start.groupBy("home").count().collect()}  # a row for each centre
    if not counts:
        return spark.createDataFrame([], f"id {kinds[0]}, label {kinds[1]}, cosine double, compared long")
    cuts = {k: -(-n // BLOCK) for k, n in counts.items()}

    def compare(rows: DataFrame) -> DataFrame:
        """Units of one nearest cluster are packed together, so that few blocks are open to a cluster that is far."""
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("home"))
        p = F.col("home").cast("long") * 1_000_000_000 + F.pmod(F.xxhash64("id"), parts)
        sent = rows.filter(F.size("open") > 0).groupBy(p.alias("p")).agg(F.collect_list(F.struct("id", "v", "open")).alias("r")).select("p", F.col("r.id").alias("id"), F.col("r.v").alias("v"), F.col("r.open").alias("open"))
        sent = sent.withColumn("opens", F.array_distinct(F.flatten("open")))  # a number for each centre at most
        pairs = packed_pairs(sent, packed, size, sum(cuts.values())).filter(F.array_contains("opens", F.col("cluster")))
        return _met(pairs.drop("opens", "q"), (units.schema[id].dataType, labels.schema[label].dataType))

    def least(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.min(F.struct((-F.round("cosine", 12)).alias("less"), "label", "cosine")).alias("b"), F.sum("compared").alias("compared")).select("id", "b.label", "b.cosine", "compared")

    near = least(compare(start))
    rest = start.join(near.select("id", "cosine"), "id").mapInPandas(others, shape)
    return least(near.unionByName(compare(rest)))


def with_fallback(nearest: DataFrame, percentile: float, low: float, high: float) -> DataFrame:
    """nearest plus percentile, confidence and accepted: how a unit's cosine stands among all, and the labels of those at or above the percentile.

    percentile is the share of units with a cosine not above it, in percent.  confidence runs from low at the cut to high at the
    top and is null below.  Ranks come from the distinct cosines (to 6 digits), which are at most two million however many units there are.
    """
    from pyspark.sql import Window

    levels = nearest.groupBy(F.round("cosine", 6).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    levels = levels.select("level", (100.0 * upto / F.sum("n").over(Window.partitionBy())).alias("percentile"))
    met = nearest.withColumn("level", F.round("cosine", 6)).join(levels, "level").drop("level")
    share = F.greatest(F.least((F.col("percentile") - percentile) / max(100.0 - percentile, 1e-9), F.lit(1.0)), F.lit(0.0))
    return met.withColumn("accepted", F.col("percentile") >= percentile).withColumn("confidence", F.when(F.col("accepted"), F.round(low + share * (high - low), 4)))
