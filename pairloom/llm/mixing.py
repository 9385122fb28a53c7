"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import cut, words_of

WEIGHTS = (5, 2, 1)
#: Most rows of a table of sources or cells that is broadcast.
BROADCAST_ROWS = 100_000


def targets(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Shares of total by weight; what exceeds cap times a size is shared again among the rest."""
    limit = [float(cap * s) for s in sizes]
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = total
    while free and left > 0:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / whole > limit[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = limit[i]
        left -= sum(limit[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), with at most most[i] for i; ties go to the lower index.

    The quotients are not walked one by one: a divisor found by bisection settles all but
    about one seat a party, and a heap deals out the rest in the order of the quotients.
    """
    n = len(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    held = lambda d: [0 if v <= 0 else min(m, int(v / d + 0.5)) for v, m in zip(votes, most, strict=True)]
    low, high = 0.0, max([*votes, 0.0]) * 4 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or sum(held(mid)) > seats:
            low = mid
        else:
            high = mid
    out = held(high) if n else []
    out = [max(0, x - 1) for x in out]  # what stands below the divisor on any rounding
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(n) if votes[i] > 0 and out[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", *, share: float = 1.5, cap: int = 2, weights: tuple[float, ...] = WEIGHTS, block: int = 32, cell_docs: int = 200_000, seed: int = 0) -> DataFrame:
    """docs plus source_size, target, taken and picks, the blocks chosen.

    Each source is dealt into shards of about cell_docs documents by a seeded hash of the
    document, so a source of any size is spread over tasks.  Within a shard the documents
    stand in seeded order, their words end to end, cut into blocks of `block` words.  The
    blocks of the whole mix are apportioned to the (source, shard) cells by Sainte-Lague,
    votes being each cell's part of its source's target; a cell takes q // n times all its n
    blocks and a seeded choice of q % n of them once more.  picks lists, for a document, its
    spans of words with the times each is taken: (start, length, times), times above 0.

    The driver sees one row for each (source, shard) cell, about one in cell_docs documents
    besides one a source.  Sources stand in code-point order, null last, and weigh `weights`
    in turn.  Null sizes are 0; documents of no words take nothing; rows alike in id and
    source keep any order among themselves; an empty table gives an empty result.  Columns
    that pass through must not begin with `_pl_`; source_size, target, taken and picks are
    replaced.
    """
    base = docs.drop("source_size", "target", "taken", "picks")
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = base.withColumn("_pl_n", F.coalesce(F.col(size_col).cast("long"), F.lit(0))).withColumn("_pl_key", key)
    per_source = {r["s"]: (r["n"], r["t"]) for r in rows.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("_pl_n").alias("t")).collect()}
    names = sorted(per_source, key=lambda s: (s is None, s or ""))
    spark = docs.sparkSession
    sizes = [per_source[s][1] for s in names]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), cap)
    table = spark.createDataFrame(
        [(s, z, a, max(1, -(-per_source[s][0] // cell_docs))) for s, z, a in zip(names, sizes, aims, strict=True)],
        "_pl_s string, source_size long, target double, _pl_cells long",
    )
    rows = rows.join(_small(table, len(names)), F.col(source_col).eqNullSafe(F.col("_pl_s")))
    rows = rows.withColumn("_pl_cell", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.col("_pl_cells")))
    cells = [(r["_pl_s"], r["_pl_cell"], r["t"]) for r in rows.groupBy("_pl_s", "_pl_cell").agg(F.sum("_pl_n").alias("t")).collect()]
    cells.sort(key=lambda c: (c[0] is None, c[0] or "", c[1]))
    aim = dict(zip(names, aims, strict=True))
    votes = [aim[s] * t / per_source[s][1] if t else 0.0 for s, _, t in cells]
    blocks = [-(-t // block) for _, _, t in cells]
    quotas = sainte_lague(votes, round(sum(votes) / block), [cap * b for b in blocks])
    plan = []
    for (s, c, _), b, q in zip(cells, blocks, quotas, strict=True):
        step = _coprime(b, int(b * 0.6180339887) + 1)
        plan.append((s, c, b, q // b if b else 0, q % b if b else 0, step, (seed * 2654435761 + c * 97) % b if b else 0))
    plan_df = spark.createDataFrame(plan, "_pl_s2 string, _pl_cell2 long, _pl_b long, _pl_full long, _pl_rem long, _pl_step long, _pl_shift long")
    rows = rows.join(_small(plan_df, len(plan)), F.col("_pl_s").eqNullSafe(F.col("_pl_s2")) & (F.col("_pl_cell") == F.col("_pl_cell2")))
    ordered = Window.partitionBy("_pl_s", "_pl_cell").orderBy("_pl_key", id_col, "_pl_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_pl_end", F.sum("_pl_n").over(ordered)).withColumn("_pl_start", F.col("_pl_end") - F.col("_pl_n"))
    one = lambda k: F.struct(
        (F.greatest(k * block, F.col("_pl_start")) - F.col("_pl_start")).alias("start"),
        (F.least((k + 1) * block, F.col("_pl_end")) - F.greatest(k * block, F.col("_pl_start"))).alias("length"),
        (F.col("_pl_full") + F.when(F.pmod(k * F.col("_pl_step") + F.col("_pl_shift"), F.col("_pl_b")) < F.col("_pl_rem"), 1).otherwise(0)).alias("times"),
    )
    span = F.sequence(F.floor(F.col("_pl_start") / block), F.floor((F.col("_pl_end") - 1) / block))
    none = F.lit([]).cast(T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "times")]), False))
    picks = F.when(F.col("_pl_n") > 0, F.filter(F.transform(span, one), lambda p: p["times"] > 0)).otherwise(none)
    rows = rows.withColumn("picks", picks)
    rows = rows.withColumn("taken", F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + p["length"] * p["times"]))
    return rows.select(*base.columns, "source_size", "target", "taken", "picks")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of counted rows while it is small; beyond that a shuffled join."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _coprime(n: int, near: int) -> int:
    while n > 1 and math.gcd(near, n) != 1:
        near += 1
    return near


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; a null text has size 0."""
    rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))
    return mix_blocks(cut(rows), **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: a row for each round of a document that takes any of its words.

    Round r keeps the words of the blocks taken at least r times, joined by one space; a round
    that keeps all words keeps the text as it is.  All columns of docs stay, n_chars counted anew.
    """
    docs = docs.withColumn("_pl_row", F.xxhash64("doc_id", "text"))
    rows = cut(docs.select("doc_id", "_pl_row", "source", F.size(words_of(F.col("text"))).cast("long").alias("size")).dropDuplicates(["doc_id", "_pl_row", "source"]))
    picks = mix_blocks(rows, **options).filter("taken > 0").select(F.col("doc_id").alias("_pl_id"), F.col("_pl_row").alias("_pl_r"), F.col("source").alias("_pl_src"), "size", "picks")
    there = docs.join(picks, F.col("doc_id").eqNullSafe(F.col("_pl_id")) & (F.col("_pl_row") == F.col("_pl_r")) & F.col("source").eqNullSafe(F.col("_pl_src")))
    rounds = there.withColumn("_pl_round", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("picks", lambda p: p["times"])))))
    taken = F.filter("picks", lambda p: p["times"] >= F.col("_pl_round"))
    words = words_of(F.col("text"))
    spans = lambda all_words: F.transform(taken, lambda p: F.slice(all_words, (p["start"] + 1).cast("int"), p["length"].cast("int")))
    # The words stand in an array of one, so that the optimiser does not split the text again for each span.
    kept = F.transform(F.array(words), lambda all_words: F.array_join(F.flatten(spans(all_words)), " "))[0]
    whole = F.aggregate(taken, F.lit(0).cast("long"), lambda a, p: a + p["length"]) == F.col("size")
    out = rounds.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[c for c in docs.columns if c != "_pl_row"])
