"""Review queues: budgets with caps, stratified samples, and cached verdicts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that come to the driver at once, at least.
PASS = 10_000


def _behind(last: Row, order: Sequence[tuple[str, bool]]) -> Column:
    """Whether a row comes after another one in an order."""
    out, same = F.lit(False), F.lit(True)
    for c, falls in order:
        out |= same & ((F.col(c) < last[c]) if falls else (F.col(c) > last[c]))
        same &= F.col(c) == F.lit(last[c])
    return out


def take_in_turn(rows: DataFrame, order: Sequence[tuple[str, bool]], wanted: int, cap: int, held: Counter, ends: tuple[str, str] = ("i", "j")) -> list[Row]:
    """The first `wanted` rows in order of which both ends have been taken less than cap times, as if chosen row by row; held counts what was taken before, and after.

    order: column and whether it falls; it must tell all rows apart (rows alike in it are one), none of it null.  All tasks
    look for the next rows whose ends have room, some multiple of those still wanted; these alone come to the
    driver, where each is taken or not, and where they run out the search goes on behind them.
    What the driver holds is bounded by `wanted`, and rows of full ends never come.
    """
    taken, last = [], None
    sort = [F.desc(c) if falls else F.asc(c) for c, falls in order]
    while len(taken) < wanted:
        left = rows
        if last is not None:
            left = left.filter(_behind(last, order))
        full = [(k,) for k, n in held.items() if n >= cap]
        for end in ends if full else ():  # at most 2 * wanted / cap
            kind = rows.schema[end].dataType
            left = left.join(F.broadcast(rows.sparkSession.createDataFrame(full, T.StructType([T.StructField(end, kind)]))), end, "left_anti")
        most = max(PASS, 16 * (wanted - len(taken)))
        some = left.select(*rows.columns).orderBy(*sort).limit(most).collect()
        seen = last
        for r in some:
            a, b = r[ends[0]], r[ends[1]]
            if held[a] < cap and held[b] < cap and not (seen is not None and all(r[c] == seen[c] for c, _ in order)):
                taken.append(r)
                held[a] += 1
                held[b] += 1
                if len(taken) == wanted:
                    break
            seen = r
        if len(some) < most:
            break
        last = some[-1]
    return taken


def greedy_budget_cap(pairs: DataFrame, budget: int, cap: int, minimum: float, overshoot: float = 0.1) -> DataFrame:
    """Pairs (i, j, score) taken from the best down: at most `cap` for each owner, `budget` in all.

    Ties go by the pair's hash.  Then pairs equal in score to the last of them are taken too (selection `tie_extension`), with
    the same cap, up to `overshoot` of the budget.  Chosen by `take_in_turn`, so no task sees all pairs.
    """
    key = F.md5(F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string")))
    rows = pairs.filter(F.col("score") >= minimum).select("i", "j", "score", key.alias("h"))
    order, held = [("score", True), ("h", False), ("i", False), ("j", False)], Counter()
    top = take_in_turn(rows, order, budget, cap, held)
    more = []
    if len(top) == budget and budget:
        last = top[-1]
        tied = rows.filter((F.col("score") > last["score"] - 1e-9) & _behind(last, order))
        more = take_in_turn(tied, order, int(budget * overshoot), cap, held)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("i", "j")]
    made = [(r["i"], r["j"], r["score"], n, "top" if n <= budget else "tie_extension") for n, r in enumerate([*top, *more], 1)]
    return pairs.sparkSession.createDataFrame(made, f"i {kinds[0]}, j {kinds[1]}, score double, rank int, selection string")


def draw_with_uses(pool: DataFrame, stratum: str, quota: int | Mapping, uses: int, a: str = "i", b: str = "j", seed: str = "draw") -> DataFrame:
    """Rows of each stratum in hash order up to its quota, nothing in more than `uses` rows in all, whether as a or as b and in whichever strata.

    Smaller strata are drawn first (then lesser names), each row taken if both its sides have uses left, as if
    chosen row by row (`take_in_turn`); draw numbers a stratum's rows.  A stratum whose rows run out stays short; one without a quota has no rows.
    Rows with a null stratum or side take no part, equal sides of a stratum count once.
    """
    good = pool.filter(F.col(stratum).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    sizes = {r[0]: r[1] for r in good.groupBy(stratum).count().collect()}  # a row for each stratum
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(a).cast("string"), F.col(b).cast("string")))
    out, held = [], Counter()
    for s in sorted(sizes, key=lambda s: (sizes[s], s)):
        n = quota if isinstance(quota, int) else quota.get(s, 0)
        rows = good.filter(F.col(stratum) == F.lit(s)).withColumn("_pl_k", key)
        drawn = take_in_turn(rows, [("_pl_k", False), (a, False), (b, False)], n, uses, held, (a, b))
        out += [(*[r[c] for c in pool.columns], k) for k, r in enumerate(drawn, 1)]
    return pool.sparkSession.createDataFrame(out, T.StructType([*pool.schema.fields, T.StructField("draw", T.IntegerType())]))


def sample_key(seed: str = "calibration-v1") -> Column:
    """The key by which the pairs (i, j) are drawn, even over all longs."""
    return F.xxhash64(F.lit(seed), "i", "j")


def calibration_sample(rest: DataFrame, n: int, edges: list[float]) -> list[tuple]:
    """(i, j, score, band) of n of the pairs not taken: equal shares of the bands above falling edges, what small bands leave to the others."""
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("score") >= edges[k], k).otherwise(band)
    first = F.row_number().over(Window.partitionBy("band").orderBy("key", "i", "j"))
    drawn = rest.select("i", "j", "score", band.alias("band"), sample_key().alias("key")).withColumn("r", first).filter(F.col("r") <= n)
    pools: dict[int, list] = {}
    for r in drawn.orderBy("band", "r").collect():  # at most n of a band
        pools.setdefault(r["band"], []).append((r["i"], r["j"], r["score"], r["band"]))
    took, left, open_ = Counter(), n, sorted(pools)
    while left > 0 and open_:
        share = max(1, left // len(open_))
        for k in open_:
            more = min(share, left, len(pools[k]) - took[k])
            took[k] += more
            left -= more
        open_ = [k for k in open_ if took[k] < len(pools[k])]
    return [row for k in sorted(pools) for row in pools[k][: took[k]]]


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows of each stratum by hash of the key, with the probability that a row had."""
    by = Window.partitionBy(stratum)
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = rows.withColumn("r", F.row_number().over(by.orderBy(order, key)))
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    return ranked.filter(F.col("r") <= n).join(sizes, stratum).withColumn("probability", F.round(F.least(F.lit(1.0), F.lit(n) / F.col("size")), 6))


def latest_state(log: DataFrame, key: str, at: str, seq: str, withdrawn) -> DataFrame:
    """The last entry of each key; keys whose last entry is withdrawn have none."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(seq)))
    return log.withColumn("r", last).filter("r = 1").drop("r").filter(~withdrawn)


def cache_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
