"""Places, shares and exact percentiles over all rows without one task that sees them all: range partitions and the sums of those before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steady import steady

#: The percentiles of a summary.
PERCENTILES = (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95)


def _ranged(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows dealt out by ranges of an order, _pl_part rising with it, as a checkpoint: every run of a plan draws other ranges."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return steady(rows.repartitionByRange(parts, *order).withColumn("_pl_part", F.spark_partition_id()))


def running(rows: DataFrame, order: Sequence[Column], weight: Column, name: str, by: str | None = None) -> DataFrame:
    """rows plus name: the sum of weight (a whole number) over all rows up to this one in an order that tells rows apart, of each value of `by` on its own.

    The order must begin with `by`, if there is one.  A row for each range and value of `by` in it is added up apart.
    """
    group = F.lit(0) if by is None else F.col(by)
    dealt = _ranged(rows.withColumns({"_pl_w": weight.cast("long"), "_pl_g": group}), order)
    total = dealt.groupBy("_pl_g", "_pl_part").agg(F.sum("_pl_w").alias("_pl_sum"))
    before = Window.partitionBy("_pl_g").orderBy("_pl_part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(F.col("_pl_g").alias("_pl_h"), F.col("_pl_part").alias("_pl_q"), F.coalesce(F.sum("_pl_sum").over(before), F.lit(0)).alias("_pl_base"))
    here = Window.partitionBy("_pl_part", "_pl_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_pl_here", F.sum("_pl_w").over(here))
    met = summed.join(base, F.col("_pl_g").eqNullSafe(F.col("_pl_h")) & (F.col("_pl_part") == F.col("_pl_q")))
    return met.select(*rows.columns, (F.col("_pl_base") + F.col("_pl_here")).alias(name))


def distinct_counts(rows: DataFrame, key: str, columns: dict[str, str], least: int = 1) -> DataFrame:
    """key and, by name, how many distinct values that are not null each column has; keys of fewer than `least` rows go, a null key is one.

    Rows are shuffled once, by key: a value's first row is marked by a local sort for each column.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(key, *dict.fromkeys(columns.values())).repartition(parts, key)
    for name, c in columns.items():
        first = F.row_number().over(Window.partitionBy(key, c).orderBy(c)) == 1
        dealt = dealt.withColumn(f"_pl_{name}", (first & F.col(c).isNotNull()).cast("long"))
    out = dealt.groupBy(key).agg(F.count(F.lit(1)).alias("_pl_n"), *[F.sum(f"_pl_{name}").alias(name) for name in columns])
    return out.filter(F.col("_pl_n") >= least).drop("_pl_n")


def placed(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows plus their place from 1 in an order; rows alike in it take the places among themselves in any order."""
    return running(rows, order, F.lit(1), name)


def share_up_to(rows: DataFrame, value: str, name: str = "rank_le") -> DataFrame:
    """rows plus the share of all rows whose value is not above theirs; a null value is below all others, as in an ascending order."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_pl_n"))
    upto = running(counts, [F.asc_nulls_first(value)], F.col("_pl_n"), "_pl_upto")
    n = counts.agg(F.sum("_pl_n").alias("_pl_all"))  # one row
    shares = upto.select(F.col(value).alias("_pl_v"), "_pl_upto").crossJoin(F.broadcast(n))
    met = rows.join(shares, F.col(value).eqNullSafe(F.col("_pl_v")))
    return met.select(*rows.columns, (F.col("_pl_upto").cast("double") / F.col("_pl_all")).alias(name))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: str | None = None) -> DataFrame:
    """by (if given), share and quantile: the exact quantiles of a value, between two values in proportion; nulls take no part.

    Equal values are one row with a count; the values at the places wanted are picked by where their counts begin and end.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*([by] if by else []), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = [*([F.asc_nulls_first(by)] if by else []), F.col("v")]
    upto = running(counts, order, F.col("n"), "upto", by)
    group = F.col(by) if by else F.lit(0)
    size = counts.groupBy(group.alias("_pl_g")).agg(F.sum("n").alias("size"))
    met = upto.withColumn("_pl_h", group).join(size, F.col("_pl_h").eqNullSafe(F.col("_pl_g")))
    asked = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("size") - 1)).alias("at")) for q in shares])).alias("a")
    low, high, first, last = F.floor("a.at"), F.ceil("a.at"), F.col("upto") - F.col("n"), F.col("upto") - 1
    hit = met.select("_pl_g", "v", "n", "upto", "size", asked).filter(((low >= first) & (low <= last)) | ((high >= first) & (high <= last)))
    ends = hit.groupBy("_pl_g", F.col("a.q").alias("share"), F.col("a.at").alias("at")).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = ends.select(*([F.col("_pl_g").alias(by)] if by else []), "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))
    return out


def described(rows: DataFrame, value: str, by: str | None = None, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """by (if given), n, mean, std (of the population), least, most and p1, p5 ... of a value, nulls left out."""
    key = [by] if by else []
    v = F.col(value).cast("double")
    plain = rows.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    wide = quantiles(rows, value, [p / 100 for p in percentiles], by)
    wide = wide.groupBy(*key).agg(*[F.max(F.when(F.col("share") == p / 100, F.col("quantile"))).alias(f"p{p}") for p in percentiles])
    if not by:
        return plain.crossJoin(F.broadcast(wide))  # a row each
    return plain.alias("a").join(wide.alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))).select("a.*", *[f"b.p{p}" for p in percentiles])
