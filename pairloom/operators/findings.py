"""Findings of several producers: assembled with stable ids, kept as variants, each producer replacing only its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import placed

#: The labels of the confidence tiers.
TIERS = {1: "High", 2: "Medium", 3: "Low"}


def finding_id(category: str, left: Column, right: Column) -> Column:
    """An id that follows from the two provisions alone, whichever comes first."""
    low, high = F.least(left, right), F.greatest(left, right)
    return F.concat(F.lit(f"F-{category}-"), F.substring(F.sha2(F.concat_ws("::", low, high), 256), 1, 12))


def assemble(pairs: DataFrame, *, category: str, producer: str, subtype: str, signals: Mapping[str, str], tiers: Mapping[int, str] = TIERS, facts: Sequence[str] = ()) -> DataFrame:
    """producer, subtype, finding_id, rank_score, body (variant): a finding for each pair.

    pairs: left and right (structs with uid and instrument), score, tier, reasons array<string>, verdict, recheck_reason, challenge_survives
    boolean, collides boolean, and the boolean columns that `signals` names, by the criterion that each stands for.
    status: `needs_recheck` with a recheck_reason, else `challenge_failed` if the challenge does not survive, else `unverifiable` for
    the verdict INSUFFICIENT_EVIDENCE, else `candidate`.  incompatibility is null unless the status is candidate.  scope is
    `internal_coherence` within one instrument.  criteria are those whose signal is true, in the order of
    signals.  Equal pairs count once, the best score's; further columns named in facts go into the body as they are.
    """
    status = F.when(F.col("recheck_reason").isNotNull(), "needs_recheck").when(~F.col("challenge_survives"), "challenge_failed").when(F.col("verdict") == "INSUFFICIENT_EVIDENCE", "unverifiable").otherwise("candidate")
    rows = pairs.withColumns({"finding_id": finding_id(category, F.col("left.uid"), F.col("right.uid")), "status": status})
    best = F.row_number().over(Window.partitionBy("finding_id", "subtype").orderBy(F.desc_nulls_last("score"), "tier", F.to_json("left"), F.to_json("right")))
    rows = rows.withColumn("subtype", F.lit(subtype)).withColumn("_pl_best", best).filter("_pl_best = 1")
    criteria = F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for c, name in signals.items()]))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv]), F.col("tier"))
    scope = F.when(F.col("left.instrument").eqNullSafe(F.col("right.instrument")), "internal_coherence").otherwise("cross_law")
    body = F.struct(
        F.lit(category).alias("category"), F.col("status"), F.col("tier").alias("confidence_tier"), label.alias("confidence_label"), F.col("reasons").alias("confidence_reasons"),
        F.when(F.col("status") == "candidate", F.col("collides")).alias("incompatibility_established"), F.array("left", "right").alias("provisions"), scope.alias("scope"),
        criteria.alias("criteria_fired"), F.col("verdict"), F.col("recheck_reason").alias("needs_recheck_reason"), *[F.col(c) for c in facts],
    )
    return rows.select(F.lit(producer).alias("producer"), "subtype", "finding_id", F.col("score").cast("double").alias("rank_score"), F.parse_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("body"))


def replace_own(old: DataFrame, new: DataFrame, producers: Sequence[str]) -> DataFrame:
    """old with all findings of the named producers replaced by theirs in new; what others made stays, rows of new of any other producer are left out."""
    mine = F.coalesce(F.col("producer").isin(*producers), F.lit(False))
    return old.filter(~mine).unionByName(new.filter(mine))


def ranked(findings: DataFrame, producers: Sequence[str]) -> DataFrame:
    """findings plus place from 1, in a fixed order: candidates first, best score first, then by producer in the given order, subtype and id.

    Places are counted within ranges of the order and added up, so that no task sees all rows.
    """
    turn = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in producers]), F.col("producer")), F.lit(0)), F.lit(len(producers) + 1))
    open_ = F.when(F.try_variant_get("body", "$.status", "string") == "candidate", 0).otherwise(1)
    order = [F.col("_pl_open"), F.desc_nulls_last("rank_score"), *map(F.col, ("_pl_turn", "producer", "subtype", "finding_id"))]
    rows = findings.withColumns({"_pl_open": open_, "_pl_turn": turn})
    # Variants cannot be sorted or compared; the order is made on the other columns and meets them by key.
    keys = placed(rows.drop("body").dropDuplicates(["producer", "subtype", "finding_id"]), order)
    return findings.join(keys.select("producer", "subtype", "finding_id", "place"), ["producer", "subtype", "finding_id"])


def write_own(findings: DataFrame, path: str) -> None:
    """Write findings to a table of one folder a producer and subtype; only the folders that findings has rows of are replaced."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("producer", "subtype").parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("producer", "subtype", "finding_id", "rank_score", "body")
