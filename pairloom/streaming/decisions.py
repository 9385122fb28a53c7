"""A decision log as a stream: the current state of each key, with withdrawals, kept across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "at long, seq long, verdict string"
UPDATE = "owner string, item string, at long, seq long, verdict string"


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of what is known and what has come; an entry older than it changes nothing."""
    best = tuple(state.get) if state.exists else None
    for frame in frames:
        for at, seq, verdict in zip(frame["at"], frame["seq"], frame["verdict"], strict=True):
            new = (int(at), int(seq), None if pd.isna(verdict) else verdict)
            # Of entries of one time and number the greater verdict counts, a withdrawal least.
            if best is None or (new[:2], new[2] or "") > (best[:2], best[2] or ""):
                best = new
    state.update(best)
    yield pd.DataFrame([(*key, *best)], columns=["owner", "item", "at", "seq", "verdict"])


def entries(log: DataFrame, owner: str, item: str, at: str, seq: str, verdict: str) -> DataFrame:
    """A log in the columns of the state: owner, item, at (microseconds or a number), seq, verdict (null or empty: withdrawn); entries without owner, item, time or number go."""
    when = F.col(at)
    if dict(log.dtypes)[at].startswith("timestamp"):
        when = F.unix_micros(when.cast("timestamp"))
    rows = log.select(F.col(owner).cast("string").alias("owner"), F.col(item).cast("string").alias("item"), when.cast("long").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(verdict).cast("string").alias("verdict"))
    return rows.filter("owner IS NOT NULL AND item IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL")


def keep_state(log: DataFrame, home: str) -> None:
    """Read a streaming log (see `entries`) to its end, and write what each batch changes under home/updates.

    The state of a key is its newest entry alone, so it does not grow with the log; owners never share a key.
    A restart goes on from home/checkpoint; a batch that runs again writes the same folder again.
    """
    changed = log.groupBy("owner", "item").applyInPandasWithState(_latest, UPDATE, STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/updates/batch={number}")

    changed.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def current_state(spark: SparkSession, home: str) -> DataFrame:
    """owner, item, at, seq, verdict: the last change of each key, but those that were withdrawn."""
    rows = spark.read.schema(f"{UPDATE}, batch long").parquet(f"{home}/updates")
    last = rows.groupBy("owner", "item").agg(F.max_by(F.struct("at", "seq", "verdict"), "batch").alias("s"))
    return last.select("owner", "item", "s.*").filter("verdict <> ''")


def batch_state(log: DataFrame) -> DataFrame:
    """The same state from the whole log at once."""
    best = F.max(F.struct("at", "seq", F.coalesce("verdict", F.lit("")).alias("verdict"))).alias("s")
    return log.groupBy("owner", "item").agg(best).select("owner", "item", "s.at", "s.seq", F.nullif("s.verdict", F.lit("")).alias("verdict")).filter("verdict IS NOT NULL")
