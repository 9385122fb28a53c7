"""Writers: counted, append-only-new, replace-by-key and producer-by-producer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_counted(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Write rows as Parquet and give their number, counted as they are written; another number than expected fails."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows written to {path}, {expected} expected")
    return n


def _exists(rows: DataFrame, path: str) -> bool:
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not hold yet; of rows alike in key one is taken."""
    rows = rows.dropDuplicates([key])
    if _exists(rows, path):
        held = rows.sparkSession.read.parquet(path).select(key)
        rows = rows.join(held, key, "left_anti")
    rows.write.mode("append").parquet(path)


def replace_part(rows: DataFrame, path: str, part: str) -> None:
    """Replace whole partitions of a table by the rows of a run; the partitions it has no row of stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def merge_run(old: DataFrame, new: DataFrame, path: str, key: str) -> None:
    """Write old with the rows of new in place of those of the same key, to a new path."""
    old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True).write.mode("errorifexists").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, path: str, sep: str = ";") -> None:
    """A separated table with a header in each part file."""
    rows.write.mode("errorifexists").csv(path, header=True, sep=sep)
