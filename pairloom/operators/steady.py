"""Rows kept in reliable storage, so that what follows sees the same rows however often it reads them."""

from __future__ import annotations

import re
import tempfile
import threading

from pyspark.sql import DataFrame

_lock = threading.Lock()


def steady(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the folder that spark.checkpoint.dir names; a folder of its own only where driver and executors are one process."""
    spark = df.sparkSession
    with _lock:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            where = spark.conf.get("spark.checkpoint.dir", None)
            if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="pairloom-"))
    return df.checkpoint(eager=True)
