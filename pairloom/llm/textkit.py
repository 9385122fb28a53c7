"""Shared pieces: the word rule, vectorised tokenising and hashing of Arrow text, reliable cuts.

A word is a maximal run of characters other than space and U+0009..U+000D.  Those are
single bytes in UTF-8, so words are found on the raw bytes of an Arrow string column.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_Q = np.uint64(0x9E3779B97F4A7C15 | 1)
_QI = np.uint64(pow(int(_Q), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_CHUNK = 1 << 20
_pow = _ipow = np.ones(1, np.uint64)


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


_cut_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a folder of its own only where all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="pairloom-")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df in reliable storage (spark.checkpoint.dir), its lineage cut."""
    with _cut_lock:
        sc = df.sparkSession.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for Python workers that share a small executor, and the texts of plans short that the driver keeps of each query (for the rest of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.maxPlanStringLength", "4000")


def _give_back() -> None:
    """Return what this Python process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def alike_at_every_size(spark: SparkSession) -> Iterator[None]:
    """No join is broadcast for being small here; those that are said to be still are."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage now: shuffle files, checkpoints and broadcasts of finished queries go with it."""
    _give_back()
    spark.sparkContext._jvm.System.gc()


def released(run):
    """A mapInArrow function that gives what it no longer needs back to the system when its task ends.

    Workers outlive their tasks; what one stage's tasks held must not stay while the next one's run.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, base in (("_pow", _Q), ("_ipow", _QI)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[starts:ends], the same wherever the range lies."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """Words of the texts of one Arrow column: byte ranges, hashes, and of[i]:of[i + 1] per row."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None, of: np.ndarray):
        self.data, self.starts, self.ends, self.hashes, self.of = data, starts, ends, hashes, of


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    if not len(col) or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def tokenize(col, lower: bool = False, hashed: bool = True) -> Words:
    """Words of whole texts, in pieces of about a megabyte, cut between words."""
    data, at = raw(col)
    table = _LOWER if lower else _BYTE
    first = np.unique(at[:-1][np.diff(at) > 0])
    starts, ends, hashes = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + _CHUNK)
        while hi < n:  # on to the next space or the next row
            step = min(n, hi + _CHUNK)
            gap = np.flatnonzero(_SPACE[data[hi:step]])[:1]
            k = np.searchsorted(first, hi)
            row = first[k] if k < len(first) else n
            here = hi + gap[0] if len(gap) else step
            if row <= here or len(gap):
                hi = min(row, here)
                break
            hi = step
        part = data[lo:hi]
        word = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[first[np.searchsorted(first, lo) : np.searchsorted(first, hi)] - lo] = True
        edge[0] = edge[-1] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if hashed and len(s):
            hashes.append(mix(_range_hash(table[part], s, e) + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = cat(starts, np.int64)
    return Words(data, s, cat(ends, np.int64), cat(hashes, np.uint64) if hashed else None, np.searchsorted(s, at))


def windows(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each window of so many consecutive word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.arange(n)
    values = hashes if not salt else mix(hashes + np.uint64(salt))
    return mix(_range_hash(values, s, s + length) + np.uint64(length))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def batches(table_schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, table_schema, strict=True)], schema=table_schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table of the shared folder: lineage cut, columns packed, read as often as needed; `drop` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # no job to find it out
    out.table_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for t in tables:
        if t is not None and (path := t.__dict__.get("table_path")):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
