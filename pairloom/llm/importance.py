"""Importance resampling to a target distribution over hashed n-grams, hashed by CRC algebra.

crc(a + b) is crc(a) carried len(b) bytes on, xor crc(b), and carrying on is a matrix over
GF(2).  So each word's CRC is taken once, and those of runs of words follow from it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import raw, released, tune, written

BUCKETS, GRAMS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Words of at most so many bytes are hashed side by side, a byte of each at a time.
SHORT = 48
#: About so many bytes of text are hashed at once.
SLICE = 4 << 20

_FULL = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    """What one zero byte does to each low byte of a CRC."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_STEP = _byte_table()


def _carried(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The product of a matrix, as four tables of 256 sums of its columns, with each of crc."""
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def _shift_tables() -> np.ndarray:
    """The matrices that carry a CRC 1, 2, 4, 8 ... bytes on, each the square of the one before."""
    low = np.arange(256, dtype=np.uint32)
    at = [low << np.uint32(8 * k) for k in range(4)]
    out = [np.stack([_STEP[x & np.uint32(255)] ^ (x >> np.uint32(8)) for x in at])]
    for _ in range(31):
        out.append(np.stack([_carried(out[-1], row) for row in out[-1]]))
    return np.stack(out)


_SHIFTS = _shift_tables()


def shift(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC carried so many bytes on."""
    out = crc.copy()
    for bit in range(int(by.max(initial=0)).bit_length()):
        on = np.flatnonzero((by >> bit) & 1)
        out[on] = _carried(_SHIFTS[bit], out[on])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] of each word."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    long = int((size > SHORT).sum())
    out = np.empty(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order = order[long:]
    at, left = starts[order], size[order]
    crc = np.full(len(order), _FULL)
    active = np.searchsorted(-left, -np.arange(SHORT), side="left")  # words longer than k, for each k
    for k in range(int(left.max(initial=0))):
        m = active[k]
        crc[:m] = _STEP[(crc[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = crc ^ _FULL
    return out


class Grams:
    """The buckets of all runs of 1 to n words of texts: lists[k] has a bucket for each word that a run of k + 1 words starts at, -1 where the text has no such run; of[i]:of[i + 1] are the words of text i."""

    def __init__(self, data: np.ndarray, at: np.ndarray, buckets: int, grams: int):
        data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IN_WORD[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        # A word that runs over the end of a text is cut there.
        cuts = np.unique(at[(at > 0) & (at < len(data))])
        cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
        starts, ends = np.sort(np.concatenate([edge[::2], cuts])), np.sort(np.concatenate([edge[1::2], cuts]))
        self.of = np.searchsorted(starts, at)
        crc, size = word_crcs(data, starts, ends), ends - starts
        last = np.repeat(self.of[1:], np.diff(self.of))  # the end of each word's text
        self.lists, run = [], crc
        for k in range(grams):
            if k:
                open_ = ~run[:-1]
                spaced = ~(_STEP[(open_ ^ np.uint32(32)) & np.uint32(255)] ^ (open_ >> np.uint32(8)))
                run = shift(spaced, size[k:]) ^ crc[k:]
            fits = np.arange(len(run)) + k < last[: len(run)]
            self.lists.append(np.where(fits, (run % np.uint32(buckets)).astype(np.int64), -1))


def _slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about SLICE bytes: first and last row, bytes, offsets."""
    data, at = raw(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """bucket int, n long: how many features of the column text each bucket has; buckets without any are left out."""

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in parts:
            for _, _, data, at in _slices(b.column(0)):
                for x in Grams(data, at, buckets, grams).lists:
                    total += np.bincount(x[x >= 0], minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw_counts: dict[int, int], target_counts: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed share in the target and in the raw texts, floored."""
    s_all, t_all = sum(raw_counts.values()), sum(target_counts.values())
    ratio = lambda s, t: (float(t) + 1) * (float(s_all) + buckets) / ((float(s) + 1) * (float(t_all) + buckets))
    return np.array([math.floor(1000 * math.log(ratio(raw_counts.get(b, 0), target_counts.get(b, 0)))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: weight is the floored mean gain of the features, 0 without any."""
    buckets = len(gains)

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.append(gains, 0)
        for b in parts:
            for lo, hi, data, at in _slices(b.column(1)):
                g = Grams(data, at, buckets, grams)
                total, n = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for x in g.lists:
                    for into, values in ((total, padded[x]), (n, x >= 0)):
                        sums = np.concatenate([[0], np.cumsum(values)])
                        into += sums[np.minimum(g.of[1:], len(x))] - sums[np.minimum(g.of[:-1], len(x))]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.diff(g.of)), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    score is weight plus Gumbel noise that doc_id and seed fix, so the highest scores are a
    draw without replacement by weight.  Of the N rows with min_words words, percent of a
    hundred are drawn (floored), ties to the smaller doc_id, then to fewer features; rows alike in all
    these take the places among themselves in any order.  Null text: empty.  A null doc_id counts as an
    empty one in the noise and comes first among ties.  Empty tables: no rows, or gains against no target.
    Counts are kept a bucket, so what goes to the driver and back is bounded by `buckets`; ranks come from a
    histogram of the integer scores, whose range does not grow with the rows.
    """
    tune(docs.sparkSession)
    gains = bucket_gains(*(dict(map(tuple, bucket_counts(x, buckets, grams).collect())) for x in (docs, target)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weigh(docs, gains, grams).withColumn("score", F.col("weight") + noise), "importance-scores")

    fit = F.col("n_words") >= min_words
    levels = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # over distinct scores
    levels = levels.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("k")).filter("before < k")
    levels = F.broadcast(levels.withColumnRenamed("score", "level"))
    met = scored.join(levels, fit & (F.col("score") == F.col("level")), "left")
    place = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "n_features")
    drawn = met.filter("level IS NOT NULL").withColumn("rank", F.col("before") + F.row_number().over(place))
    drawn = drawn.withColumn("rank", F.expr("if(rank <= k, rank, null)"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(columns).unionByName(met.filter("level IS NULL").withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents, the benchmark's texts as target; see `resample`."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
