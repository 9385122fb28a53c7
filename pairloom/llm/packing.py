"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import cut, tune

EOS = 2
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Most runs of letters whose ids a worker keeps (twice that: two generations).
CACHE_RUNS = 150_000
#: Characters of text that are cut into runs at once.
CHUNK = 1 << 20
#: Characters that Python takes for spaces and the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Texts whose lower case and composed form are the same for Python and the tokenizer, letter by letter:
#: ASCII, the Latin letters up to U+017F but one, and common quotes and dashes.
_PLAIN = re.compile("[\t-\r -~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027]*")
#: The runs that the tokenizer encodes one by one, in such texts.
_RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
_SPACE = re.compile("[ \t-\r]")


class Kept:
    """A bounded memory of two generations, `new` and the one before it, which goes when `new` is full."""

    def __init__(self, most: int):
        self._most, self.new, self._old = most, {}, {}

    def unknown(self, keys: set) -> list:
        """The keys that are not known; those known are in `new` afterwards."""
        if len(self.new) > self._most:
            self.new, self._old = {}, self.new
        old, out = self._old, []
        for k in keys.difference(self.new):
            if k in old:
                self.new[k] = old[k]
            else:
                out.append(k)
        return out


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary file drops white space and never joins characters across it, so the ids of
    a text are those of its space-separated parts, end to end.  Plain parts are cut into the
    runs of letters, digits and signs that the file encodes apart, and each new run goes
    straight to its merges; words of other characters go through the whole tokenizer.
    """

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tok = Tokenizer.from_file(vocabulary)
        self._model = self._tok.model
        self._ids = [bytes(np.asarray([k], "<u4")) for k in range(self._tok.get_vocab_size())]
        self._level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._runs, self._others = Kept(CACHE_RUNS), Kept(CACHE_RUNS // 10)

    @classmethod
    def of(cls, vocabulary: str) -> WordTokenizer:
        """One for each worker process, whatever the number of its tasks."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def _encode(self, text: str) -> bytes:
        return np.asarray(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        runs = _RUN.findall(text.lower())
        fresh, known, ids, merge = self._runs.unknown(set(runs)), self._runs.new, self._ids, self._model.tokenize
        for r in fresh:
            written = r if r.isascii() else self._level.pre_tokenize_str(r)[0][0]
            known[r] = b"".join([ids[t.id] for t in merge(written)])
        return b"".join([known[r] for r in runs])

    def _part(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        if any(c in text for c in _ODD):
            return self._encode(text)
        words = text.split()
        fresh, known = self._others.unknown({w for w in words if "<|" in w or not _PLAIN.fullmatch(w)}), self._others.new
        for w in fresh:
            known[w] = self._encode(w)
        out, lo = [], 0
        for k, w in enumerate(words):
            if w in known:
                out += [self._plain(" ".join(words[lo:k])), known[w]]
                lo = k + 1
        return b"".join([*out, self._plain(" ".join(words[lo:]))])

    def text(self, text: str | None) -> bytes:
        """The ids of a whole text, read in parts that end before a space."""
        text = text or ""
        if len(text) <= CHUNK:
            return self._part(text)
        out, lo = [], 0
        while lo < len(text):
            space = _SPACE.search(text, lo + CHUNK)
            hi = space.start() if space else len(text)
            out.append(self._part(text[lo:hi]))
            lo = hi
        return b"".join(out)


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = 4096, with_ids: bool = False) -> DataFrame:
    """The token pieces of all documents, of at most `length` tokens each, in PIECE_SCHEMA.

    A text's ids and EOS are cut into whole pieces of `length`, then what is left.  A null or
    empty text has EOS alone.  with_ids adds the ids themselves as array<int>.  Other columns
    are left out.
    """
    tune(docs.sparkSession)
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tok = WordTokenizer.of(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        eos = np.asarray([EOS], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tok.text(data.as_py()) + eos
                n = len(data) // 4
                for start in range(0, n, length):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            if with_ids:
                names, cols = [*names, "ids"], [*cols, pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, times), ...]) of each packing pattern, for counts of lengths up to size.

    Lengths are placed longest first.  Each goes to the packs with the most room, all packs of
    one pattern at a time; when none has room, new packs take as many of the length as fit.
    The work grows with the number of lengths and patterns, never with that of documents.
    """
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    room_heap: list[int] = []
    import heapq

    def put(copies: int, pattern: list[tuple[int, int]], room: int) -> None:
        if room == 0:
            done.append((copies, pattern))
            return
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(room_heap, -room)
        by_room[room].append((copies, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -room_heap[0] if room_heap else 0
            if room < length:
                fit = size // length
                whole, rest = divmod(left, fit)
                if whole:
                    put(whole, [(length, fit)], size - fit * length)
                if rest:
                    put(1, [(length, rest)], size - rest * length)
                break
            copies, pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                heapq.heappop(room_heap)
            used = min(copies, left)
            if copies > used:
                put(copies - used, pattern, room)
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            put(used, grown, room - length)
            left -= used
    return done + [x for packs in by_room.values() for x in packs]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks: documents of a length, by rank, to sequences and offsets.

    A run (length, first rank, first sequence, times, offset) says that ranks from the first
    on fill its sequences in turn, `times` to a sequence.  Sorted by length and first rank.
    """
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rank = seen.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            seen[length] = rank + copies * times
            offset += length * times
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T, strict=True))


def pack(parts: DataFrame, size: int = 4096) -> DataFrame:
    """parts plus sequence_id and offset: all pieces packed into sequences of at most size tokens.

    parts has doc_id, start and length (1 .. size), and any other columns but those added and
    names that begin with `_pl_`.  The driver sees the histogram of lengths, at most `size`
    rows, and makes the patterns; each document then finds its place by its rank among the
    pieces of its length.  The n pieces of a length are ranked in about sqrt(n) groups of
    sqrt(n), so neither the groups nor the table of their sizes lands in one task, whatever
    share of the rows has one length or one doc_id.  Within a group null doc_ids come first;
    rows alike in doc_id and start take their ranks in any order.  An empty table packs to none.
    """
    spark = parts.sparkSession
    parts = cut(parts.drop("sequence_id", "offset").withColumn("_pl_key", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = shortest_pack_first(histogram, size)
    table = slots(patterns)
    salts = spark.createDataFrame([(v, math.isqrt(n - 1) + 1) for v, n in histogram.items()], "_pl_v long, _pl_salts long")
    parts = parts.join(F.broadcast(salts), F.col("length") == F.col("_pl_v"))  # at most `size` rows
    parts = parts.withColumn("_pl_salt", F.pmod(F.xxhash64("doc_id", "start", "_pl_key"), F.col("_pl_salts"))).drop("_pl_v", "_pl_salts")
    counts = parts.groupBy("length", "_pl_salt").agg(F.count(F.lit(1)).alias("_pl_n"))
    before = Window.partitionBy("length").orderBy("_pl_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_pl_base", F.coalesce(F.sum("_pl_n").over(before), F.lit(0))).drop("_pl_n")
    own = Window.partitionBy("length", "_pl_salt").orderBy("doc_id", "start", "_pl_key")
    ranked = parts.withColumn("_pl_row", F.row_number().over(own).cast("long")).join(bases, ["length", "_pl_salt"])
    keep = [c for c in parts.columns if c not in ("_pl_salt", "_pl_key")]
    ranked = ranked.select(*keep, (F.col("_pl_base") + F.col("_pl_row") - 1).alias("_pl_rank"))
    starts = {int(v): (int(np.searchsorted(table["length"], v)), int(np.searchsorted(table["length"], v, "right"))) for v in np.unique(table["length"])}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_pl_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                lo, hi = starts[int(v)]
                of = length == v
                run[of] = lo + np.searchsorted(table["rank"][lo:hi], rank[of], "right") - 1
            into = rank - table["rank"][run] if len(run) else rank
            times = table["times"][run] if len(run) else rank
            sequence = (table["sequence"][run] + into // times) if len(run) else rank
            offset = (table["offset"][run] + (into % times) * length) if len(run) else rank
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_pl_rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; repeated rows are packed as often as they stand."""
    return pack(pieces(docs, vocabulary, size), size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, size: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids (end to end, unpadded) and the doc_ids in their order."""
    packed = pack(pieces(docs, vocabulary, size, with_ids=True), size)
    one = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most size pieces
    return packed.groupBy("sequence_id").agg(one.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
