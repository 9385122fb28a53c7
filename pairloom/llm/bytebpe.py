"""Byte-level BPE: encoding by rounds of merges over padded matrices of pieces of one length class, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import Kept
from .textkit import released, tune

#: Most pieces whose ids a worker keeps (twice that: two generations).
CACHE_PIECES = 150_000
#: Most cells of a matrix; the longest piece in one, in bytes (the few longer ones have a heap each); pieces looked at together.
CELLS, LONG, PIECES = 1 << 18, 1024, 1 << 18
_NONE = np.int32(0x7FFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids in a table of open addresses: looked up for whole arrays, a step of the probe at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self._bits = max(4, int(4 * len(keys)).bit_length())
        self._keys, self._rank = np.full(1 << self._bits, ~np.uint64(0)), np.full(1 << self._bits, _NONE)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            here = at[todo]
            free = self._keys[here] == ~np.uint64(0)
            self._keys[here[free]] = keys[todo[free]]  # of several, one gets the place
            won = self._keys[here] == keys[todo]
            self._rank[here[won]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, the largest int32 where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._rank[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found != ~np.uint64(0)))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
            found = self._keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._rank[at[todo[hit]]]
            todo = todo[~hit & (found != ~np.uint64(0))]
        return out


class ByteTokenizer:
    """Ids of texts as the file's ranks and the pattern give them, and the bytes of ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._find = regex.compile(pattern).finditer
        self._of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        self._pairs = PairTable(left, right, rank)
        self._rank_of = {(a, b): r for a, b, r in pairs}
        self._kept = Kept(CACHE_PIECES)

    def _merge(self, rows: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ids of each row of a padded matrix of ids after all merges; the last column is padding."""
        out = [b""] * len(rows)
        number = np.arange(len(rows))
        pair = np.full(rows.shape, _NONE)
        fit = np.arange(rows.shape[1] - 1) < (size - 1)[:, None]
        pair[:, :-1][fit] = self._pairs.ranks(rows[:, :-1][fit], rows[:, 1:][fit])
        while len(rows):
            spot = pair.argmin(axis=1)  # the leftmost of the least
            best = pair[np.arange(len(pair)), spot]
            if (done := best == _NONE).any():  # finished rows leave the matrix
                for i in np.flatnonzero(done):
                    out[number[i]] = rows[i, : size[i]].astype("<u4").tobytes()
                go = ~done
                rows, pair, size, number, spot, best = rows[go], pair[go], size[go], number[go], spot[go], best[go]
                keep = int(size.max(initial=0)) + 1
                rows, pair = rows[:, :keep], pair[:, :keep]
            each, column = np.arange(len(rows)), np.arange(rows.shape[1])
            # Compaction: what stands after the merged pair moves up by one.
            moved = np.minimum(column + (column > spot[:, None]), rows.shape[1] - 1)
            rows, pair = np.take_along_axis(rows, moved, 1), np.take_along_axis(pair, moved, 1)
            rows[each, spot] = best
            size = size - 1
            # The ranks of the pairs on both sides of what was merged.
            right = spot < size - 1
            pair[each, spot] = _NONE
            pair[each[right], spot[right]] = self._pairs.ranks(best[right], rows[each[right], spot[right] + 1])
            left = spot > 0
            pair[each[left], spot[left] - 1] = self._pairs.ranks(rows[each[left], spot[left] - 1], best[left])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The ids of one very long piece: the same merges in the same order, its pairs in a heap by rank and place."""
        ids = [int(x) for x in self._of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._pairs.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # merged otherwise since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rank := self._rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(parts)
        rest: list[int] = []
        for i, p in enumerate(parts):
            whole = self.ranks.get(p)
            if whole is None:
                rest.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        for i in [i for i in rest if len(parts[i]) > LONG]:
            out[i] = self._merge_long(parts[i])
        rest = sorted((i for i in rest if len(parts[i]) <= LONG), key=lambda i: len(parts[i]))
        lo = 0
        while lo < len(rest):  # runs of nearly one length, no matrix over CELLS
            first, hi = len(parts[rest[lo]]), lo + 1
            while hi < len(rest) and (m := len(parts[rest[hi]])) <= first + first // 8 + 1 and (hi + 1 - lo) * m <= CELLS:
                hi += 1
            some = [parts[i] for i in rest[lo:hi]]
            size = np.array([len(p) for p in some])
            rows = np.zeros((len(some), int(size.max()) + 1), np.int32)
            rows[np.arange(rows.shape[1]) < size[:, None]] = self._of_byte[np.frombuffer(b"".join(some), np.uint8)]
            for i, ids in zip(rest[lo:hi], self._merge(rows, size), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _known(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        new = self._kept.unknown({p for _, parts in held for p in parts})
        self._kept.new.update(zip(new, self.pieces([p.encode() for p in new]), strict=True))
        for i, parts in held:
            yield i, b"".join(map(self._kept.new.__getitem__, parts))

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids of some next pieces of it as little-endian 32-bit bytes), in order; new pieces of many texts are merged together."""
        held, n = [], 0
        for i, text in enumerate(texts):
            found = self._find(text)
            while parts := [m[0] for m in islice(found, PIECES)]:
                held.append((i, parts))
                n += len(parts)
                if n >= PIECES:
                    yield from self._known(held)
                    held, n = [], 0
        yield from self._known(held)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_open: dict[tuple[str, str], ByteTokenizer] = {}


def tokenizer(path: str, pattern: str) -> ByteTokenizer:
    """The tokenizer of a file, opened once a worker."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteTokenizer(path, pattern)
    return _open[path, pattern]


def _texts(col: pa.Array) -> Iterator[str]:
    for x in col.cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs plus ids array<int>: the tokens of the column text.

    Null and empty texts have no ids; bytes that are not UTF-8 count as U+FFFD.  Rows keep their columns (but for one named ids), repeated rows stay.
    """
    tune(docs.sparkSession)
    docs = docs.drop("ids")

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in parts:
            got: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for i, some in tok.encode(_texts(b.column(b.schema.get_field_index("text")))):
                got[i].append(some)
            ids = [np.frombuffer(b"".join(x), "<i4") for x in got]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows plus decoded binary: the bytes of the column ids (null: null; an id the file does not have is an error)."""
    tune(rows.sparkSession)
    rows = rows.drop("decoded")

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in parts:
            ids = b.column(b.schema.get_field_index("ids"))
            out = [None if not x.is_valid else tok.decode(x.values.to_numpy().astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, some pieces of a text at a time, so that no text's ids are held whole."""
    tune(docs.sparkSession)

    @released
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in parts:
            n = [0] * b.num_rows
            ids, back = ([hashlib.sha256() for _ in n] for _ in range(2))
            for i, some in tok.encode(_texts(b.column(1))):
                n[i] += len(some) // 4
                ids[i].update(some)
                back[i].update(tok.decode(some))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([x.hexdigest() for x in h], pa.string()) for h in (ids, back))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame) -> DataFrame:
    """Tokens, their digest and that of the decoded bytes of all documents.

    Null text: empty.  Every row has a row, repeated ones too; an empty table has none; other columns of docs are not read.
    """
    import public_tokenizers

    return digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
