"""Exact Jaccard join of shingle sets: pivot regions, triangle-inequality windows, recursion.

Jaccard distance over the sets of texts that are not copies is almost always 1, so documents
as first pivots would put all in one region.  The pivots are the single shingles: a document
lies at 1 - 1/n from each shingle it has and at 1 from any other, its nearest pivot is the
first of its own in one global order (rare words first), and a partner within the radius r
can miss so few of them that it shares one of the document's first floor(r n) + 1.  Those are
the regions a document is put into, its own and, as a boundary document, the next.  Sets that
are in many large regions, or in a very large one, are put into regions once more, by the order of how many of them have a shingle: what is
a member's own comes first, and one with too much of its own has no region left.  Within a
region documents are the pivots: all are measured against them, and a pair is measured only if
the triangle inequality over the first pivot of each round leaves it open and the two are not linked already.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .substring import _rows, _spread, shown_id
from .textkit import Words, alike_at_every_size, drop, mix, released, signed, sweep, tokenize, tune, windows, written

#: Most frequent words that give the order of the pivots, and rows of a table that is broadcast.
ORDER_WORDS, BROADCAST_ROWS = 1 << 16, 1_000_000
#: Words that a task counts at a time, and word counts that it keeps.
FRESH_WORDS, KNOWN_WORDS = 1 << 18, 1 << 18
#: Sets that a task remembers, so that copies go into their regions once.
SEEN_SETS = 100_000
#: Sets of a region up to which its pairs meet at once.
SMALL = 32
#: Rows of a working table that one partition holds, and pairs of texts that one task measures.
PART_ROWS, PART_PAIRS = 1 << 17, 1024
#: Pivots of a region in a round, and pairs apart for each member up to which a region needs no round.
PIVOTS, WIDE = 8, 64
#: Regions before one that its members know, so that a pair that met in them does not meet again, and shingles sent on at a time.
EARLIER, SENT = 8, 1 << 16
#: Large regions of a set, and members of one of them, from which the set is dealt anew with all its shingles.
MANY, HUGE = 8, 512
_EMPTY = 0
#: Parities of a set's shingles over 256 buckets, in four longs.
SIGNS = ["g0", "g1", "g2", "g3"]
#: Sets of more shingles have parities over as many buckets as they have shingles too, up to so many (powers of two).
NARROW, MOST_BUCKETS = 256, 1 << 16


def _sets(words: Words, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row: its index, its distinct shingle hashes in rising order, and the first word of each."""
    h = windows(words.hashes, shingle) if len(words.starts) else np.zeros(0, np.uint64)
    for i, (a, b) in enumerate(zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True)):
        if b - a >= shingle:
            s, first = np.unique(h[a : b - shingle + 1], return_index=True)
            yield i, s, first + a
        elif b > a:
            yield i, windows(words.hashes[a:b], b - a), np.array([a])
        else:
            yield i, np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _name(hashes: np.ndarray) -> np.uint64:
    """The hash of a set of shingles."""
    return mix(np.array([mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]


def _wide(hashes: np.ndarray) -> bytes | None:
    """Parities of a large set's shingles over as many buckets as it has shingles, at least."""
    if len(hashes) <= NARROW:
        return None
    buckets = min(MOST_BUCKETS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((mix(hashes) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _screen(percent: int):
    """The pairs (x, y) of (x, y, nx, ny, wx, wy) that parities of many buckets leave open: each that differs is a shingle that one set lacks."""

    def folded(bits: np.ndarray, size: int) -> np.ndarray:
        while len(bits) > size:  # a bucket of half as many is two of these
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        return bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.ones(batch.num_rows, bool)
            for i, (n, m, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)):
                if a is not None and b is not None:
                    u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                    size = min(len(u), len(v))
                    on[i] = int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) * (100 + percent) <= (n + m) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(on)) for k in (0, 1)], names=["x", "y"])

    return released(run)


def _profile(shingle: int):
    """Rows of documents (kind 0: o, tag, n, hash of the set) and, at the end, of frequent words (kind 1: hash, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen, known, counts, fresh = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        names = ["kind", "a", "b", "n", "s", *SIGNS, "wide"]

        def merge(known, counts, fresh):
            v, c = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (known[:0], counts[:0])
            both, back = np.unique(np.concatenate([known, v]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([counts, c]), minlength=len(both)).astype(np.int64)
            if len(both) > KNOWN_WORDS:  # the order of the pivots is any; rare words need no count
                on = sums > np.partition(sums, len(sums) - KNOWN_WORDS // 2)[len(sums) - KNOWN_WORDS // 2]
                both, sums = both[on], sums[on]
            return both, sums

        for batch in batches:
            words = tokenize(batch.column(2), lower=True)
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            signs, wide = np.zeros((batch.num_rows, len(SIGNS)), np.uint64), [None] * batch.num_rows
            for i, hashes, _ in _sets(words, shingle):
                n[i] = len(hashes)
                odd = np.bincount((mix(hashes) >> np.uint64(56)).astype(np.int64), minlength=64 * len(SIGNS)) & 1
                signs[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
                wide[i] = _wide(hashes)
                s[i] = _name(hashes) if len(hashes) else _EMPTY
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(1), pa.array(n), pa.array(signed(s)), *[pa.array(signed(np.ascontiguousarray(g))) for g in signs.T], pa.array(wide, pa.binary())], names=names)
            fresh.append(words.hashes)
            words_seen += len(words.hashes)
            if sum(map(len, fresh)) > FRESH_WORDS:
                known, counts = merge(known, counts, fresh)
                fresh = []
        known, counts = merge(known, counts, fresh)
        on = counts >= max(2, words_seen // 1_000_000)
        k = int(on.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(signed(known[on])), pa.array(np.zeros(k, np.int64)), pa.array(counts[on]), *[pa.array(np.zeros(k, np.int64))] * (1 + len(SIGNS)), pa.nulls(k, pa.binary())], names=names)

    return released(run)


def _regions(shingle: int, percent: int, shared):
    """(cell, c, n and place, w, salt): each set's first pivots in the global order, floor(r n) + 1 of them, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, level = shared.value
        seen: set = set()
        for batch in batches:
            words = tokenize(batch.column(2), lower=True)
            grade = np.zeros(len(words.hashes), np.int64)
            if len(table) and len(grade):
                at = np.minimum(np.searchsorted(table, words.hashes), len(table) - 1)
                grade = np.where(table[at] == words.hashes, level[at], 0)
            # A shingle is as rare as its rarest word.
            cells, own, size, place = [], [], [], []
            for i, hashes, first in _sets(words, shingle):
                n = len(hashes)
                if not n:
                    continue
                c = _name(hashes)
                if c in seen:  # a copy: its set has been put into its regions by this task
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(c)
                span = min(shingle, int(words.of[i + 1] - words.of[i]))
                rare = grade[first]
                for k in range(1, span):
                    rare = np.minimum(rare, grade[first + k])
                top = n - -(-percent * n // 100) + 1
                order = np.lexsort((hashes, rare))[:top]
                cells.append(hashes[order])
                own.append(np.full(len(order), c))
                size.append(np.full(len(order), n, np.int64))
                place.append(np.arange(len(order)))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
            cell, c, at = signed(cat(cells)), signed(cat(own)), (cat(size).astype(np.int64) << 32) | cat(place).astype(np.int64)
            on, salt, sets = _spread([cell], c, at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[on], c[on], at[on], np.minimum(sets, 2).astype(np.int32), salt)], names=["cell", "c", "at", "w", "salt"])

    return released(run)


def _shingles(shingle: int):
    """(cell, c): all shingles of the sets c, of rows (c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            cells, own, held = [], [], 0
            for i, hashes, _ in _sets(tokenize(batch.column(1), lower=True), shingle):
                if len(hashes) and int(signed(np.array([_name(hashes)]))[0]) == names[i]:
                    cells.append(hashes)
                    own.append(np.full(len(hashes), names[i], np.int64))
                    held += len(hashes)
                if cells and (held >= SENT or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(cells))), pa.array(np.concatenate(own))], names=["cell", "c"])
                    cells, own, held = [], [], 0

    return released(run)


def _dealt_anew(nodes: DataFrame, rows: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """nodes with cell and pos: the regions of their first pivots in the order of how many nodes have a shingle, and their places in it.

    Shingles that one node alone has come first and need no region.
    """
    parts = _texts(rows, nodes, sets).mapInArrow(_shingles(shingle), "cell long, c long")
    parts = parts.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("m > 1")
    own = Window.partitionBy("c")
    # A repeated row's text comes as often; its shingles count more, in the same way for all.
    placed = parts.repartition("c").groupBy("c", "cell").agg(F.first("m").alias("m"))
    placed = placed.withColumns({"rank": F.row_number().over(own.orderBy("m", "cell")), "shared": F.count(F.lit(1)).over(own)})
    placed = placed.join(nodes, "c").withColumn("pos", F.col("n") - F.col("shared") + F.col("rank") - 1)
    return placed.filter((F.col("n") - F.col("pos")) * 100 >= F.col("n") * percent).drop("m", "rank", "shared")


def _measure(shingle: int):
    """(x, y, nx, ny, common) of pairs of texts; the last text of the second column is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ys = part.column(1).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(np.append(True, ys[1:] != ys[:-1]))
                left = [s for _, s, _ in _sets(tokenize(part.column(2), lower=True), shingle)]
                right = [s for _, s, _ in _sets(tokenize(part.column(3).take(pa.array(new)), lower=True), shingle)]
                at, rows = -1, []
                for i, a in enumerate(left):
                    if at + 1 < len(new) and new[at + 1] == i:
                        at += 1
                        if ys[i] != key or kept is None:
                            key, kept = ys[i], right[at]
                    both = np.concatenate([a, kept])
                    both.sort()
                    rows.append((len(a), len(kept), int((both[1:] == both[:-1]).sum())))
                cols = np.array(rows, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c) for c in cols]], names=["x", "y", "nx", "ny", "common"])

    return released(run)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a table of the shared folder.

    A checkpoint would keep the planner's guess of its size, and guesses multiply at each join: over
    many rounds they become numbers of millions of digits, which fill the driver.  A table has the size of its files.
    """
    return written(df, "jaccard")


def packed(df: DataFrame) -> DataFrame:
    """The rows of df as a table, read in as few partitions as its rows need: what one partition holds is not shuffled again."""
    table = cut(df)
    n = table.count()
    out = table.coalesce(max(1, -(-n // PART_ROWS)))
    out.table_path, out.n_rows = table.table_path, n
    return out


def _either(df: DataFrame, *rows: list[Column]) -> DataFrame:
    """Each row of df as several; no union, which would part what lies together."""
    return df.select(F.inline(F.array(*[F.struct(*r) for r in rows])))


def _is_star(stars: DataFrame) -> bool:
    """Whether each u has one v and no u is a v of another."""
    end = lambda k, below: [F.col(k).alias("k"), F.lit(below).alias("below"), F.lit(1 - below).alias("above")]
    ends = _either(stars, end("u", 1), end("v", 0))
    sums = ends.groupBy("k").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.agg(F.count(F.when(F.col("below") + F.col("above") > 1, 1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(c, root): the least node that links reach, for all nodes of edges (x, y) but the least; large-star, small-star."""
    stars = packed(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    while not _is_star(stars):
        # Large star: the greater neighbours of a node go to the least of its neighbourhood.
        both = _either(stars, [F.col("u"), F.col("v")], [F.col("v").alias("u"), F.col("u").alias("v")])
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pulled = _either(small, [F.col("v").alias("u"), F.col("m").alias("v")], [F.col("u"), F.col("m").alias("v")])
        old, stars = stars, packed(pulled.filter("u <> v").distinct())
        drop(old)
    out = stars.select(F.col("u").alias("c"), F.col("v").alias("root"))
    out.table_path = stars.table_path
    return out


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of roots after more links, found between their roots alone."""
    if roots is None:
        return components(links)
    of = lambda k: roots.select(F.col("c").alias(k), F.col("root").alias(f"r{k}"))
    met = links.join(of("x"), "x", "left").join(of("y"), "y", "left")
    step = components(met.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")))
    moved = roots.join(step.select(F.col("c").alias("root"), F.col("root").alias("to")), "root", "left")
    out = packed(moved.select("c", F.coalesce("to", "root").alias("root")).union(step))
    drop(roots, step)
    return out


def _texts(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, text) of the first document of each set among nodes."""
    first = sets.join(nodes, "c").select("c", F.col("first.o").alias("o"), F.col("first.tag").alias("tag"))
    n = nodes.n_rows
    first = F.broadcast(first) if n <= BROADCAST_ROWS else first
    return rows.join(first, ["o", "tag"]).select("c", "text").dropDuplicates(["c"]) if n > BROADCAST_ROWS else rows.join(first, ["o", "tag"]).select("c", "text")


def _verify(pairs: DataFrame, rows: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """x, y, nx, ny, common of the pairs (x, y) that may link; only their texts are moved."""
    side = lambda k: sets.filter("wide is not null").select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
    pairs = packed(pairs)
    both = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left").select("x", "y", "nx", "ny", "wx", "wy")
    old, pairs = pairs, packed(both.mapInArrow(_screen(percent), "x long, y long"))
    drop(old)
    nodes = packed(_either(pairs, [F.col("x").alias("c")], [F.col("y").alias("c")]).distinct())
    texts = _texts(rows, nodes, sets)
    left = pairs.join(texts.select(F.col("c").alias("x"), F.col("text").alias("tx")), "x")
    full = left.join(texts.select(F.col("c").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")
    full = full.coalesce(max(1, -(-pairs.n_rows // PART_PAIRS)))
    out = packed(full.mapInArrow(_measure(shingle), "x long, y long, nx long, ny long, common long"))
    drop(pairs, nodes)
    return out


def _unmeasured(pairs: DataFrame, measured: list[DataFrame]) -> DataFrame:
    """The pairs (x, y) that no table of measured ones has."""
    done = functools.reduce(DataFrame.union, [m.select("x", "y") for m in measured])
    done = done.coalesce(max(1, -(-sum(m.n_rows for m in measured) // PART_ROWS)))
    return pairs.join(done, ["x", "y"], "left_anti")


def linked_sets(docs: DataFrame, shingle: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: o, tag, n, c), (the least set that links reach, for linked sets but the least: c, root), (classes: c, first)."""
    with alike_at_every_size(docs.sparkSession):
        return _linked_sets(docs, shingle, percent)


def _linked_sets(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    tune(spark)
    sweep(spark)
    rows = _rows(docs)
    profile = cut(rows.select("o", "tag", "text").mapInArrow(_profile(shingle), "kind int, a long, b long, n long, s long, " + ", ".join(f"{g} long" for g in SIGNS) + ", wide binary"))
    members = profile.filter("kind = 0").select(F.col("a").alias("o"), F.col("b").alias("tag"), "n", F.col("s").alias("c"))
    table = profile.filter("kind = 1").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(ORDER_WORDS).toArrow()
    hashes = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    level = (np.log2(np.maximum(table.column("n").to_numpy(), 1)) * 2).astype(np.int64)[order] + 1
    shared = spark.sparkContext.broadcast((hashes[order], level))  # at most ORDER_WORDS entries
    sets = profile.filter("kind = 0 and n > 0").groupBy(F.col("s").alias("c"))
    sets = packed(sets.agg(F.min(F.struct(F.col("a").alias("o"), F.col("b").alias("tag"))).alias("first"), *[F.first(k).alias(k) for k in ["n", *SIGNS, "wide"]]))
    regions = rows.mapInArrow(_regions(shingle, percent, shared), "cell long, c long, at long, w int, salt int")
    # Only regions of two sets and more go on; copies of a set are one member.
    over = Window.partitionBy("cell", "salt")
    met = regions.withColumns({"lo": F.min("c").over(over), "hi": F.max("c").over(over), "many": F.max("w").over(over)}).filter("salt > 0 or many > 1 or lo <> hi")
    met = met.join(sets.select("c", *SIGNS), "c").groupBy("cell", "c").agg(F.first("at").alias("at"), *[F.first(g).alias(g) for g in SIGNS])
    # What two sets have in common starts at the first region they share, so in that one each must
    # have as many pivots left as a link needs; all linked pairs meet there, and the rest need not meet.
    left = lambda n, pos, m: (F.col(n) - F.col(pos)) * (100 + percent) >= (F.col(n) + F.col(m)) * percent
    # Each bit in which the parities of two sets' counts over 256 buckets differ is a shingle that one lacks.
    odd = lambda e, f: sum((F.bit_count(F.col(g + e).bitwiseXOR(F.col(g + f))) for g in SIGNS[1:]), F.bit_count(F.col(SIGNS[0] + e).bitwiseXOR(F.col(SIGNS[0] + f))))
    near = lambda n, m, at, to, e, f: left(n, at, m) & left(m, to, n) & (odd(e, f) * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))
    is_link = F.col("common") * 100 >= (F.col("nx") + F.col("ny") - F.col("common")) * percent
    distance = 1 - F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
    both_sides = lambda df, names: [df.select("cell", *[F.col(k).alias(k + e) for k in names]) for e in ("x", "y")]
    # Copies and near copies meet in many regions.  First all members of a region are measured against one pivot,
    # its least set, which is the same one wherever a group meets: a link each joins most groups.
    whole = Window.partitionBy("cell")
    met = met.select("cell", "c", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos"), *SIGNS)
    met = met.withColumns({"k": F.count(F.lit(1)).over(whole), "p": F.min(F.struct("c", "n", "pos", *SIGNS)).over(whole)})
    met = met.withColumns({"p0": F.col("p.c"), **{f"{k}p": F.col(f"p.{k}") for k in ["n", "pos", *SIGNS]}})
    multi = cut(met.select("cell", "c", "n", "pos", *SIGNS, "k", "p0", ((F.col("c") != F.col("p0")) & near("n", "np", "pos", "posp", "", "p")).alias("open")))
    found = _verify(multi.filter("open").select(F.col("p0").alias("x"), F.col("c").alias("y")).distinct(), rows, sets, shingle, percent)
    measured = [found]
    links = found.filter(is_link).select("x", "y")
    roots = _joined(None, links)
    shared.unpersist()  # the regions are in reliable storage
    # Regions of more sets: rounds of pivots, all members of a region against them, where the sizes leave a link
    # open and none is known.  Each region goes on for itself, while its pairs apart are more than WIDE for
    # each member (fewer grow in proportion to it) and a round takes a quarter of them or more; only members count that have as many pivots
    # left as a link to a set of their own size needs.  Half the pivots are members that were linked to most
    # pivots of the round before: the text that many near copies stem from is found that way.
    apart = lambda pivot, d: _either(found, [F.col("x").alias("c"), F.col("y").alias(pivot), distance.alias(d)], [F.col("y").alias("c"), F.col("x").alias(pivot), distance.alias(d)])
    fresh = {"root": F.coalesce("root", "c"), "hits": F.coalesce("hits", F.lit(0).cast("long"))}

    def hits_of(ends: DataFrame) -> DataFrame:
        met = _either(links, [F.col("x").alias("c"), F.col("y").alias("p")], [F.col("y").alias("c"), F.col("x").alias("p")])
        return met.join(ends, "p").groupBy("c").agg(F.count(F.lit(1)).alias("hits")).join(ends.withColumnRenamed("p", "c"), "c", "left_anti")

    # Of the sets of large regions that links have not joined, those of many regions or a very large one are dealt anew.  The order
    # by words lets the text that many near copies stem from come before their edits, so all of them meet; by the sets' own
    # shingles they meet only if both can link.  Sets in few regions, which long texts share by chance, stay in those, of HUGE members at most.
    large = multi.filter(F.col("k") > SMALL).drop("open").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    large = packed(large)
    split = lambda df: df.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("cell")
    far = large.join(split(large), "cell").groupBy("c").agg(*[F.first(k).alias(k) for k in ["n", "root", *SIGNS]], F.count(F.lit(1)).alias("many"), F.max("k").alias("k"))
    far = packed(far.filter((F.col("many") >= MANY) | (F.col("k") > HUGE)).drop("many", "k"))
    nearest = large.select("c", "p0").distinct().join(apart("p0", "d0"), ["c", "p0"]).groupBy("c").agg(F.min(F.struct("d0", "p0")).alias("q")).select("c", "q.d0", "q.p0")
    state = _dealt_anew(far, rows, sets, shingle, percent).join(nearest, "c", "left").join(hits_of(large.select(F.col("p0").alias("p")).distinct()), "c", "left")
    state = packed(state.withColumns(fresh))
    before = None
    for turn in itertools.count(1):
        tall = state.filter(left("n", "pos", "n")).groupBy("cell", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("k2"))
        tall = tall.select("cell", ((F.col("k") * F.col("k") - F.col("k2")) / 2).alias("apart"), "k").filter(F.col("apart") > WIDE * F.col("k")).drop("k")
        if before is not None:
            tall = tall.join(before.withColumnRenamed("apart", "was"), "cell").filter("4 * apart <= 3 * was").drop("was")
        old, before = before, packed(tall)
        drop(old)
        tall = before
        if not tall.n_rows:
            break
        sweep(spark)
        slot = F.pmod(F.xxhash64("c", F.lit(-turn - 1)), F.lit(PIVOTS)).cast("int")
        by = F.struct(F.when(slot % 2 == 1, -F.col("hits")).otherwise(0).alias("m"), F.xxhash64("c", F.lit(turn)).alias("h"), "c", "n", "pos", "root", *SIGNS)
        pivots = state.join(tall.select("cell"), "cell").groupBy("cell", slot.alias("slot")).agg(F.min(by).alias("p")).select("cell", "slot", F.col("p.c").alias(f"p{turn}"), F.col("p.n").alias("np"), F.col("p.pos").alias("pp"), F.col("p.root").alias("rp"), *[F.col(f"p.{g}").alias(f"{g}p") for g in SIGNS])
        pivot = f"p{turn}"
        star = state.join(pivots, "cell").filter((F.col("root") != F.col("rp")) & near("n", "np", "pos", "pp", "", "p"))
        pairs = star.select(F.least("c", pivot).alias("x"), F.greatest("c", pivot).alias("y")).distinct()
        found = _verify(_unmeasured(pairs, measured), rows, sets, shingle, percent)
        measured.append(found)
        links = found.filter(is_link).select("x", "y")
        roots = _joined(roots, links)
        hits = hits_of(pivots.select(F.col(pivot).alias("p")).distinct())
        at, state = state, state.drop("root", "hits").join(pivots.filter("slot = 0").select("cell", pivot), "cell", "left").join(apart(pivot, f"d{turn}"), ["c", pivot], "left").join(roots, "c", "left").join(hits, "c", "left")
        old, state = at, packed(state.withColumns(fresh))
        drop(old)
    sweep(spark)
    # Then the pairs that are apart so far and that the triangle inequality over all pivots leaves open.
    turns = [c[1:] for c in state.columns if c[0] == "d" and c[1:].isdigit() and c != "d0"]
    kept = ["c", "n", "pos", "root", *SIGNS, "p0", "d0", *[f"d{t}" for t in turns]]
    just_before = Window.partitionBy("c").orderBy("pos").rowsBetween(-EARLIER, -1)
    open_ = packed(state.join(split(state), "cell").select("cell", *kept, F.collect_list("cell").over(just_before).alias("early")))
    a, b = both_sides(open_, [*kept, "early"])
    radius = 1 - percent / 100 + 1e-9
    admitted = (F.col("cx") < F.col("cy")) & (F.col("rootx") != F.col("rooty")) & near("nx", "ny", "posx", "posy", "x", "y")
    admitted &= ~F.arrays_overlap("earlyx", "earlyy") & F.coalesce((F.col("p0x") != F.col("p0y")) | (F.abs(F.col("d0x") - F.col("d0y")) <= radius), F.lit(True))
    for t in turns:
        admitted &= F.coalesce(F.abs(F.col(f"d{t}x") - F.col(f"d{t}y")), F.lit(0.0)) <= radius
    pairs = a.join(b, "cell").filter(admitted).select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    # In large regions the pairs of which one at least has not been dealt anew.
    rest = large.drop("root").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")).join(far.select("c", F.lit(True).alias("anew")), "c", "left").withColumn("anew", F.col("anew").isNotNull())
    mixed = rest.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("anew").alias("anew")).filter("r0 <> r1 and not anew").select("cell")
    met_here = ["c", "n", "pos", "root", "anew", *SIGNS]
    rest = packed(rest.join(mixed, "cell").select("cell", *met_here, F.collect_list("cell").over(just_before).alias("early")))
    a, b = both_sides(rest, [*met_here, "early"])
    others = (F.col("cx") < F.col("cy")) & (F.col("rootx") != F.col("rooty")) & ~(F.col("anewx") & F.col("anewy")) & near("nx", "ny", "posx", "posy", "x", "y") & ~F.arrays_overlap("earlyx", "earlyy")
    pairs = pairs.union(a.join(b, "cell").filter(others).select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    # In regions of few sets all pairs that can link and are apart so far.
    a, b = both_sides(multi.filter((F.col("k") > 2) & (F.col("k") <= SMALL)), ["c", "n", "pos", *SIGNS])  # of two sets, one is the pivot
    few = a.join(b, "cell").filter((F.col("cx") < F.col("cy")) & near("nx", "ny", "posx", "posy", "x", "y"))
    few = packed(few.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct())
    of = lambda k: roots.select(F.col("c").alias(k), F.col("root").alias(f"r{k}"))
    left_over = few.join(of("x"), "x", "left").join(of("y"), "y", "left").filter(F.coalesce("rx", "x") != F.coalesce("ry", "y"))
    pairs = pairs.union(left_over.select("x", "y")).distinct()
    last = _verify(_unmeasured(pairs, measured), rows, sets, shingle, percent)
    roots = _joined(roots, last.filter(is_link).select("x", "y"))
    drop(before, state, open_, few, multi, large, far, rest, last, *measured)
    return members, roots, sets.select("c", "first")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """o, tag, n_shingles, component_id and root of all documents.

    A document's set is its distinct windows of `shingle` words, A-Z lower-cased; a shorter
    text is one window.  Two link when 100 times the common are at least `percent` times all.
    component_id is the least doc_id that links reach.  No link is lost and no pair drawn
    twice: copies of a set are one node, and pairs that other links join already are not
    measured.  Sets and shingles are told apart by 64-bit hashes.  A text without words, or
    null, is linked with nothing and is its own component; a null doc_id comes after all
    others and is null as a component if it is alone; rows alike in doc_id are nodes of their
    own by text.  root is the least set that links reach, one value for each linked group also
    where ids are null or repeated; it is null for a text without words.  Other columns are left out.
    """
    members, roots, classes = linked_sets(docs, shingle, percent)
    heads = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = heads.groupBy("root").agg(F.min("first.o").alias("id"))
    of = heads.join(least, "root").select("c", "id", "root")
    out = members.join(of, "c", "left").withColumn("id", F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("o")))
    return out.select("o", "tag", F.col("n").alias("n_shingles"), shown_id(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents."""
    out = near_duplicates(docs)
    return out.select(shown_id(F.col("o")).alias("doc_id"), "n_shingles", "component_id")
