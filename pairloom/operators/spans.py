"""Labels in texts: many phrases met at once in a trie of words, and spans chosen so that none overlap.

A token is a run of letters, digits and underscores, or one other sign; white space only
separates.  A phrase stands where its words stand one after another, white space between them
and no letter or digit of another word at its ends, in any case.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a lexicon that a worker holds; a larger one is met in several passes over the texts.
MOST = 200_000
_TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20\xA0]")
_SPACE = regex.compile(r"[\x09-\x0D\x20\xA0]+")
_LONG_VOWEL = regex.compile(r"(.*)([aeiou])\2([^aeiou\W\d])", regex.I)
#: Endings of verb forms, those of action nouns besides, and endings of terms.
VERB_ENDS = ("", "en", "t", "e", "d", "de", "te")
NOUN_ENDS = (*VERB_ENDS, "ing", "ingen")
TERM_ENDS = ("", "en", "s", "n", "'s", "’s")
#: Signs that end the reach of a verb whose particle stands apart.
STOPS = frozenset(";:.!?")
HIT = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("matched", T.StringType()), T.StructField("source", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.IntegerType())))])
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string()), ("source", pa.string()), ("parts", pa.list_(pa.list_(pa.int32())))]))


def forms(word: str, kind: str) -> list[str]:
    """The spellings under which a word of a phrase is met: its own (`plain`, `phrase`), inflected (`term`), or a stem's (`verb`, `noun`)."""
    if kind == "term":
        long = _LONG_VOWEL.fullmatch(word)
        return [word + e for e in TERM_ENDS] + ([long[1] + long[2] + long[3] + "en"] if long else [])
    if kind in ("verb", "noun"):
        return [a + word + e for a, e in product(("", "ge"), VERB_ENDS if kind == "verb" else NOUN_ENDS)]
    return [word]


class Text:
    """The tokens of a text: lower case, first and last character, and whether space stands before."""

    def __init__(self, text: str):
        found = [m.span() for m in _TOKEN.finditer(text)]
        self.text, self.start, self.end = text, [a for a, _ in found], [b for _, b in found]
        self.token = [text[a:b].lower() for a, b in found]
        self.spaced = [i == 0 or self.start[i] > self.end[i - 1] for i in range(len(found))]


class _Node:
    __slots__ = ("edges", "words", "labels")

    def __init__(self):
        self.edges, self.words, self.labels = {}, {}, []


class Lexicon:
    """A trie of words: a node for each run of words that phrases begin with, all spellings of a word lead to one node."""

    def __init__(self, rows: Iterable[tuple[str, str, str, str | None]], apart: Iterable[tuple] = ()):
        self._root = _Node()
        for label, phrase, kind, scope in rows:
            words = [w for w in _SPACE.split(phrase) if w]
            if words:
                ways = [words]
                if kind == "phrase" and len(words) > 1:
                    ways.append([*words[:-1], "te", words[-1]])
                for way in ways:
                    self._add(way, kind, (label, scope))
        self._apart = [(label, frozenset(x.lower() for x in finite or ()), Text(particle).token, [*Text(particle).token, "te", infinitive.lower()], anchored, frozenset(x.lower() for x in not_before or ())) for label, finite, particle, infinitive, anchored, not_before in apart]

    def _add(self, words: list[str], kind: str, entry: tuple) -> None:
        node = self._root
        for word in words:
            child = node.words.get((word, kind))
            if child is None:
                child = node.words[word, kind] = _Node()
                for form in dict.fromkeys(forms(word.lower(), kind)):
                    first, *rest = Text(form).token
                    node.edges.setdefault(first, []).append((rest, child))
            node = child
        if entry not in node.labels:
            node.labels.append(entry)

    def hits(self, text: Text, scope: str | None = None) -> list[tuple[int, int, str]]:
        """(first token, token after the last, label) of every phrase at every place."""
        out, token, spaced = set(), text.token, text.spaced
        for i, t in enumerate(token):
            if t not in self._root.edges:
                continue
            stack = [(self._root, i)]
            while stack:
                node, at = stack.pop()
                for own, only in node.labels:
                    if only is None or only == scope:
                        out.add((i, at, own))
                if at == len(token) or (at > i and not spaced[at]):
                    continue
                for rest, child in node.edges.get(token[at], ()):
                    end = at + 1 + len(rest)
                    if not rest or (token[at + 1 : end] == rest and not any(spaced[at + 1 : end])):
                        stack.append((child, end))
        return sorted(out)

    def apart(self, text: Text, prepositions: frozenset[str]) -> list[tuple[int, int, str, str, list[tuple[int, int]]]]:
        """Verbs with their particles: (first token, end, label, source, parts), one for each place and label.

        `separable_te`: particle, te and infinitive in a row.  `separable`: a finite form and the
        next particle before a strong sign; where the entry is anchored, only at the end of
        that reach or before a preposition; none where words of `not_before` follow.
        """
        token, n = text.token, len(text.token)
        stop, next_stop = [n] * (n + 1), n
        for i in range(n - 1, -1, -1):
            next_stop = i if token[i] in STOPS else next_stop
            stop[i] = next_stop
        where: dict[str, list[int]] = {}
        for i, t in enumerate(token):
            where.setdefault(t, []).append(i)
        stands = lambda i, words: token[i : i + len(words)] == words and all(text.spaced[i + 1 : i + len(words)])
        out: dict[tuple, tuple] = {}
        for label, finite, particle, te, anchored, not_before in self._apart:
            at = [i for i in where.get(particle[0], ()) if stands(i, particle)]
            for i in at:
                if stands(i, te):
                    out.setdefault((i, i + len(te), label), (i, i + len(te), label, "separable_te", [(i, i + len(te))]))
            for verb in sorted(i for f in finite for i in where.get(f, ())):
                reach = stop[verb + 1] if verb + 1 <= n else n
                for p in at[bisect_left(at, verb + 1) :]:
                    end = p + len(particle)
                    if end > reach:
                        break
                    if anchored and end < reach and not (token[end] in prepositions and text.spaced[end]):
                        continue
                    after = end + (end < n and token[end] == ",")
                    if not (after < n and token[after] in not_before):
                        out.setdefault((verb, verb + 1, label), (verb, end, label, "separable", [(verb, verb + 1), (p, end)]))
                    break
        return list(out.values())


def choose(hits: Iterable[tuple[int, int, str]], width, *, once: bool = False, alike: bool = False) -> list[tuple[int, int, str]]:
    """Of (first, end, label) those that stay: the widest first, then the leftmost, then by label, none over one already taken.

    once: each label is taken once at most.  alike: other labels of the very same span stay too.
    """
    taken: dict[int, tuple[int, int]] = {}
    labels, out = set(), []
    for first, end, label in sorted(set(hits), key=lambda h: (-width(h[0], h[1]), h[0], h[2])):
        if once and label in labels:
            continue
        over = [taken[i] for i in range(first, end) if i in taken]
        if over and not (alike and all(x == (first, end) for x in over)):
            continue
        taken.update(dict.fromkeys(range(first, end), (first, end)))
        labels.add(label)
        out.append((first, end, label))
    return sorted(out)


def spans_of(t: Text, hits: list[tuple], apart: list[tuple], skip: str | None, once: bool, alike: bool, by: str) -> list[dict]:
    """The chosen spans of one text in order, as rows of HIT."""
    held = {i for _, _, _, _, parts in apart for a, b in parts for i in range(a, b)}
    width = (lambda a, b: t.end[b - 1] - t.start[a]) if by == "characters" else (lambda a, b: b - a)
    free = [(a, b, label) for a, b, label in hits if label != skip and held.isdisjoint(range(a, b))]
    out = [(a, b, label, "lexicon", [(a, b)]) for a, b, label in choose(free, width, once=once, alike=alike)] + apart
    rows = []
    for a, b, label, source, parts in sorted(out, key=lambda h: (t.start[h[0]], t.end[h[1] - 1], h[2], h[3])):
        spots = [[t.start[p], t.end[q - 1]] for p, q in parts]
        rows.append({"label": label, "start": t.start[a], "end": t.end[b - 1], "matched": " … ".join(t.text[p:q] for p, q in spots), "source": source, "parts": spots})
    return rows


def label_spans(texts: DataFrame, lexicon: DataFrame, *, text: str = "text", scope: str | None = None, skip: str | None = None, once: bool = False, alike: bool = False, by: str = "characters", apart: DataFrame | None = None, prepositions: Iterable[str] = ()) -> DataFrame:
    """texts plus spans array<struct<label, start, end, matched, source, parts>>: the phrases of a lexicon that stand in each whole text.

    lexicon: label, phrase, and if there, kind (`plain`, `term`, `verb`, `noun`, `phrase`; see
    `forms`; a `phrase` may have `te` before its last word) and scope (null: everywhere; else only in
    texts whose column `scope` equals it).  skip names a column with the one label that a text
    leaves out.  apart: verbs with particles (label, finite array<string>, particle, infinitive,
    anchored, not_before array<string>); they go before phrases that share a word with them.

    Of spans that overlap the longest stays, in characters or in words, then the leftmost, then the lesser
    label; `once` and `alike` as in `choose`.  start and end count characters from 0.  Null and
    empty texts have no spans; rows of the lexicon with a null label or phrase count for nothing, repeated ones once.
    Every text is met in its own task with the lexicon in memory and nothing is shuffled.  A lexicon
    of over MOST rows is met in parts, a pass over the texts for each; the choice is made after the last.
    """
    def ready(df: DataFrame, columns: dict[str, object]) -> DataFrame:
        given = [F.coalesce(F.col(c), F.lit(d)) if c in df.columns and d is not None else F.col(c) if c in df.columns else F.lit(d) for c, d in columns.items()]
        return df.select(*[x.alias(c) for c, x in zip(columns, given, strict=True)])

    lexicon = ready(lexicon.filter("label IS NOT NULL AND phrase IS NOT NULL"), {"label": None, "phrase": None, "kind": "plain", "scope": None})
    lexicon = lexicon.withColumns({"label": F.col("label").cast("string"), "scope": F.col("scope").cast("string")}).distinct()
    verbs = None if apart is None else ready(apart.filter("label IS NOT NULL AND particle IS NOT NULL AND infinitive IS NOT NULL"), {"label": None, "finite": None, "particle": None, "infinitive": None, "anchored": False, "not_before": None})
    blocks = max(1, *(-(-df.count() // MOST) for df in (lexicon, verbs) if df is not None))
    signs = frozenset(prepositions)
    names = [text, *([scope] if scope else []), *([skip] if skip else [])]
    texts = texts.drop("spans")
    kept = texts.columns
    at = [kept.index(c) for c in names]

    def one(part, first: bool, last: bool):  # noqa: ANN001
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(*part.value)
            for b in rows:
                found = []
                before = [None] * b.num_rows if first else b.column(len(kept)).to_pylist()
                own = b.column(at[1]).cast(pa.string()).to_pylist() if scope else [None] * b.num_rows
                less = b.column(at[-1]).cast(pa.string()).to_pylist() if skip else [None] * b.num_rows
                for whole, only, out, old in zip(b.column(at[0]).to_pylist(), own, less, before, strict=True):
                    t = Text(whole or "")
                    hits, far = pickle.loads(old) if old else ([], [])
                    hits, far = hits + lexicon.hits(t, only), far + lexicon.apart(t, signs)
                    found.append(spans_of(t, hits, far, out, once, alike, by) if last else (hits, far))
                made = pa.array(found, _ARROW) if last else pa.array([pickle.dumps(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], made], names=[*kept, "spans"])

        return run

    out = texts
    for k in range(blocks):
        some = [df if df is None or blocks == 1 else df.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k) for df in (lexicon, verbs)]
        part = texts.sparkSession.sparkContext.broadcast(tuple([] if df is None else [tuple(r) for r in df.collect()] for df in some))  # about MOST rows
        last = k == blocks - 1
        kind = T.ArrayType(HIT) if last else T.BinaryType()
        out = out.mapInArrow(one(part, k == 0, last), T.StructType([*texts.schema.fields, T.StructField("spans", kind)]))
    return out
