"""Byte-level BPE against the library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairloom.llm import bytebpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "x" * 30_000, " " * 5000, "\n\n \t a", "don't we'll 'S 's's", "é日本 🎉🎉 ok", "<|endoftext|>", "aaaa" * 77 + "ab" * 300, "\x1c a\x00", "ſ ŉ ĳ İ", "é ‍ ﻿"]
    letters = [*map(chr, range(32, 400)), *"etaoin etaoin  \n'é日🎉" * 9]
    out += ["".join(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(800)]
    return out + ["".join(rng.choices("abcdetsin", k=k)) for k in (33, 200, 1023, 1024, 1025, 5000)]


@pytest.mark.parametrize(("cells", "long", "pieces", "cache"), [(1 << 18, 1024, 1 << 18, 150_000), (40, 1 << 20, 7, 3), (1 << 18, 3, 50, 10)])
def test_ids_are_those_of_the_library(library, monkeypatch, cells, long, pieces, cache):
    for name, value in {"CELLS": cells, "LONG": long, "PIECES": pieces, "CACHE_PIECES": cache}.items():
        monkeypatch.setattr(bytebpe, name, value)
    tok, some = bytebpe.ByteTokenizer(FILE, public_tokenizers.PATTERN), texts()
    got = [b""] * len(some)
    for i, ids in tok.encode(some):
        got[i] += ids
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in some]
    assert [tok.decode(x) for x in got] == [t.encode() for t in some]


def test_digests_of_documents(spark, library):
    rows = [(i, t, "clash", 0) for i, t in enumerate([*texts(), None])] + [(None, "null id", "", 1), (0, "", "", 1)]
    got = bytebpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bytebpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_of_ids_and_bytes(spark, library):
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts()[:60])] + [(None, None, None, None)]
    ids = bytebpe.encode(spark.createDataFrame(rows, SCHEMA), FILE, public_tokenizers.PATTERN)
    back = bytebpe.decode(ids, FILE, public_tokenizers.PATTERN).collect()
    assert ids.columns == ["doc_id", "text", "n_tokens", "ids"] and len(back) == len(rows)
    for r in back:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
