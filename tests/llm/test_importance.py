"""Importance resampling against a version that makes every n-gram a string."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import importance

SCHEMA = "doc_id long, text string, score long, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams=2):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets, grams, min_words, percent, seed):
    where = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(where(f) for text in some for f in features(text, grams)[1]) for some in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in docs:
        words, fs = features(text, grams)
        weight = sum(gain[where(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    words = ["the", "Of", "straße", "x1", "日本", "naïve", "W" * 60, "ÄÖ", "z" * 49, "q" * 48]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", " \n", "a", "a-b_c", "x" * 40_000, "é" * 300 + " end", "tab\tnul\x00dash—dash", "one two", texts[0]] + [texts[1]] * 30
    return [(i if i % 17 else None, t, 1, "clash") for i, t in enumerate(texts)] + [(3, texts[3], 1, "clash")] * 2


@pytest.mark.parametrize("how", [{}, {"buckets": 37, "grams": 3, "min_words": 1, "percent": 60, "seed": 11}, {"buckets": 64, "grams": 1, "min_words": 0, "percent": 100}])
def test_equals_plain_strings(spark, docs, how, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 2000)
    target = ["the straße of x1", "日本 the the", None, "unseen words here"]
    whole = {"buckets": 10_000, "grams": 2, "min_words": 20, "percent": 25, "seed": 7} | how
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), **whole).collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, target, **whole)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample_documents(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    (r,) = importance.resample_documents(one, none).collect()
    assert r.n_features == 3 and r["rank"] is None


def test_crc_algebra():
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 48, 49, 300, 70_000]))) for _ in range(40)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    crc = importance.word_crcs(data, ends - [len(p) for p in parts], ends)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    size = np.array([len(p) for p in parts[1:]])
    assert (importance.shift(crc[:-1], size) ^ crc[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:], strict=False)]
