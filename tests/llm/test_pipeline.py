import re
from collections import Counter

import corpus_pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = docs.count()
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= before, name


def brute_heads(rows, shingle=5, percent=80):
    """The (doc_id, text) that stay: the least row of each linked group, and all rows without words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = {}
    for k, s in enumerate(sets):
        groups.setdefault(find(k) if s else ("wordless", k), []).append(rows[k])
    least = lambda r: (r[0] is None, r[0] or 0)
    return groups.values(), [min(g, key=least) for g in groups.values()]


def test_null_and_repeated_ids_keep_one_of_each_group(spark):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = text(3) + " more"
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(3)), (None, near), (None, text(0))]
    rows += [(7, text(4)), (7, text(5)), (7, text(4)), (8, text(5) + " tail"), (9, text(1)), (None, None), (None, ""), (None, ""), (7, ""), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    groups, heads = brute_heads(rows)
    assert sum(got.values()) == len(heads)
    assert all(sum(got[r] for r in set(g)) == 1 for g in groups if (g[0][1] or "").strip())
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in heads)
    assert all(got[r] == rows.count(r) for r in rows if not (r[1] or "").strip())


def test_one_changed_word_in_fifty_is_a_near_copy(spark):
    words = [f"w{i}" for i in range(50)]
    other = [*words[:25], "changed", *words[26:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()] == [1]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_texts(rows, window=20):
    """What is left of each text without the words of windows that stand earlier."""
    first, out = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] != (i, k) for j in range(k, k + window)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_the_last_three_stages(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(10 + 7 * i)) + (f" {passage} end{i}" if i % 3 == 0 else ""), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(24)] + [(30, None, None, "s1", 0), (31, "", "en", "s1", 0), (32, passage, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_repeats(spark, docs, "")
    want = kept_texts([r[:2] for r in rows])
    got = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and set(got) == set(want)
    for i, r in got.items():
        assert " ".join(WORD.findall(r.text or "")) == want[i] and r.n_chars == len(r.text or "")

    mixed = corpus_pipeline.mix_sources(spark, left, "")
    assert mixed.columns == docs.columns
    taken, full = Counter(), {i: Counter(WORD.findall(t)) for i, t in want.items()}
    for r in mixed.collect():
        words = WORD.findall(r.text or "")
        taken[r.source] += len(words)
        rest = iter(WORD.findall(want[r.doc_id]))
        assert all(w in rest for w in words) and not Counter(words) - full[r.doc_id]  # some of the document's words, in their order
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += sum(full[r[0]].values())
    assert sum(taken.values()) <= 1.6 * sum(sizes.values()) and all(taken[s] <= 2 * n + max(sizes.values()) * 0.05 + 1 for s, n in sizes.items())
    assert sum(taken.values()) >= 1.3 * sum(sizes.values())

    pieces = corpus_pipeline.pack_sequences(spark, mixed, "").toPandas()
    assert len(pieces[pieces.start == 0]) == mixed.count()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, o long, tag string, root long, score double")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, none, "")
        assert out.columns == none.columns and out.count() == 0, name
    one = spark.createDataFrame([(1, "a b c", "en", "s", 5, 9, "t", 7, 0.5)], none.schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert [tuple(r) for r in stage(spark, one, "").collect()] == [(1, "a b c", "en", "s", 5, 9, "t", 7, 0.5)], name
