"""Quality rules: divergence of a text's histograms from those of its language."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import WS, cut, words_of

#: Function words of each language, in natural order.
COMMON_WORDS = {
    "de": ["als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "aux", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "ou", "par", "pour", "qui", "que", "sur", "un", "une"],
}
#: Character classes, taken off a text one after the other; what is left is "other".
CLASSES = [("lower", r"[a-z]+"), ("space", WS), ("upper", r"[A-Z]+"), ("digit", r"[0-9]+"), ("stop", r"[.,;:!?'\"()-]+"), ("symbol", r"[#*$%&|<>]+"), ("letter", r"[\p{L}\p{M}]+")]
#: Farthest Jensen-Shannon distances that are kept, and the lengths below which one is not asked.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS = 0.26, 0.25, 300, 50


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, plus counts of its words, lines and characters.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_counts (CLASSES,
    then other) and, for each language, the counts of its common words as a map.  All of it
    is found within the row, by built-in functions alone: no shuffle.  Words in windows are
    told apart by xxhash64 of the three words.  A null text counts as empty.
    """
    keep = [c for c in docs.columns if c != text]
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_pl_0")).withColumn("_pl_words", words_of(F.col("_pl_0")))
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_pl_{i + 1}", F.regexp_replace(f"_pl_{i}", pattern, ""))
    left = [F.length(f"_pl_{i}") for i in range(len(CLASSES) + 1)]
    counts = [(left[i] - left[i + 1]).cast("long") for i in range(len(CLASSES))] + [left[-1].cast("long")]
    lines = F.filter(F.split("_pl_0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_pl_words")
    grams = F.when(n >= 3, F.transform(F.slice("_pl_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_pl_words", i + 1), F.get("_pl_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    df = df.withColumn("_pl_grams", grams).withColumn("_pl_lines", lines)
    # The common words in one string, a space on either side of each, so that each is counted by taking it out.
    df = df.withColumn("_pl_joined", F.concat(F.lit(" "), F.array_join(F.filter("_pl_words", lambda w: w.isin(listed)), "  "), F.lit(" ")))
    df = df.select(
        *keep,
        F.col("_pl_grams"),
        n.cast("long").alias("n_words"),
        (left[0] - (left[1] - left[2])).cast("long").alias("word_chars"),
        counts[5].alias("n_symbols"),
        (F.size("_pl_lines") - F.size(F.array_distinct("_pl_lines"))).cast("long").alias("n_dup_lines"),
        F.array(*counts).alias("class_counts"),
        F.array(*[F.floor((F.octet_length("_pl_joined") - F.octet_length(F.replace("_pl_joined", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in listed]).alias("common_counts"),
        (F.size(F.array_distinct("_pl_grams")) < F.size("_pl_grams")).alias("_pl_again"),
    )
    pairs = F.when(F.col("_pl_again"), F.array_sort(F.transform("_pl_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_pl_pairs", pairs)
    same = lambda p, j: (p["h"] == F.get(F.col("_pl_pairs"), j - 1)["h"]) | (p["h"] == F.get(F.col("_pl_pairs"), j + 1)["h"])
    hit = F.transform(F.filter("_pl_pairs", lambda p, j: F.coalesce(same(p, j), F.lit(False))), lambda p: p["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumn("n_repeat_words", F.when(F.col("_pl_again"), covered).otherwise(0).cast("long")).drop("_pl_grams", "_pl_pairs", "_pl_again")


def _listed() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of counts to the shares q; null if all counts are 0."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    part = lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2)
    shares = F.transform(p, lambda x: F.try_divide(x, total))
    both = F.zip_with(shares, F.lit([float(x) for x in q]), part)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def word_counts(lang: str) -> Column:
    """Counts of the common words of a language, then of all other words."""
    index = {w: i for i, w in enumerate(_listed())}
    own = F.transform(F.lit([index[w] for w in COMMON_WORDS[lang]]), lambda i: F.get("common_counts", i))
    return F.concat(own, F.array(F.col("n_words") - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)))


def divergence(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """docs without text, plus base counts, base_failed, lang_ref, char_distance, word_distance and kept.

    The references are the summed histograms of all rows of a language that pass the base
    rules, one row for each of the listed languages.  A row is held against its own language,
    or, where that is null or unlisted, against the nearest.  Texts under MIN_CHARS
    characters are not held against characters, those under MIN_WORDS words not against
    words, and the squared word distance is lessened by what chance alone gives at its length; where no row gives a reference, all that pass the base rules are kept.  Other
    columns pass through, but those named like the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "common_counts", "base_failed", "lang_ref", "char_distance", "word_distance", "kept"]
    if lang not in docs.columns:
        docs = docs.withColumn(lang, F.lit(None).cast("string"))
    df = base_counts(docs.drop(*added))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = cut(df.withColumn("base_failed", failed))
    sums = df.filter(~F.col("base_failed") & F.col(lang).isin(list(COMMON_WORDS))).groupBy(F.col(lang).alias("l"))
    width, listed = len(CLASSES) + 1, _listed()
    refs = sums.agg(F.sum("n_words").alias("n"), *[F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(width)], *[F.sum(F.get("common_counts", F.lit(i))).alias(f"w{i}") for i in range(len(listed))]).collect()
    best = F.lit(None).cast("struct<d:double,l:string,c:double,w:double>")
    found = []
    for r in sorted(refs, key=lambda r: r["l"]):
        index = {w: i for i, w in enumerate(listed)}
        c = [r[f"c{i}"] for i in range(width)]
        w = [r[f"w{index[x]}"] for x in COMMON_WORDS[r["l"]]]
        w.append(r["n"] - sum(w))
        dc, dw = f"_pl_c_{r['l']}", f"_pl_w_{r['l']}"
        df = df.withColumns({dc: js_distance(F.col("class_counts"), [x / sum(c) for x in c]), dw: js_distance(word_counts(r["l"]), [x / sum(w) for x in w])})
        found.append((r["l"], F.struct((F.col(dc) + F.col(dw)).alias("d"), F.lit(r["l"]).alias("l"), F.col(dc).alias("c"), F.col(dw).alias("w"))))
    if found:
        own = F.coalesce(*[F.when(F.col(lang) == name, s) for name, s in found])
        best = F.coalesce(own, F.array_min(F.array(*[s for _, s in found])))
    df = df.withColumn("_pl_best", best)
    n_chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    # A text of n words drawn from its reference lies about sqrt(bins / (8 n ln 2)) from it.
    chance = (len(COMMON_WORDS["en"]) / (8 * math.log(2))) / F.col("n_words")
    word_far = F.when(F.col("n_words") >= MIN_WORDS, F.col("_pl_best.w") * F.col("_pl_best.w") - chance > MAX_WORD_DISTANCE**2)
    far = ((n_chars >= MIN_CHARS) & (F.col("_pl_best.c") > MAX_CHAR_DISTANCE)) | F.coalesce(word_far, F.lit(False))
    return df.select("*", F.col("_pl_best.l").alias("lang_ref"), F.col("_pl_best.c").alias("char_distance"), F.col("_pl_best.w").alias("word_distance"), (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept")).drop("_pl_best", *[f"_pl_{k}_{name}" for name, _ in found for k in "cw"])


def judge_documents(docs: DataFrame) -> DataFrame:
    """The base counts and the verdict for all documents."""
    out = divergence(docs.select("doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang_ref", F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"))
