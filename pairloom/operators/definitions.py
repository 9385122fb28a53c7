"""Definitions in prose: lists that open with a formula, sentences, labels in brackets; and how often defined terms are used.

The list scan is a state machine over the lines of a text (a list is open, an item is being
read); windows over the lines carry its state, so a text is read line by line in one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs that open and close a quotation, all quotation signs, and the marks of list items.
OPEN, CLOSE, QUOTES = "„“\"‘«", "”“\"’»", "„”“\"‘’‚«»'"
MARK = r"(?:–|[a-z]{1,3}[.)]|\d{1,3}[.°)]+)"
_INTRO_TERM = r"(?iU)\bverstaan\s+onder\s+([^:\n]{2,80}):\s*$"
_INTRO = r"(?iU)\b(?:wordt|worden)\b[^.:\n]{0,150}?\bverstaan\s+onder\s*:?\s*$"
_STOP = r"(?iU)^\s*(?:(?:artikel|hoofdstuk|afdeling|paragraaf|titel)\s+[\dIVXLC]+[a-z.]*|§.*)\s*$"
_ITEM = rf"(?U)^\s*(?:({MARK})\s+)?([{OPEN}][^{CLOSE}\n]{{1,80}}[{CLOSE}][^:;\n]{{0,40}}?|\p{{L}}[^:;\n]{{1,80}}?)\s*:\s*(\S.*)?$"
_LINES = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The rest of the text, taken only after a line that says nothing or ends in a colon (a list follows).
_TAIL = r"(?:(?<=(?::|indien|als|wanneer|verstaan|begrepen|op)[:,]?[ \t]{0,20})(?=([\s\S]*))|)"
#: Sentences: name, pattern, and the groups of the term, of the rest of the line and of the tail.
SENTENCES = {
    "verstaan_onder": r"(?iU)\bverstaan\s+onder\s+([^:\n]{2,80}?):[ \t]*(\S[^\n]*)",
    "is_sprake": r"(?Um)^Van\s+((?!dergelijke|deze|die|dit)[^,.;:\n]{2,100}?),?\s+is\s+sprake\s+(?:indien|als|wanneer)\b[ \t]*([^\n]*)",
    "hieronder_verstaan": r"(?iU)\bverwezen\s+naar\s+([^,\n]{2,80}),\s+wordt\s+(?:hieronder\s+verstaan|gedoeld\s+op):?[ \t]*([^\n]*)",
}
_ONDER = r"(?iU)(\b(?:wordt|worden)\b[^.\n]{0,35})?\bonder\s+((?:[^.;:\n]|[.:](?=\S)){2,400}?)\s+(?:verstaan|begrepen)\b[:,]?[ \t]*([^\n]*)"
#: Labels in brackets, the clause before them first.
LABELS = {
    "hierna": r"(?iU)([^;:\n]{0,500})\(\s*hierna\s*(?:te\s+noemen|aan\s+te\s+duiden\s+als)?\s*:?\s*([^)]{2,80}?)\s*\)",
    "tussen_haakjes": r"(?U)([^;:\n]{0,500})\(\s*[„“\"]\s*([^”“\"\n)]{2,80}?)\s*[”“\"]\s*\)",
}

#: What a text must hold for a pattern to be tried; the patterns look far ahead from every place, these do not.
GATES = {
    "verstaan_onder": r"(?iU)\bverstaan\s+onder\s",
    "is_sprake": r"(?U)\sis\s+sprake\s",
    "hieronder_verstaan": r"(?iU)\bverwezen\s+naar\s",
    "onder_verstaan": r"(?iU)\s(?:verstaan|begrepen)\b",
    "hierna": r"(?iU)\(\s*hierna",
    "tussen_haakjes": r"(?U)\(\s*[„“\"]",
}


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_term(c: Column) -> Column:
    """A term without quotation signs, extra space and its article."""
    return F.regexp_replace(_spaced(F.translate(c, QUOTES, "")), "^(?:een|de|het) ", "")


def clean_definition(c: Column) -> Column:
    """A definition in one line, without the signs that end an item and quotation signs around it."""
    return F.regexp_replace(F.regexp_replace(_spaced(c), "[;,]+$", ""), f"^[{QUOTES} ]+|[{QUOTES} ]+$", "")


def _texts(units: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Distinct texts of each unit, told apart by a hash of the text."""
    return units.filter(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"), F.xxhash64(text).alias("h")).dropDuplicates([*key, "h"])


def list_definitions(units: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, h (hash of the text), at (place), term and definition as they stand in the lists of each text.

    A list opens with a line that ends in the formula `wordt verstaan onder:`, and ends at a heading or after three blank lines.  The first
    item decides which kind of mark items have (dash, letter, number, none); lines of another
    kind, or without a term of at most ten words before a colon, go on with the item before.  A mark on its own
    line belongs to the next.  After `verstaan onder X:` all that follows is the definition of X.
    """
    lines = _texts(units, key, text).select(*key, "h", F.posexplode(F.split("text", _LINES)).alias("n", "line"))
    opener = F.nullif(F.regexp_extract("line", _INTRO_TERM, 1), F.lit(""))
    unit = [*key, "h"]
    by = Window.partitionBy(*unit).orderBy("n")
    rows = lines.withColumns({"opener": opener, "intro": opener.isNotNull() | F.col("line").rlike(_INTRO)}).withColumn("block", F.sum(F.col("intro").cast("int")).over(by)).filter("block > 0")
    rows = rows.withColumn("single", F.max("opener").over(Window.partitionBy(*unit, "block"))).filter("NOT intro")
    block = Window.partitionBy(*unit, "block").orderBy("n")
    blank = ~F.col("line").rlike(r"(?U)\S")
    rows = rows.withColumn("blank", blank)
    third = F.col("blank") & F.lag("blank", 1, False).over(block) & F.lag("blank", 2, False).over(block)
    over = F.max((third | (~F.col("blank") & F.col("line").rlike(_STOP))).cast("int")).over(block.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("over", over).filter("over = 0 AND NOT blank")
    part = lambda k: F.nullif(F.regexp_extract("line", _ITEM, k), F.lit(""))
    rows = rows.withColumn("alone", F.nullif(F.regexp_extract("line", rf"(?U)^\s*({MARK})\s*$", 1), F.lit("")))
    rows = rows.withColumn("held", F.lag("alone").over(block)).filter("alone IS NULL")
    rows = rows.withColumns({"term": clean_term(part(2)), "rest": part(3), "mark": F.coalesce(part(1), "held")})
    item = F.col("term").isNotNull() & (F.size(F.array_remove(F.split("term", " "), "")) <= 10)
    kind = F.when(F.col("mark").isNull(), "none").when(F.col("mark") == "–", "dash").when(F.col("mark").rlike("^[0-9]"), "num").otherwise("alpha")
    rows = rows.withColumn("kind", F.when(item, kind))
    first = F.when(F.col("single").isNotNull(), "single").otherwise(F.first("kind", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("fresh", F.coalesce(F.col("kind") == first, F.lit(False)))
    rows = rows.withColumn("item", F.sum(F.col("fresh").cast("int")).over(block)).filter("item > 0 OR single IS NOT NULL")
    piece = F.when(F.col("fresh"), F.coalesce("rest", F.lit(""))).otherwise(F.concat(F.when(F.col("held").isNotNull() & (F.col("held") != "–"), F.concat("held", F.lit(" "))).otherwise(""), F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))), lambda x: x["p"]), " ")
    out = rows.groupBy(*unit, "block", "item").agg(F.max(F.when(F.col("fresh"), F.col("term"))).alias("term"), F.max("single").alias("single"), joined.alias("definition"))
    out = out.select(*unit, F.struct(F.lit(0).alias("a"), F.col("block").cast("int").alias("b"), F.col("item").cast("int").alias("c")).alias("at"), F.coalesce("term", clean_term(F.col("single"))).alias("term"), "definition", F.lit("lijst").alias("pattern"))
    return out.filter(F.trim("definition") != "")


def sentence_definitions(units: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, h, at, term, definition and pattern of definitions in sentences and of labels in brackets.

    The definition is the rest of the line, and the rest of the text too if that is empty or ends in a colon.  A label stands for the
    clause before it: up to 500 characters, back to a sign that ends a clause, a sentence or a bracket that is a label itself.
    """
    rows = _texts(units, key, text)
    every = lambda name, pattern, k: F.when(F.col("text").rlike(GATES[name]), F.regexp_extract_all("text", F.lit(pattern), F.lit(k)))
    found = []
    for turn, (name, pattern) in enumerate(SENTENCES.items(), 1):
        tailed = pattern + _TAIL
        zipped = F.arrays_zip(every(name, tailed, 1).alias("term"), every(name, tailed, 2).alias("line"), every(name, tailed, 3).alias("tail"))
        got = rows.select(*key, "h", F.posexplode(zipped).alias("k", "m"))
        line = F.trim("m.line")
        full = F.when((line == "") | line.endswith(":"), F.concat_ws(" ", line, "m.tail")).otherwise(line)
        found.append(got.select(*key, "h", F.struct(F.lit(turn).alias("a"), F.col("k").alias("b"), F.lit(0).alias("c")).alias("at"), clean_term(F.col("m.term")).alias("term"), full.alias("definition"), F.lit(name).alias("pattern")))
    onder = _ONDER + _TAIL
    zipped = F.arrays_zip(every("onder_verstaan", onder, 1).alias("before"), every("onder_verstaan", onder, 2).alias("span"), every("onder_verstaan", onder, 3).alias("line"), every("onder_verstaan", onder, 4).alias("tail"))
    got = rows.select(*key, "h", F.posexplode(zipped).alias("k", "m")).filter((F.col("m.before") != "") | F.col("m.span").rlike(r"(?iU)\b(?:wordt|worden)\b"))
    span, line = F.trim("m.span"), F.trim("m.line")
    quoted = F.regexp_extract(span, f"^[{OPEN}]([^{CLOSE}]*)[{CLOSE}]", 1)
    bare = F.regexp_replace(span, r"(?iU)(?:,|\s+als\s+bedoeld|\s+(?:wordt|worden|kan|tevens|mede|ook|in\s+(?:dit|deze)\s+\w+)\b)[\s\S]*$", "")
    full = F.when((line == "") | line.endswith(":"), F.concat_ws(" ", line, "m.tail")).otherwise(line)
    found.append(got.select(*key, "h", F.struct(F.lit(4).alias("a"), F.col("k").alias("b"), F.lit(0).alias("c")).alias("at"), clean_term(F.when(quoted != "", quoted).otherwise(bare)).alias("term"), full.alias("definition"), F.lit("onder_verstaan").alias("pattern")))
    for turn, (name, pattern) in enumerate(LABELS.items(), 5):
        zipped = F.arrays_zip(every(name, pattern, 1).alias("clause"), every(name, pattern, 2).alias("term"))
        got = rows.select(*key, "h", F.posexplode(zipped).alias("k", "m"))
        clause = F.regexp_replace(F.regexp_replace("m.clause", r"^[\s\S]*[a-z)]\.\s", ""), r"^\s*(?:[a-z]{1,3}|\d{1,3})[.°)]+\s+", "")
        found.append(got.select(*key, "h", F.struct(F.lit(turn).alias("a"), F.col("k").alias("b"), F.lit(0).alias("c")).alias("at"), clean_term(F.col("m.term")).alias("term"), clause.alias("definition"), F.lit(name).alias("pattern")))
    return reduce(DataFrame.unionByName, found)


def definitions(units: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, term, definition and pattern: what each text defines, each term (case aside) once.

    Lists come before sentences and labels; of one term the first stands.  What is left empty by
    cleaning goes.  A null text defines nothing; equal rows count once.
    """
    found = list_definitions(units, key, text).unionByName(sentence_definitions(units, key, text))
    found = found.withColumn("definition", clean_definition(F.col("definition"))).filter("term <> '' AND definition <> ''")
    first = F.row_number().over(Window.partitionBy(*key, "h", F.lower("term")).orderBy("at"))
    return found.withColumn("r", first).filter("r = 1").select(*key, "term", "definition", "pattern")


def bullet_definitions(text: Column) -> Column:
    """array<struct<term, definition>> of a definitions article cut at its bullets, else at blank lines.

    Of each part the term is what stands before its first colon, in lower case without quotation signs, at most 100 characters in one line; the definition the first 400
    characters after it, in lower case with single spaces.  Of equal terms the last counts.
    """
    lower = lambda c: F.lower(_spaced(c))

    def shaped(parts: Column) -> Column:
        def one(part: Column) -> Column:
            head = F.substring_index(part, ":", 1)
            term = F.regexp_replace(F.regexp_replace(head, r"(?U)^\s+|\s+$", ""), r"(?U)^[„“”‘’'\"]+|[„“”‘’'\"]+$", "")
            return F.struct(F.regexp_replace(term, r"(?U)^\s+|\s+$", "").alias("term"), F.substring(lower(F.substring(part, F.length(head) + 2, F.length(part))), 1, 400).alias("definition"))

        fits = F.filter(F.transform(F.filter(parts, lambda p: p.contains(":")), one), lambda d: (d["term"] != "") & (F.length(d["term"]) <= 100) & ~d["term"].contains("\n"))
        low = F.transform(fits, lambda d: F.struct(F.lower(d["term"]).alias("term"), d["definition"].alias("definition")))
        return F.filter(low, lambda d, i: ~F.exists(F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))), lambda e: e["term"] == d["term"]))

    parts = F.split(text, r"(?:\A|\n)(?U)\s*(?:\d+\)|[a-z]\)|–|-)\s*")
    marked = shaped(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))
    return F.when(F.size(marked) > 0, marked).otherwise(shaped(F.split(text, "\n\n")))


def term_uses(terms: DataFrame, articles: DataFrame, *, group: str = "instrument", article: str = "article", text: str = "text") -> DataFrame:
    """group, term, defined_in, uses and used_in: how often each term stands in the other articles of its group, and in how many.

    terms: group, term, article (where it is defined; of several the least).  A term stands where its words and the signs
    between them do, case aside, its last word with up to two letters more.  Runs of words of
    the articles meet the terms by equal keys, so no text is held against every term; terms that contain one another
    count each for itself, as do places that overlap.  Terms without letters or digits have no uses.
    """
    wanted = terms.filter(F.col("term").isNotNull()).groupBy(group, F.lower("term").alias("low")).agg(F.min(article).alias("defined_in"), F.min("term").alias("term"))
    pattern = r"(?U)([^\w]*)(\w+)"
    cut = lambda c, k: F.regexp_extract_all(c, F.lit(pattern), F.lit(k))
    size = F.size(cut(F.col("low"), 2))
    sizes = sorted(r[0] for r in wanted.select(size.alias("n")).distinct().collect() if r[0] > 0)  # numbers of words that terms have
    if not sizes:
        return wanted.select(group, "term", "defined_in", F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("used_in"))
    rows = articles.filter(F.col(text).isNotNull()).select(group, article, cut(F.lower(text), 1).alias("gaps"), cut(F.lower(text), 2).alias("words")).filter("size(words) > 0")
    both = F.zip_with("gaps", "words", lambda g, w: F.concat(g, w))
    joined = lambda i, n: F.concat(F.get("words", i), F.array_join(F.slice("both", i + 2, n - 1), "")) if n > 1 else F.get("words", i)
    starts = lambda n: F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
    one = lambda n: lambda i: F.struct(F.lit(n).alias("n"), joined(i, n).alias("run"), F.length(F.get("words", i + n - 1)).alias("last"))
    runs = F.flatten(F.array(*[F.transform(starts(n), one(n)) for n in sizes]))
    met = rows.withColumn("both", both).select(group, article, F.explode(runs).alias("r")).select(group, article, "r.*")
    less = F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: k < F.col("last")))
    keys = met.select(group, article, "n", "run", less.alias("k")).select(group, article, "n", F.substring("run", F.lit(1), F.length("run") - F.col("k")).alias("low"))
    counted = keys.groupBy(group, article, "n", "low").agg(F.count(F.lit(1)).alias("c"))  # before the join, so that frequent runs are one row
    hits = counted.join(wanted.withColumn("n", size), [group, "n", "low"]).filter(~F.col(article).eqNullSafe(F.col("defined_in")))
    sums = hits.groupBy(group, "low").agg(F.sum("c").alias("uses"), F.countDistinct(article).alias("used_in"))
    return wanted.join(sums, [group, "low"], "left").select(group, "term", "defined_in", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_in", F.lit(0)).alias("used_in"))
