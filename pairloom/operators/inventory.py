"""An inventory of actors: defined terms that name one, key entries with aliases and a scope, and what a name means in a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases as P

#: The documents of the two general scopes, by their ids.
SCOPES = {"eu": r"(?i)^3\d{4}[A-Z]{1,2}\d{4}", "nl": r"(?i)^BWBR\d+"}


def head_classes(words: DataFrame, heads: DataFrame) -> DataFrame:
    """word and class of each distinct word that names an actor.

    heads: ending and class; the class `-` marks whole words that name none.  A word's plain form and
    its forms without -s, -en and -n (if three letters or more are left) are tried in this order, the longest ending first.
    """
    plain = heads.select(P.plain(F.col("ending")).alias("ending"), "class").filter("ending <> ''")
    never = plain.filter("class = '-'").select(F.col("ending").alias("w")).distinct()
    ends = plain.filter("class <> '-'").groupBy("ending").agg(F.max("class").alias("class"))
    ready = words.select("word").filter("word IS NOT NULL").distinct().withColumn("w", F.regexp_replace(P.plain(F.col("word")), "['’]", "")).filter("w <> ''")
    ready = ready.join(never, "w", "left_anti")
    less = lambda e: F.when(F.col("w").endswith(e) & (F.length("w") > len(e) + 2), F.substring(F.col("w"), F.lit(1), F.length("w") - len(e)))
    forms = ready.select("word", F.posexplode(F.array(F.col("w"), less("s"), less("en"), less("n"))).alias("turn", "form")).filter("form IS NOT NULL")
    tails = forms.select("word", "turn", F.explode(F.transform(F.sequence(F.lit(1), F.length("form")), lambda k: F.substring(F.col("form"), k, F.length("form")))).alias("ending"))
    best = F.min_by("class", F.struct("turn", -F.length("ending")))
    return tails.join(ends, "ending").groupBy("word").agg(best.alias("class"))


def term_rows(definitions: DataFrame, heads: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """definitions plus term (single spaces), head, class and actor: whether the term names an actor.

    definitions: document, position, term, article, paragraph, definition.  A term does if its head has a class or
    (document, term) is in include, and is not in exclude.  class is that of the head, else of the first word.  Null terms go.
    """
    rows = definitions.filter("document IS NOT NULL AND term IS NOT NULL").withColumn("term", F.trim(F.regexp_replace("term", r"\s+", " ")))
    rows = rows.withColumns({"head": P.term_head(F.col("term")), "first": F.substring_index("term", " ", 1), "plain": P.plain(F.col("term"))})
    classes = head_classes(rows.select(F.explode(F.array("head", "first")).alias("word")), heads)
    rows = rows.join(classes.select(F.col("word").alias("head"), F.col("class").alias("own")), "head", "left").join(classes.select(F.col("word").alias("first"), F.col("class").alias("other")), "first", "left")
    for name, given in (("in", include), ("out", exclude)):
        if given is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            listed = given.select("document", P.plain(F.col("term")).alias("plain"), F.lit(True).alias(name)).distinct()
            rows = rows.join(listed, ["document", "plain"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    actor = (F.col("own").isNotNull() | F.col("in")) & ~F.col("out")
    return rows.select(*definitions.columns, "plain", "head", F.coalesce("own", "other").alias("class"), actor.alias("actor"))


def actor_inventory(definitions: DataFrame, heads: DataFrame, curated: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """id, label, aliases, kind, documents, scope, excluded, class, part_of, source, definition: defined terms and key entries.

    Of terms of a document with one plain form the first by position stands (then by the term itself), for its document alone.
    curated: position, label, aliases, scope (`eu`, `nl` or documents), class, part_of (a label).  A key entry is excluded from
    the documents that define its label or one of its aliases; part_of becomes the id of the key entry with that
    label, the last by position if several have it, null if none.  Key entries of one id stay as they are.
    """
    terms = term_rows(definitions, heads, include, exclude).filter("actor")
    first = F.row_number().over(Window.partitionBy("document", "plain").orderBy("position", "term"))
    terms = terms.withColumn("turn", first).filter("turn = 1")
    none = lambda kind: F.lit(None).cast(kind)
    where = F.concat(F.col("document"), F.lit(" art. "), F.coalesce(F.col("article").cast("string"), F.lit("None")), F.when(F.coalesce(F.col("paragraph").cast("string"), F.lit("")) != "", F.concat(F.lit("("), F.col("paragraph").cast("string"), F.lit(")"))).otherwise(""))
    defined = terms.select(F.concat_ws(":", "document", P.slug(F.col("term"))).alias("id"), F.col("term").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit("defined").alias("kind"), F.array("document").alias("documents"), none("array<string>").alias("scope"), none("array<string>").alias("excluded"), "class", none("string").alias("part_of"), where.alias("source"), "definition")

    keys = curated.filter("label IS NOT NULL AND size(scope) > 0").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    tag = F.when(F.get("scope", F.lit(0)).isin(*SCOPES), F.upper(F.get("scope", F.lit(0)))).otherwise(F.get("scope", F.lit(0)))
    keys = keys.withColumns({"id": F.concat(F.lit("KEY:"), tag, F.lit(":"), P.slug(F.col("label"))), "row": F.monotonically_increasing_id()})
    names = keys.select("row", F.explode(F.transform(F.concat(F.array("label"), "aliases"), P.plain)).alias("plain")).distinct()
    gone = names.join(terms.select("document", "plain").distinct(), "plain").groupBy("row").agg(F.array_sort(F.collect_set("document")).alias("excluded"))
    target = keys.groupBy(P.plain(F.col("label")).alias("whole")).agg(F.max_by("id", F.struct("position", "id")).alias("part_id"))
    keys = keys.withColumn("whole", F.when(F.col("part_of") != "", P.plain(F.col("part_of")))).join(target, "whole", "left").join(gone, "row", "left")
    key = keys.select("id", "label", "aliases", F.lit("key").alias("kind"), none("array<string>").alias("documents"), "scope", F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"), "class", F.col("part_id").alias("part_of"), F.lit("curated").alias("source"), none("string").alias("definition"))
    return defined.unionByName(key)


def in_scope(document: Column) -> Column:
    """Whether an entry of an inventory (its columns kind, documents, scope, excluded) may be used in a document."""
    general = F.lit(False)
    for name, pattern in SCOPES.items():
        general = general | ((F.get("scope", F.lit(0)) == name) & document.rlike(pattern))
    key = ~F.array_contains(F.coalesce("excluded", F.array().cast("array<string>")), document) & (general | F.array_contains("scope", document))
    return F.coalesce(F.when(F.col("kind") == "defined", F.array_contains("documents", document)).otherwise(key), F.lit(False))


def names_in_scope(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """document, plain, id and kind: what each name may mean in each of the documents.

    Entries of named documents meet them by key; only those of the general scopes meet all documents
    of their scope, which their number (a curated list) bounds.
    """
    named = inventory.select("*", F.explode(F.coalesce(F.when(F.col("kind") == "defined", F.col("documents")).otherwise(F.filter("scope", lambda s: ~s.isin(*SCOPES))), F.array().cast("array<string>"))).alias("document"))
    met = named.join(documents.select("document").distinct(), "document")
    scoped = documents.select("document", F.explode(F.array_compact(F.array(*[F.when(F.col("document").rlike(p), F.lit(n)) for n, p in SCOPES.items()]))).alias("general")).distinct()
    wide = inventory.filter("kind = 'key'").withColumn("general", F.get("scope", F.lit(0))).join(scoped, "general").drop("general")
    both = met.unionByName(wide.select(*met.columns)).filter(in_scope(F.col("document")))
    return both.select("document", F.explode(F.transform(F.concat(F.array("label"), "aliases"), P.plain)).alias("plain"), "id", "kind").distinct()


def conflicts(names: DataFrame) -> DataFrame:
    """document, plain and ids (sorted) of the names that mean more than one entry there; a term that the document defines is never in conflict with a key entry, which it excludes."""
    return names.groupBy("document", "plain").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter("size(ids) > 1")
