"""Records of norms from files of provisions, whatever shape they have: lists, one provision, or an annex that wraps them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where an annex keeps its provisions and the instrument they belong to, the uids of provisions without one, and the types that are compared.
ANNEX, ANNEX_INSTRUMENT = "$.bijlage_35.substantive_text.provisions", "BWBR0049497"
UIDS = {"BWBR0051796": "nl:BWBR0051796:art{number}@2025-11-21", "BWBR0049497": "nl:BWBR0049497:bijlage35-p{number}@2026-08-15"}
ELIGIBLE = ("OBLIGATION", "PROHIBITION", "COMPETENCE")
#: Norms that one copy of a provision's whole text serves.
TURN = 4_096
_CHAPTER = r"^\s*(?i:hoofdstuk|chapter)\s+([IVXLCDM]+|\d+[A-Za-z]?)(?=[\s.:\-–—]|$)"


def provisions(files: DataFrame, *, source: str = "source", text: str = "value", fallback: Mapping[str, str] | None = None) -> DataFrame:
    """source, place from 0, instrument_id and provision (variant): the provisions of JSON texts, one text a file.

    A list holds them; an object with norms is one; an annex holds a list of its own.  An object of
    another shape and a text that is no JSON have none.  The instrument is the provision's own, else that
    of an annex, else what fallback has for the source, else null.
    """
    v = F.try_parse_json(F.col(text))
    read = files.select(source, v.alias("v"))
    many = F.try_variant_get("v", "$", "array<variant>")
    annex = F.try_variant_get("v", ANNEX, "array<variant>")
    one = F.when(F.try_variant_get("v", "$.norms", "array<variant>").isNotNull(), F.array("v"))
    found = read.select(source, (many.isNull() & one.isNull() & annex.isNotNull()).alias("annex"), F.posexplode(F.coalesce(many, one, annex)).alias("place", "provision"))
    own = F.try_variant_get("provision", "$.instrument_id", "string")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv]), F.col(source)) if fallback else F.lit(None).cast("string")
    return found.select(source, "place", F.coalesce(F.nullif(own, F.lit("")), F.when(F.col("annex"), ANNEX_INSTRUMENT), known).alias("instrument_id"), "provision")


def chapter_number(c: Column) -> Column:
    """The number of a chapter's heading (`Hoofdstuk 3a. ...`), null if it has none."""
    return F.nullif(F.regexp_extract(c, _CHAPTER, 1), F.lit(""))


def norm_records(found: DataFrame, *, source: str = "source", eligible: Sequence[str] | None = ELIGIBLE, uids: Mapping[str, str] = UIDS) -> DataFrame:
    """norm_id, source, ordinal, deontic, norm (variant), paragraph, resolution and hierarchy of each norm of `provisions`.

    Norms count from 1 in their provision, also those that are not eligible and left out after.  A norm's paragraph is that of
    its paragraph_index, if there is one; else the first that shows its number; else all, joined by empty lines; else the text of
    the provision.  resolution says which: `paragraph_index`, `paragraph_number`, `all_paragraphs` or `provision_text`.
    hierarchy: instrument_id, jurisdiction, graph_uid, chapter, chapter_number, section, article, article_heading, paragraph_number.
    Provisions without an instrument have no norms here (see `without_instrument`).
    """
    get = lambda path, kind="string": F.try_variant_get("provision", path, kind)
    of = lambda path, kind="string": F.try_variant_get("norm", path, kind)
    rows = found.filter("instrument_id IS NOT NULL").withColumn("key", F.md5(F.to_json("provision")))
    paragraphs = F.coalesce(get("$.paragraphs", "array<struct<number: string, text: string>>"), F.array().cast("array<struct<number: string, text: string>>"))
    article = F.coalesce(F.nullif(get("$.article"), F.lit("")), get("$.number"), F.lit("None"))
    template = F.try_element_at(F.create_map(*[F.lit(x) for kv in uids.items() for x in kv]), F.col("instrument_id")) if uids else F.lit(None).cast("string")
    uid = F.coalesce(get("$.uid"), F.replace(template, F.lit("{number}"), F.coalesce(get("$.number"), F.lit("None"))))
    heading = F.coalesce(F.nullif(get("$.heading"), F.lit("")), F.concat(F.lit("Article "), article))
    listed = get("$.norms", "array<variant>")
    # A norm's row has short fields only: paragraphs and whole texts are met by key, so that none is copied to every norm.
    norms = rows.select(source, "instrument_id", "key", get("$.jurisdiction").alias("jurisdiction"), uid.alias("uid"), get("$.chapter").alias("chapter"), get("$.section").alias("section"), article.alias("article"), heading.alias("heading"), F.posexplode(listed).alias("k", "norm"))
    norms = norms.withColumns({"idx": of("$.paragraph_index", "int"), "shown": F.coalesce(of("$.paragraph_number"), of("$.number")), "deontic": of("$.deontic")})
    if eligible is not None:
        norms = norms.filter(F.col("deontic").isin(*eligible))
    each = rows.select("key", F.posexplode(paragraphs).alias("j", "p")).filter("p IS NOT NULL").dropDuplicates(["key", "j"])
    by_number = each.filter("p.number IS NOT NULL").groupBy("key", F.col("p.number").alias("shown")).agg(F.min_by("p", "j").alias("p2"))
    met = norms.join(each.select("key", F.col("j").alias("idx"), F.col("p").alias("p1")), ["key", "idx"], "left").join(by_number, ["key", "shown"], "left")
    met = met.withColumn("p", F.coalesce("p1", "p2"))
    joined = F.array_join(F.filter(F.transform(paragraphs, lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""), "\n\n")
    # A whole text stands once for TURN norms of its provision; norms with a paragraph look for none (a turn below 0).
    turns = F.sequence(F.lit(0), F.floor((F.size(listed) - 1) / TURN).cast("int"))
    whole = rows.filter(F.size(listed) > 0).select("key", joined.alias("joined"), F.coalesce(get("$.text"), F.lit("")).alias("text"), turns.alias("turns")).dropDuplicates(["key"]).select("key", "joined", "text", F.explode("turns").alias("turn"))
    turn = F.floor(F.col("k") / TURN).cast("int")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as the texts that come out may be far more than what goes in
    met = met.withColumn("turn", F.when(F.col("p").isNull(), turn).otherwise(-1 - turn)).repartition(parts, "key", "turn").join(whole.hint("merge"), ["key", "turn"], "left")
    # A paragraph without text is a paragraph all the same.
    text = F.when(F.col("p").isNotNull(), F.coalesce("p.text", F.lit(""))).when(F.col("joined") != "", F.col("joined")).otherwise(F.col("text"))
    how = F.when(F.col("p1").isNotNull(), "paragraph_index").when(F.col("p2").isNotNull(), "paragraph_number").when(F.col("joined") != "", "all_paragraphs").otherwise("provision_text")
    number = F.when(F.col("p").isNotNull(), F.col("p.number")).otherwise(F.col("shown"))
    hierarchy = F.struct("instrument_id", "jurisdiction", F.col("uid").alias("graph_uid"), "chapter", chapter_number(F.col("chapter")).alias("chapter_number"), "section", "article", F.col("heading").alias("article_heading"), number.alias("paragraph_number"))
    norm_id = F.concat_ws(":", "instrument_id", "article", F.coalesce("shown", F.lit("whole")), (F.col("k") + 1).cast("string"))
    return met.select(norm_id.alias("norm_id"), source, (F.col("k") + 1).alias("ordinal"), "deontic", "norm", text.alias("paragraph"), how.alias("resolution"), hierarchy.alias("hierarchy"))


def without_instrument(found: DataFrame) -> DataFrame:
    """The provisions that neither name an instrument nor have a fallback; there is no silent default."""
    return found.filter("instrument_id IS NULL")


def slim(records: DataFrame, drop: Sequence[str]) -> DataFrame:
    """records without the named fields of norm."""
    fields = F.from_json(F.to_json("norm"), "map<string, variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*drop))
    return records.withColumn("norm", F.parse_json(F.to_json(kept)))


def read_records(spark: SparkSession, path: str, **how: object) -> DataFrame:
    """The provisions of all files under a path; source is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    return provisions(files, **how)
