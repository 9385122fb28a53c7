"""Typed and dated relations of laws from their nested XML descriptions, by Spark's own XML parser with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of relations and what their groups hold.
KINDS = ("verwijzing-door", "grondslag-voor", "wettelijke-bevoegdheid-voor")
GROUPS = ("gerelateerde-regeling", "gerelateerd-regelingelement")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


_S = T.StringType()
_REF = _struct(**{"_bwb-id": _S, "_doc": _S, "_label": _S, "_VALUE": _S})
_GROUP = _struct(**{"_geldig-van": _S, "_geldig-tot": _S, "extref": T.ArrayType(_REF)})
_BLOCK = _struct(**{g: T.ArrayType(_GROUP) for g in GROUPS})
_RELATED = {k: T.ArrayType(_BLOCK) for k in KINDS}
SCHEMA = _struct(**{"gerelateerde-regelgeving": _struct(regeling=_struct(**_RELATED), regelingelementen=_struct(regelingelement=T.ArrayType(_struct(**{"_groep": _S, "_label-id": _S}, **_RELATED))))})


def relations(docs: DataFrame, key: str = "instrument", xml: str = "xml") -> DataFrame:
    """key and one row for each reference: level, label_id, kind, bwb_id, doc, unit_kind, unit_value, label, text, valid_from, valid_until.

    level is `instrument` for relations of a law as a whole (label_id null) and `article` for those of one of its
    articles; other elements are left out.  unit is the first `&kind=value` of doc.  Null, broken and
    empty descriptions have no relations.  The result serves as an edge list, from the reference to the key.
    """
    parsed = docs.filter(F.col(xml).isNotNull()).select(key, F.from_xml(F.col(xml), SCHEMA, {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "true", "inferSchema": "false"})["gerelateerde-regelgeving"].alias("g"))
    # One pass over what is parsed once: the law and its articles, their blocks by kind, the groups of those, and references.
    held = lambda r: F.struct(*[r[k].alias(k) for k in KINDS])
    text = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit("instrument").alias("level"), text.alias("label_id"), held(F.col("g.regeling")).alias("r")))
    articles = F.transform(F.filter("g.regelingelementen.regelingelement", lambda x: x["_groep"] == "artikel"), lambda x: F.struct(F.lit("article").alias("level"), x["_label-id"].alias("label_id"), held(x).alias("r")))
    units = parsed.select(key, F.explode(F.concat(whole, F.coalesce(articles, F.slice(whole, 1, 0)))).alias("u")).select(key, "u.*")
    none = F.array().cast(T.ArrayType(_BLOCK))
    named = lambda kind: lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("b"))
    each = [F.transform(F.coalesce(F.col(f"r.`{k}`"), none), named(k)) for k in KINDS]
    blocks = units.select(key, "level", "label_id", F.explode(F.concat(*each)).alias("k")).select(key, "level", "label_id", "k.*")
    some = F.concat(*[F.coalesce(F.col(f"b.`{g}`"), F.array().cast(T.ArrayType(_GROUP))) for g in GROUPS])
    found = blocks.select(key, "level", "label_id", "kind", F.explode(some).alias("g")).select("*", F.explode("g.extref").alias("e"))
    out = found.select(key, "level", "label_id", "kind", F.col("e.`_bwb-id`").alias("bwb_id"), F.col("e._doc").alias("doc"), F.col("e._label").alias("label"), F.coalesce(F.trim("e._VALUE"), F.lit("")).alias("text"), F.col("g.`_geldig-van`").alias("valid_from"), F.col("g.`_geldig-tot`").alias("valid_until"))
    unit = r"&(\w+)=([^&]+)"
    return out.withColumns({f"unit_{name}": F.nullif(F.regexp_extract("doc", unit, k), F.lit("")) for k, name in ((1, "kind"), (2, "value"))})


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """The relations of a folder of descriptions, one file a law; instrument is the name of the file without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("instrument"), F.col("value").alias("xml"))
    return relations(files)
