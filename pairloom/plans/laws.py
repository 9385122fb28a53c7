"""Queries of the operators over laws: definitions, relations, versions, nearest labels and findings, on texts that Spark makes of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import definitions as D
from ..operators import findings as R
from ..operators import nearest as N
from ..operators import versions as V
from ..sources import records as Q
from ..sources import relations as S
from ..sources import table

LAW_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LAW_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        LAW_QUERIES[f.__name__] = f
        if oracle:
            LAW_ORACLES[f.__name__] = oracle
        return f

    return add


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as laws: article 1 defines the names of their small parts in a list, an article for each size tells of its parts."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("instrument"), "p_partkey", "p_name", "p_type", "p_size")
    lines = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"]), "")
    item = F.concat(F.lit("a. "), "p_name", F.lit(": "), "p_type", F.lit(" van "), "p_size", F.lit(";\n"))
    first = part.filter("p_size < 5").groupBy("instrument").agg(F.concat(F.lit("In deze wet wordt verstaan onder:\n"), lines(item), F.lit("Artikel 2\nslot: einde")).alias("text")).select("instrument", F.lit(1).alias("article"), "text")
    rest = part.groupBy("instrument", (F.col("p_size") + 1).alias("article")).agg(lines(F.concat(F.lit("de "), "p_name", F.lit("s, ("), "p_type", F.lit(") "))).alias("text"))
    return first.unionByName(rest)


_DEFINED = "d AS (SELECT p_brand AS instrument, lower(p_name) AS low, first(p_name ORDER BY p_partkey) AS term, first(p_type || ' van ' || p_size ORDER BY p_partkey) AS definition FROM part WHERE p_size < 5 GROUP BY ALL)"


@query(f"WITH {_DEFINED} SELECT instrument, 1 AS article, term, definition, 'lijst' AS pattern FROM d")
def prose_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.definitions(_articles(spark, sf_dir), ["instrument", "article"])


@query(rf"""WITH {_DEFINED}, a AS (SELECT p_brand AS instrument, p_size + 1 AS article, lower(string_agg('de ' || p_name || 's, (' || p_type || ') ', '' ORDER BY p_partkey)) AS text FROM part GROUP BY ALL),
u AS (SELECT d.instrument, d.term, a.article, len(regexp_extract_all(a.text, '\b' || regexp_escape(d.low) || '\w{{0,2}}\b')) AS c FROM d JOIN a ON d.instrument = a.instrument AND a.article <> 1)
SELECT d.instrument, d.term, 1 AS defined_in, coalesce(sum(c), 0)::BIGINT AS uses, count(*) FILTER (c > 0) AS used_in FROM d LEFT JOIN u ON u.instrument = d.instrument AND u.term = d.term GROUP BY ALL""")
def term_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _articles(spark, sf_dir)
    found = D.definitions(articles.filter("article = 1"), ["instrument", "article"])
    return D.term_uses(found, articles)


@query("""WITH r AS (SELECT * FROM part)
SELECT p_brand AS instrument, CASE WHEN p_size % 3 = 0 THEN 'instrument' ELSE 'article' END AS level, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS label_id, CASE p_size % 2 WHEN 0 THEN 'verwijzing-door' ELSE 'grondslag-voor' END AS kind,
'B' || p_partkey AS bwb_id, 'artikel' AS unit_kind, p_size::VARCHAR AS unit_value, p_type AS label, p_name AS text, CASE WHEN p_size > 25 THEN '2020-01-01' END AS valid_from, count(*) AS n FROM r GROUP BY ALL""")
def law_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "verwijzing-door").otherwise("grondslag-voor")
    ref = F.concat(F.lit('<extref bwb-id="B'), "p_partkey", F.lit('" doc="jci1.3:c:X&amp;artikel='), "p_size", F.lit('&amp;lid=1" label="'), "p_type", F.lit('">'), "p_name", F.lit("</extref>"))
    block = F.concat(F.lit("<"), kind, F.lit("><gerelateerde-regeling"), F.when(F.col("p_size") > 25, ' geldig-van="2020-01-01"').otherwise(""), F.lit(">"), ref, F.lit("</gerelateerde-regeling></"), kind, F.lit(">"))
    whole = F.array_join(F.collect_list(F.when(F.col("p_size") % 3 == 0, block)), "")
    each = F.concat(F.lit('<regelingelement groep="artikel" label-id="'), "p_size", F.lit('">'), block, F.lit("</regelingelement>"))
    parts = F.array_join(F.collect_list(F.when(F.col("p_size") % 3 != 0, each)), "")
    # A law's relations in descriptions of 20,000 keys each, so that none grows with the table.
    docs = part.groupBy(F.col("p_brand").alias("instrument"), F.floor(F.col("p_partkey") / 20_000)).agg(F.concat(F.lit("<wetstechnische-informatie><gerelateerde-regelgeving><regeling>"), whole, F.lit("</regeling><regelingelementen>"), parts, F.lit("</regelingelementen></gerelateerde-regelgeving></wetstechnische-informatie>")).alias("xml"))
    found = S.relations(docs)
    return found.groupBy("instrument", "level", "label_id", "kind", "bwb_id", "unit_kind", "unit_value", "label", "text", "valid_from").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT client_id, seq, change_id, op, coalesce(city, '') AS text FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, (op = 'D')::INT, CASE op WHEN 'I' THEN 'add' WHEN 'D' THEN 'repeal' ELSE 'replace' END, text) AS r FROM c),
b AS (SELECT client_id, min(coalesce(city, '')) AS text, min(segment) AS chapter FROM clients WHERE client_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(b.client_id, l.client_id) AS article, CASE WHEN l.r IS NOT NULL THEN l.text ELSE b.text END AS text, b.chapter, coalesce(l.seq, -1) AS version, CASE WHEN l.r IS NULL THEN 'kept' WHEN b.client_id IS NOT NULL THEN 'replaced' ELSE 'added' END AS origin
FROM b FULL JOIN (FROM l WHERE r = 1) l ON l.client_id = b.client_id WHERE l.op IS DISTINCT FROM 'D'""")
def law_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients as articles, the log of their changes as later versions."""
    base = table(spark, sf_dir, "clients").filter("client_id IS NOT NULL").groupBy(F.col("client_id").alias("article")).agg(F.min(F.coalesce("city", F.lit(""))).alias("text"), F.min("segment").alias("chapter"))
    change = F.when(F.col("op") == "I", "add").when(F.col("op") == "D", "repeal").otherwise("replace")
    changes = table(spark, sf_dir, "client_changes").filter("client_id IS NOT NULL").select(F.col("client_id").alias("article"), F.coalesce("city", F.lit("")).alias("text"), F.col("seq").alias("version"), change.alias("change"))
    return V.overlay(base, changes, ["article"]).withColumn("version", F.coalesce("version", F.lit(-1)))


_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0)"


@query(f"""WITH {_VECTORS}, p AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 12) AS s FROM w a JOIN w b ON a.label % 2 = 0 AND b.label % 2 <> 0),
t AS (SELECT vec_id, max(s) AS s FROM p GROUP BY vec_id) SELECT p.vec_id, min(other) AS nearest, round(t.s, 6) AS cosine FROM p JOIN t ON p.vec_id = t.vec_id AND p.s = t.s GROUP BY ALL""")
def nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even labels as units, those of odd ones as the labels of another corpus."""
    rows = table(spark, sf_dir, "embeddings")
    units = rows.filter("label % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    labels = rows.filter("label % 2 <> 0").select(F.col("vec_id").alias("label"), F.col("embedding").alias("vector"))
    found = N.nearest_labels(units, labels)
    return found.select(F.col("id").alias("vec_id"), F.col("label").alias("nearest"), F.round("cosine", 6).alias("cosine"))


def _pairs(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Each part with the part of a key greater by step, as two provisions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    side = lambda df, e: df.select((F.col("p_partkey") + (step if e == "a" else 0)).alias("k"), F.struct(F.col("p_partkey").cast("string").alias("uid"), F.col("p_brand").alias("instrument")).alias(e), F.col("p_type").alias(f"t{e}"), F.col("p_size").alias(f"s{e}"))
    met = side(part, "a").join(side(part, "b"), "k")
    same = F.col("ta") == F.col("tb")
    return met.select(F.col("a").alias("left"), F.col("b").alias("right"), F.round((F.col("sa") + F.col("sb")) / 100, 2).alias("score"), (F.col("sa") % 3 + 1).alias("tier"), F.array(F.col("ta")).alias("reasons"), F.when(F.col("sb") % 5 == 0, "INSUFFICIENT_EVIDENCE").alias("verdict"), F.when(F.col("sb") % 7 == 0, "inconsistent").alias("recheck_reason"), F.when(F.col("sa") % 4 == 0, F.col("sb") % 2 == 0).alias("challenge_survives"), same.alias("collides"), same.alias("near"), (F.col("sa") > F.col("sb")).alias("linked"), F.col("sa").alias("left_size"))


_FOUND = """f AS (SELECT 'tension' AS producer, 1 AS step UNION ALL SELECT 'basis', 2),
g AS (SELECT f.producer, a.p_partkey::VARCHAR AS u, b.p_partkey::VARCHAR AS v, a.p_brand = b.p_brand AS inner_, round((a.p_size + b.p_size) / 100, 2) AS score, a.p_size % 3 + 1 AS tier, a.p_size AS sa, b.p_size AS sb, a.p_type = b.p_type AS same FROM f JOIN part a ON true JOIN part b ON b.p_partkey = a.p_partkey + step WHERE f.producer = 'tension' OR a.p_size > 20),
h AS (SELECT *, 'F-C1-' || left(sha256(least(u, v) || '::' || greatest(u, v)), 12) AS finding_id, CASE WHEN sb % 7 = 0 THEN 'needs_recheck' WHEN sa % 4 = 0 AND sb % 2 <> 0 THEN 'challenge_failed' WHEN sb % 5 = 0 THEN 'unverifiable' ELSE 'candidate' END AS status FROM g)"""


@query(f"""WITH {_FOUND} SELECT row_number() OVER (ORDER BY (status <> 'candidate')::INT, score DESC, producer = 'basis', finding_id) AS place, producer, finding_id, score AS rank_score, status, CASE tier WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS confidence,
CASE WHEN inner_ THEN 'internal_coherence' ELSE 'cross_law' END AS scope, CASE WHEN status = 'candidate' THEN same::VARCHAR ELSE 'open' END AS incompatible, concat_ws(',', CASE WHEN sa > sb THEN 'graph_adjacency' END, CASE WHEN same THEN 'semantic_similarity' END) AS criteria FROM h""")
def findings_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two producers' findings; the second replaces its own by those of the larger parts, and all are put in order."""
    how = {"category": "C1", "signals": {"linked": "graph_adjacency", "near": "semantic_similarity"}}
    old = R.assemble(_pairs(spark, sf_dir, 1), producer="tension", subtype="t", **how).unionByName(R.assemble(_pairs(spark, sf_dir, 2), producer="basis", subtype="b", **how))
    new = R.assemble(_pairs(spark, sf_dir, 2).filter("left_size > 20"), producer="basis", subtype="b", **how)
    rows = R.ranked(R.replace_own(old, new, ["basis"]), ["tension", "basis"])
    of = lambda path, kind="string": F.try_variant_get("body", path, kind)
    return rows.select(F.col("place").cast("long").alias("place"), "producer", "finding_id", "rank_score", of("$.status").alias("status"), of("$.confidence_label").alias("confidence"), of("$.scope").alias("scope"), F.coalesce(of("$.incompatibility_established", "boolean").cast("string"), F.lit("open")).alias("incompatible"), F.array_join(of("$.criteria_fired", "array<string>"), ",").alias("criteria"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size % 7 ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand, p_size % 7) AS n, first_value(p_name) OVER (PARTITION BY p_brand, p_size % 7, p_size ORDER BY p_partkey) AS same FROM part),
j AS (SELECT p_brand, p_size % 7 AS a, string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey) AS whole FROM part GROUP BY ALL)
SELECT p.p_brand || ':' || (p_size % 7) || ':' || CASE WHEN p_size % 3 = 2 THEN 'whole' ELSE p_size::VARCHAR END || ':' || (k + 1) AS norm_id, (k + 1)::INTEGER AS ordinal, CASE p_size % 4 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' ELSE 'COMPETENCE' END AS deontic,
CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN same ELSE whole END AS paragraph, CASE p_size % 3 WHEN 0 THEN 'paragraph_index' WHEN 1 THEN 'paragraph_number' ELSE 'all_paragraphs' END AS resolution,
(p_size % 7 + 1)::VARCHAR AS chapter_number, CASE WHEN p_size % 3 <> 2 THEN p_size::VARCHAR END AS paragraph_number FROM p JOIN j ON p.p_brand = j.p_brand AND p_size % 7 = j.a WHERE p_size % 4 <> 3""")
def flattened_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text for each article: the sizes of a brand modulo seven as articles, parts as paragraphs and norms, which name their paragraph in three ways."""
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select("p_brand", (size % 7).alias("a"), "p_partkey", "p_name", "p_size")
    place = F.row_number().over(Window.partitionBy("p_brand", "a").orderBy("p_partkey")) - 1
    deontic = F.element_at(F.array(*[F.lit(x) for x in ("OBLIGATION", "PROHIBITION", "COMPETENCE", "RIGHT")]), size % 4 + 1)
    norm = F.struct(deontic.alias("deontic"), F.when(size % 3 == 0, F.col("k")).alias("paragraph_index"), F.when(size % 3 != 2, size).alias("number"))
    both = F.struct("p_partkey", F.struct(size.alias("number"), F.col("p_name").alias("text")).alias("p"), norm.alias("n"))
    articles = part.withColumn("k", place).groupBy("p_brand", "a").agg(F.array_sort(F.collect_list(both)).alias("b"))
    records = articles.select("p_brand", F.struct(F.col("p_brand").alias("instrument_id"), F.col("a").cast("string").alias("article"), F.concat(F.lit("Hoofdstuk "), F.col("a") + 1, F.lit(". Delen")).alias("chapter"), F.transform("b", lambda x: x["p"]).alias("paragraphs"), F.transform("b", lambda x: x["n"]).alias("norms")).alias("r"))
    files = records.select(F.concat_ws("/", "p_brand", "r.article").alias("source"), F.to_json(F.array("r")).alias("value"))
    made = Q.norm_records(Q.provisions(files))
    return made.select("norm_id", "ordinal", "deontic", "paragraph", "resolution", "hierarchy.chapter_number", "hierarchy.paragraph_number")
