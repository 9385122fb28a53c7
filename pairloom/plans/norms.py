"""Queries of the norm operators over stand-in norms, each with SQL written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import norms as N
from ..operators import review as V
from ..sources import table

NORM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NORM_ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        NORM_QUERIES[f.__name__] = f
        NORM_ORACLES[f.__name__] = oracle
        return f

    return add


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as norms: brand for instrument, size for article (none from 45 on), kind for addressee (none for LARGE)."""
    kind = F.nullif(F.col("p_type"), F.lit("LARGE"))
    size = F.col("p_size")
    poles = F.when((size == 3) & (F.col("p_type") == "SMALL"), F.array(F.lit("speed+"))).when((size == 3) & (F.col("p_type") == "ECONOMY"), F.array(F.lit("speed-")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("norm_id"), F.col("p_brand").alias("instrument"), F.when(size < 45, size).alias("article"), F.length("p_name").alias("paragraph"), kind.alias("addressee"), F.col("p_name").alias("text"), F.array_compact(F.array(kind)).alias("actors"), (size == 1).alias("incident"), ((size == 2) & (F.col("p_type") != "PROMO")).alias("risk"), poles.alias("poles"))


_N = "n AS (SELECT p_partkey AS norm_id, p_brand AS instrument, CASE WHEN p_size < 45 THEN p_size END AS article, length(p_name) AS paragraph, CASE WHEN p_type <> 'LARGE' THEN p_type END AS addressee, p_name, p_type, p_size FROM part)"
_INFER = f"""WITH {_N}, k AS (SELECT * FROM n WHERE addressee IS NOT NULL),
sp AS (SELECT instrument, article, paragraph, any_value(addressee) AS v FROM k GROUP BY ALL HAVING count(DISTINCT addressee) = 1),
c AS (SELECT instrument, article, addressee, count(*) AS m FROM k GROUP BY ALL),
tp AS (SELECT c.instrument, c.article, c.addressee AS v FROM c JOIN (SELECT instrument, article, sum(m) AS s FROM c GROUP BY ALL) t ON c.instrument = t.instrument AND c.article = t.article WHERE 2 * m > s),
i AS (SELECT n.norm_id, n.addressee, sp.v AS a, tp.v AS b FROM n LEFT JOIN sp ON n.instrument = sp.instrument AND n.article = sp.article AND n.paragraph = sp.paragraph LEFT JOIN tp ON n.instrument = tp.instrument AND n.article = tp.article)"""


@query(f"{_INFER} SELECT norm_id, coalesce(a, b) AS inferred, CASE WHEN a IS NOT NULL THEN 'paragraph' WHEN b IS NOT NULL THEN 'article' END AS inferred_by FROM i WHERE addressee IS NULL")
def inferred_addressees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.infer_addressee(_norms(spark, sf_dir)).filter("addressee is null").select("norm_id", "inferred", "inferred_by")


@query(f"{_INFER} SELECT coalesce(addressee, a, b) AS addressee, count(*) AS n FROM i WHERE coalesce(addressee, a, b) IS NOT NULL GROUP BY 1")
def norms_with_addressee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_addressee(_norms(spark, sf_dir)).groupBy("addressee").agg(F.count(F.lit(1)).alias("n"))


_EDGES = "SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS i, greatest(a.l_partkey, b.l_partkey) AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"


def _following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand in following lines of an order, as citations; some more than once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("k"))
    met = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey <> k")
    return met.select(F.least("l_partkey", "k").alias("i"), F.greatest("l_partkey", "k").alias("j"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _following(spark, sf_dir).distinct()


@query(f"""WITH {_N}, p AS (SELECT norm_id, instrument, addressee, p_size = 1 AS incident, p_size = 2 AND p_type <> 'PROMO' AS risk, CASE WHEN p_size = 3 AND p_type = 'SMALL' THEN 1 WHEN p_size = 3 AND p_type = 'ECONOMY' THEN -1 END AS pole FROM n),
s AS (SELECT a.norm_id AS i, b.norm_id AS j, 'incident' AS signal FROM p a, p b WHERE a.norm_id < b.norm_id AND a.instrument <> b.instrument AND a.incident AND b.incident
UNION ALL SELECT a.norm_id, b.norm_id, 'risk' FROM p a, p b WHERE a.norm_id < b.norm_id AND a.instrument <> b.instrument AND a.risk AND b.risk
UNION ALL SELECT a.norm_id, b.norm_id, 'poles' FROM p a, p b WHERE a.norm_id < b.norm_id AND a.instrument <> b.instrument AND a.pole * b.pole = -1
UNION ALL SELECT i, j, 'cited' FROM ({_EDGES})),
g AS (SELECT i, j, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, bool_or(signal IN ('poles', 'risk')) AS strong FROM s GROUP BY i, j),
r AS (SELECT g.*, CASE WHEN a.addressee = b.addressee THEN 'same_actor' WHEN (a.addressee = 'SMALL' AND b.addressee = 'ECONOMY') OR (a.addressee = 'ECONOMY' AND b.addressee = 'SMALL') THEN 'same_process' ELSE 'unrelated' END AS relation FROM g JOIN p a ON g.i = a.norm_id JOIN p b ON g.j = b.norm_id)
SELECT i, j, relation, signals FROM r WHERE relation = 'same_actor' OR (relation = 'same_process' AND strong)""")
def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.signal_candidates(_norms(spark, sf_dir), ["incident", "risk"], "poles", {"cited": _following(spark, sf_dir)}, [("SMALL", "ECONOMY")], ["poles", "risk"])
    return found.select("i", "j", "relation", F.array_join("signals", ",").alias("signals"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two units a part: its name and its kind, both with its size."""
    part = table(spark, sf_dir, "part")
    words, size = F.split("p_name", " "), F.col("p_size").cast("string")
    head = F.concat_ws(" ", words[1], size)
    one = part.select(F.col("p_partkey").alias("owner"), F.col("p_name").alias("unit"), F.lit(1).alias("pos"), head.alias("head"), F.concat_ws(" ", "p_type", size).alias("tail"), F.array(head, F.concat_ws(" ", words[0], "p_brand", "p_type")).alias("nouns"), F.array(F.concat_ws(" ", words[0], "p_brand", size)).alias("concepts"))
    kind = F.concat_ws(" ", "p_type", size)
    two = part.select("p_partkey", "p_type", F.lit(2), kind, F.lit(None).cast("string"), F.array(kind), F.array().cast("array<string>"))
    return one.union(two)


@query("""WITH w AS (SELECT *, split_part(p_name, ' ', 1) AS w0, split_part(p_name, ' ', 2) || ' ' || p_size AS h, p_type || ' ' || p_size AS t FROM part),
u AS (SELECT p_partkey AS owner, 1 AS pos, p_name AS unit, h AS head, t AS tail, [h, w0 || ' ' || p_brand || ' ' || p_type] AS nouns, w0 || ' ' || p_brand || ' ' || p_size AS concept FROM w UNION ALL SELECT p_partkey, 2, p_type, t, NULL, [t], NULL FROM w),
k0 AS (SELECT owner, pos, 'w:' || head AS key, 'head' AS role FROM u UNION SELECT owner, pos, 'w:' || tail, 'tail' FROM u WHERE tail IS NOT NULL UNION SELECT owner, pos, 'w:' || unnest(nouns), 'noun' FROM u UNION SELECT owner, pos, 'ev:' || concept, 'ev' FROM u WHERE concept IS NOT NULL),
sp AS (SELECT key, 1 - ln(1 + count(DISTINCT owner)) / ln(1 + (SELECT count(DISTINCT owner) FROM u)) AS s FROM k0 GROUP BY key),
m AS (SELECT a.owner AS i, b.owner AS j, a.pos AS pa, b.pos AS pb, a.key, max(CASE WHEN a.role = 'ev' THEN 0.9 WHEN a.role = 'head' AND b.role = 'head' THEN 1.0 WHEN a.role IN ('head', 'tail') AND b.role IN ('head', 'tail') THEN 0.8 ELSE 0.7 END) AS weight FROM k0 a JOIN k0 b ON a.key = b.key AND a.owner < b.owner GROUP BY ALL),
x AS (SELECT m.*, s, row_number() OVER (PARTITION BY i, j ORDER BY s * weight::DOUBLE DESC, pa, pb, m.key[position(':' IN m.key) + 1:]) AS r FROM m JOIN sp ON m.key = sp.key)
SELECT i, j, round(s * weight::DOUBLE, 4) AS score, a.unit AS unit_i, b.unit AS unit_j, key[position(':' IN key) + 1:] AS key, CASE weight WHEN 0.9 THEN 'eurovoc' WHEN 1.0 THEN 'head' WHEN 0.8 THEN 'tail' ELSE 'noun' END AS relation, round(s, 4) AS specificity, weight::DOUBLE AS weight,
CASE WHEN a.head = b.head THEN CASE WHEN list_sort(a.nouns) = list_sort(b.nouns) THEN 'same' WHEN list_has_all(a.nouns, b.nouns) THEN 'a_narrower' WHEN list_has_all(b.nouns, a.nouns) THEN 'b_narrower' ELSE '' END WHEN a.tail = b.head THEN 'a_narrower' WHEN b.tail = a.head THEN 'b_narrower' ELSE '' END AS direction
FROM x JOIN u a ON x.i = a.owner AND x.pa = a.pos JOIN u b ON x.j = b.owner AND x.pb = b.pos WHERE r = 1""")
def object_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.object_pair_scores(_units(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT p_brand || '/' || p_size % 5 AS article, p_partkey AS pos, CASE WHEN p_size % 4 <> 0 THEN p_size::VARCHAR END AS label, p_name || repeat(' ' || p_type, p_size % 9) AS text FROM part),
o AS (SELECT *, coalesce(label, (row_number() OVER (PARTITION BY article ORDER BY pos))::VARCHAR) AS name, count(*) OVER (PARTITION BY article) AS n FROM p),
x AS (SELECT a.article, a.pos, b.name, b.text, row_number() OVER (PARTITION BY a.article, a.pos ORDER BY b.pos) AS r FROM o a JOIN o b ON a.article = b.article AND a.pos <> b.pos),
c AS (SELECT DISTINCT article, pos, 0::BIGINT AS r, 300 AS rest, '' AS context FROM x
UNION ALL SELECT c.article, c.pos, x.r, greatest(rest - length(t), 0)::INTEGER, context || CASE WHEN x.r > 1 THEN chr(10) || chr(10) ELSE '' END || '[lid ' || x.name || '] ' || t
FROM c JOIN x ON x.article = c.article AND x.pos = c.pos AND x.r = c.r + 1, LATERAL (SELECT CASE WHEN length(x.text) > c.rest THEN rtrim(left(x.text, greatest(c.rest, 20))) || ' [...]' ELSE x.text END AS t))
SELECT o.article, o.pos, CASE WHEN o.n > 1 THEN arg_max(c.context, c.r) END AS context FROM o LEFT JOIN c ON c.article = o.article AND c.pos = o.pos GROUP BY o.article, o.pos, o.n""")
def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and a fifth of the sizes as the paragraphs of an article, some without a number."""
    size = F.col("p_size")
    text = F.concat("p_name", F.repeat(F.concat(F.lit(" "), "p_type"), size % 9))
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", (size % 5).cast("string")).alias("article"), F.col("p_partkey").alias("pos"), F.when(size % 4 != 0, size).alias("label"), text.alias("text"))
    return N.context_with_budget(rows, 300, least=20)


@query("""WITH m AS (SELECT a.p_partkey AS norm_id, b.p_partkey AS idx, contains(b.p_name, a.p_name) AS has FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_size + 1 = b.p_size)
SELECT norm_id, CASE WHEN count(idx) = 1 THEN min(idx) WHEN count(*) FILTER (has) = 1 THEN min(idx) FILTER (has) ELSE -1 END AS idx, CASE count(idx) WHEN 0 THEN 'none' WHEN 1 THEN 'number' ELSE CASE WHEN count(*) FILTER (has) = 1 THEN 'span' ELSE 'ambiguous' END END AS how FROM m GROUP BY norm_id""")
def paragraph_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    norms = part.select(F.col("p_partkey").alias("norm_id"), F.col("p_brand").alias("unit"), (F.col("p_size") + 1).alias("number"), F.col("p_name").alias("span"))
    return N.paragraph_backfill(norms, part.select(F.col("p_brand").alias("unit"), F.col("p_size").alias("number"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))).fillna(-1, ["idx"])


@query(f"""WITH z AS (SELECT DISTINCT p_brand, lower(p_type) AS alias FROM part)
SELECT i, j, x.p_size = y.p_size AND (x.p_brand = y.p_brand OR EXISTS (FROM z WHERE z.p_brand = y.p_brand AND contains(lower(x.p_name || ' ' || x.p_type), z.alias)) OR EXISTS (FROM z WHERE z.p_brand = x.p_brand AND contains(lower(y.p_name || ' ' || y.p_type), z.alias))) AS suppressed
FROM ({_EDGES}) e JOIN part x ON e.i = x.p_partkey JOIN part y ON e.j = y.p_partkey""")
def deference_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's deference names the article of its own size; a brand is known by the kinds it makes."""
    part = table(spark, sf_dir, "part")
    of = lambda k, e: part.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(f"instrument_{e}"), F.col("p_size").cast("string").alias(f"article_{e}"), F.concat(F.lit("Op grond van Artikel "), F.col("p_size").cast("string"), F.lit(", van die wet")).alias(f"deference_{e}"), F.concat_ws(" ", "p_name", "p_type").alias(f"blob_{e}"))
    pairs = _edges(spark, sf_dir).join(of("i", "a"), "i").join(of("j", "b"), "j")
    aliases = part.select(F.col("p_brand").alias("instrument"), F.lower("p_type").alias("alias")).distinct()
    return N.deference_suppresses(pairs, aliases).select("i", "j", "suppressed")


@query("""WITH d AS (SELECT DISTINCT p_brand AS instrument, split_part(p_name, ' ', 1) AS term FROM part UNION SELECT p_brand, p_name FROM part UNION SELECT p_brand, right(p_name, 5) FROM part),
h AS (SELECT DISTINCT p_partkey AS norm_id, term FROM part JOIN d ON p_brand = instrument AND length(term) >= 4 AND contains(lower(p_name || ' ' || p_type), lower(term)))
SELECT norm_id, term, row_number() OVER (PARTITION BY norm_id ORDER BY length(term) DESC, term) AS rank FROM h QUALIFY rank <= 2""")
def relevant_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    norms = part.select(F.col("p_partkey").alias("norm_id"), F.col("p_brand").alias("instrument"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    terms = part.select(F.col("p_brand").alias("instrument"), F.explode(F.array(F.split("p_name", " ")[0], F.col("p_name"), F.right("p_name", F.lit(5)))).alias("term"))
    return N.relevant_definitions(norms, terms)


@query("""SELECT a.p_partkey AS ref_id, d.x AS number, coalesce((SELECT string_agg(b.p_name, '|' ORDER BY b.p_name) FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size = d.x), '') AS texts
FROM (SELECT *, unnest([p_size, p_size + 1]) AS x FROM part) d JOIN part a ON a.p_partkey = d.p_partkey""")
def paragraph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("instrument"), F.col("p_type").alias("article"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("numbers"))
    known = part.select(F.col("p_brand").alias("instrument"), F.col("p_type").alias("article"), F.col("p_size").alias("number"), F.col("p_name").alias("text"))
    return N.paragraph_references(refs, known).select("ref_id", "number", F.array_join("texts", "|").alias("texts"))


@query(f"""WITH x AS (SELECT n_nationkey AS id, 'Brand#' || n_nationkey AS instrument, n_regionkey * 5 + 1 AS low, n_regionkey * 5 + 8 AS high FROM nation)
SELECT i, j, coalesce(CASE WHEN a.p_brand <> b.p_brand THEN (SELECT min(id) FROM x WHERE (instrument = a.p_brand AND a.p_size BETWEEN low AND high) OR (instrument = b.p_brand AND b.p_size BETWEEN low AND high)) END, -1) AS exception
FROM ({_EDGES}) e JOIN part a ON e.i = a.p_partkey JOIN part b ON e.j = b.p_partkey""")
def conditional_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    of = lambda k, e: part.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(f"instrument_{e}"), F.col("p_size").alias(f"article_{e}"))
    low = F.col("n_regionkey") * 5 + 1
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("instrument"), low.alias("low"), (low + 7).alias("high"))
    return N.conditional_exception(_edges(spark, sf_dir).join(of("i", "a"), "i").join(of("j", "b"), "j"), known).select("i", "j", "exception").fillna(-1, ["exception"])


@query("""WITH h AS (SELECT DISTINCT replace(p_name, ' ', '') AS head FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part)
SELECT head, tail FROM (SELECT a.head, b.head AS tail, row_number() OVER (PARTITION BY a.head ORDER BY length(b.head) DESC) AS r FROM h a JOIN h b ON length(b.head) >= 4 AND length(b.head) < length(a.head) AND ends_with(a.head, b.head)) WHERE r = 1""")
def compound_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return N.compound_tails(part.select(F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit("")), F.split("p_name", " ")[1])).alias("head")))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT l_returnflag AS stratum, l_suppkey AS i, l_partkey AS j, md5('draw|' || l_suppkey || '|' || l_partkey) AS h FROM lineitem),
s AS (SELECT stratum, row_number() OVER (ORDER BY count(*), stratum) AS turn, count(*) AS size FROM k GROUP BY stratum),
o AS (SELECT k.*, s.turn, s.size, row_number() OVER (PARTITION BY k.stratum ORDER BY h, i, j) AS r FROM k JOIN s ON k.stratum = s.stratum),
g AS (SELECT 1::BIGINT AS turn, 1::BIGINT AS r, []::BIGINT[] AS used, 0 AS n, NULL::VARCHAR AS stratum, NULL::BIGINT AS i, NULL::BIGINT AS j, 0 AS draw
UNION ALL SELECT CASE WHEN done THEN o.turn + 1 ELSE o.turn END, CASE WHEN done THEN 1 ELSE o.r + 1 END, CASE WHEN ok THEN g.used || [o.i, o.j] ELSE g.used END, CASE WHEN done THEN 0 ELSE g.n + ok::INT END, CASE WHEN ok THEN o.stratum END, o.i, o.j, g.n + ok::INT
FROM g JOIN o ON o.turn = g.turn AND o.r = g.r, LATERAL (SELECT len(list_filter(g.used, lambda x: x = o.i)) < 2 AND len(list_filter(g.used, lambda x: x = o.j)) < 2 AS ok), LATERAL (SELECT g.n + ok::INT = 50 OR o.r = o.size AS done))
SELECT stratum, i, j, draw FROM g WHERE stratum IS NOT NULL""")
def draw_with_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts share one count of uses, as norms do that stand on either side of a pair."""
    pool = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stratum"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).distinct()
    return V.draw_with_uses(pool, "stratum", 50, 2)


@query(f"""SELECT i, j, CASE WHEN a.p_brand = b.p_brand AND a.p_size % 3 = b.p_size % 3 THEN CASE WHEN a.p_size % 12 + 1 = b.p_size AND b.p_size < 13 THEN 'a' WHEN b.p_size % 12 + 1 = a.p_size AND a.p_size < 13 THEN 'b' END END AS side FROM ({_EDGES}) e JOIN part a ON e.i = a.p_partkey JOIN part b ON e.j = b.p_partkey""")
def paragraph_deference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part defers to the paragraph that follows its size; parts of a brand with one rest of the size are one article."""
    part = table(spark, sf_dir, "part")
    word = F.element_at(F.array(*[F.lit(w) for w in N.ORDINALS]), F.col("p_size") % 12 + 1)
    of = lambda k, e: part.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(f"instrument_{e}"), (F.col("p_size") % 3).alias(f"article_{e}"), F.col("p_size").cast("string").alias(f"number_{e}"), F.concat(F.lit(f"{e}: in afwijking van het "), word, F.lit(" lid")).alias(f"deference_{e}"))
    pairs = _edges(spark, sf_dir).join(of("i", "a"), "i").join(of("j", "b"), "j")
    return N.paragraph_deference(pairs).select("i", "j", F.left("deferring", F.lit(1)).alias("side"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS ins, p_type AS art, p_size::VARCHAR AS num, p_name AS text, [p_size % 9 + 1, p_size % 4 + 1, p_size] AS refs, p_partkey % 5 <> 0 AS norm FROM part),
n AS (SELECT * FROM p WHERE norm), b AS (SELECT * FROM p WHERE NOT EXISTS (FROM n WHERE n.ins = p.ins AND n.art = p.art AND n.text = p.text)),
ix AS (SELECT ins, art, num, string_agg(DISTINCT text, '|' ORDER BY text) AS texts FROM (SELECT ins, art, num, text FROM n UNION ALL SELECT ins, art, num, text FROM b) GROUP BY ALL),
rf AS (SELECT DISTINCT ins, art, num AS by_, unnest(refs)::VARCHAR AS num FROM (FROM n UNION ALL FROM b)),
m AS (SELECT DISTINCT id, ins, art, 'forward' AS direction, r AS num FROM (SELECT id, ins, art, num AS own, unnest(refs)::VARCHAR AS r FROM n) WHERE own <> r UNION SELECT n.id, n.ins, n.art, 'back', rf.by_ FROM n JOIN rf ON rf.ins = n.ins AND rf.art = n.art AND rf.num = n.num WHERE rf.by_ <> n.num)
SELECT id AS norm_id, row_number() OVER (PARTITION BY id ORDER BY direction DESC, CASE direction WHEN 'forward' THEN m.num::INT END, length(m.num), m.num)::INTEGER AS place, direction, m.num AS number, texts FROM m JOIN ix ON ix.ins = m.ins AND ix.art = m.art AND ix.num = m.num""")
def related_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and kind as the paragraphs of an article, sizes as numbers; every fifth holds no norm."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("norm_id"), F.col("p_brand").alias("instrument"), F.col("p_type").alias("article"), size.cast("string").alias("number"), F.col("p_name").alias("text"), F.array(size % 9 + 1, size % 4 + 1, size).alias("refs"))
    found = N.related_paragraphs(rows.filter("norm_id % 5 <> 0"), rows.drop("norm_id"))
    return found.select("norm_id", "place", "direction", "number", F.array_join("texts", "|").alias("texts"))


@query("SELECT o_orderkey, round(least(1.0, 100.0 / (SELECT count(*) FROM orders)), 6)::DOUBLE AS probability FROM orders ORDER BY md5('sample|' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT doc_id, lang = 'en' AS intact FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, FALSE FROM documents WHERE text IS NULL")
def frozen_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of English texts as they were recorded, those of the others of a text since changed."""
    then = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit(".")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(then.cast("binary"), 256).alias("recorded"))
    return N.tampered(rows, "text", "recorded").select("doc_id", "intact")


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight, count(DISTINCT k) AS kinds FROM (SELECT c_mktsegment AS a, n_name AS b, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2")
def stakeholder_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return N.stakeholder_graph(met.select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("kind")))


@query("""WITH i AS (SELECT p_size AS id, p_name AS body, p_type AS label, row_number() OVER (PARTITION BY p_size ORDER BY p_name, p_type) AS n FROM part), m AS (SELECT *, CASE WHEN n = 1 THEN id::VARCHAR ELSE id || '#' || n END AS item_id FROM i)
SELECT item_id, label, n_name AS annotation, sha256(item_id || '|' || label || '|' || body) AS frozen FROM m LEFT JOIN nation ON m.id = n_nationkey AND m.n = 1""")
def gold_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_size").alias("id"), F.col("p_name").alias("body"), F.col("p_type").alias("label"))
    return N.gold_items(items, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value")))


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.filter("lang = 'en'").select(F.lit("m1").alias("model"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    return N.embedding_cache_misses(docs, cache, "m1").select("text_hash")


@query("SELECT unit, tries, CASE WHEN tries < 20 THEN 'retry' ELSE 'escalate' END AS next FROM (SELECT user_id AS unit, count(*) AS tries, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) WHERE last = 'error'")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("ok"))
    return N.retry_queue(tries, 20)


@query("SELECT user_id AS \"user\", max(ts) AS seen FROM events GROUP BY 1 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("seen"))
    now = rows.agg(F.max("seen")).first()[0]  # one value
    return N.live_sessions(rows, F.lit(now).cast("timestamp_ntz"), 86_400)
