"""Queries over whole texts, extractions and tables: spans, agreement, phrases, definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..operators import agreement as A
from ..operators import containment as C
from ..operators import inventory as I
from ..operators import spans as S
from ..sources import table
from ..sources import tables as G

TEXT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TEXT_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        TEXT_QUERIES[f.__name__] = f
        if oracle:
            TEXT_ORACLES[f.__name__] = oracle
        return f

    return add


#: First word and number of words of the phrases that label_spans takes from a passage; they overlap.
_CUTS = [(0, 3), (1, 4), (2, 2), (4, 6), (5, 2)]


def _passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each benchmark passage, its phrases some overlapping runs of its words."""
    words = F.array_remove(F.split("text", r"[\x09-\x0D\x20\xA0]+"), "")
    cut = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in _CUTS]))
    rows = table(spark, sf_dir, "benchmark").filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("label"), words.alias("words"), cut.alias("c"))
    return rows.filter(F.size("words") >= F.col("c.a") + F.col("c.n")).select("label", F.array_join(F.slice("words", F.col("c.a") + 1, F.col("c.n")), " ").alias("phrase"))


_SPACE = r"[\x09-\x0D\x20\x{A0}]"
_TOK = rf"{_SPACE}*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\x09-\x0D\x20\x{{A0}}])"


def _marked(text: str) -> str:
    """SQL for the tokens of a text in lower case, a space before those that follow one."""
    return rf"list_transform(regexp_extract_all({text}, '{_TOK}'), lambda x: CASE WHEN regexp_matches(x, '^{_SPACE}') THEN ' ' ELSE '' END || lower(regexp_replace(x, '^{_SPACE}+', '')))"


@query(rf"""WITH RECURSIVE w AS (SELECT item_id::VARCHAR AS label, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS ws FROM benchmark),
ph AS (SELECT DISTINCT label, array_to_string(list_slice(ws, a + 1, a + n), ' ') AS phrase FROM w, (VALUES {', '.join(f'({a}, {n})' for a, n in _CUTS)}) c(a, n) WHERE len(ws) >= a + n),
px AS (SELECT label, m[1] AS first, len(m) AS n, ltrim(array_to_string(m, '')) AS norm FROM (SELECT label, {_marked('phrase')} AS m FROM ph)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_TOK}') AS raw, {_marked("coalesce(text, '')")} AS m FROM documents),
t AS (SELECT doc_id, i, ltrim(tok) AS tok, size, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS till, lead FROM (SELECT doc_id, generate_subscripts(raw, 1) AS i, unnest(m) AS tok, unnest(list_transform(raw, lambda x: length(x))) AS size, unnest(list_transform(raw, lambda x: length(x) - length(regexp_replace(x, '^{_SPACE}+', '')))) AS lead FROM d)),
h AS (SELECT DISTINCT t.doc_id, t.till - t.size + t.lead AS s, e.till AS e, px.label FROM t JOIN px ON px.first = t.tok JOIN d ON d.doc_id = t.doc_id JOIN t e ON e.doc_id = t.doc_id AND e.i = t.i + px.n - 1 WHERE ltrim(array_to_string(list_slice(d.m, t.i, t.i + px.n - 1), '')) = px.norm),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, label) AS r FROM h),
g AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, []::STRUCT(s BIGINT, e BIGINT, label VARCHAR)[] AS kept FROM h
UNION ALL SELECT g.doc_id, r.r, CASE WHEN len(list_filter(g.kept, lambda k: k.s < r.e AND r.s < k.e)) > 0 THEN g.kept ELSE list_append(g.kept, {{'s': r.s::BIGINT, 'e': r.e::BIGINT, 'label': r.label}}) END FROM g JOIN r ON r.doc_id = g.doc_id AND r.r = g.r + 1),
k AS (SELECT doc_id, unnest(arg_max(kept, r)) AS k FROM g GROUP BY doc_id)
SELECT doc_id, k.label AS label, k.s::INTEGER AS start, k.e::INTEGER AS "end" FROM k""")
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = S.label_spans(docs, _passage_labels(spark, sf_dir))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.label", "s.start", "s.end")


def _two_readings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two passes over a client's hour: changes of two sources each, their columns as the fields of a norm."""
    c = table(spark, sf_dir, "client_changes").filter("client_id IS NOT NULL AND valid_at IS NOT NULL")
    hour = F.date_format("valid_at", "yyyy-MM-dd HH")
    rows = c.select("client_id", hour.alias("hour"), F.col("source"), F.struct("change_id", "seq", "op", "segment", "city", "source").alias("k"), F.col("op").alias("deontic"), F.concat_ws(" ", "segment", "source").alias("actor"), F.col("segment").alias("action_lemma"), F.concat_ws(" ", "city", "segment").alias("object"), F.lit(None).cast("string").alias("trigger_event"), F.lit(None).cast("string").alias("deadline_raw"), F.array("city", "op").alias("recipient"), F.array("source").alias("thresholds"), F.array().cast("array<string>").alias("conditions"))
    place = F.row_number().over(A.by_place("client_id", "hour"))
    return [rows.filter(F.col("source").isin(*some)).withColumn("pos", place - 1).drop("k", "source") for some in (("crm", "web"), ("store", "partner"))]


_READ = """c AS (SELECT *, strftime(valid_at, '%Y-%m-%d %H') AS hour FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL),
n AS (SELECT client_id, hour, source IN ('crm', 'web') AS one, row_number() OVER (PARTITION BY client_id, hour, source IN ('crm', 'web') ORDER BY change_id, seq, op NULLS FIRST, segment NULLS FIRST, city NULLS FIRST, source) - 1 AS pos, op, segment, coalesce(lower(segment), '') AS l,
 list_distinct(list_filter(string_split(lower(concat_ws(' ', city, segment)), ' '), lambda x: x <> '')) AS ow, list_distinct(list_filter(string_split(lower(concat_ws(' ', segment, source)), ' '), lambda x: x <> '')) AS aw,
 list_distinct(list_filter(string_split(lower(concat_ws(' ', city, op)), ' '), lambda x: x <> '')) AS rw, [source] AS tw FROM c WHERE source IN ('crm', 'web', 'store', 'partner')),
p AS (SELECT a.client_id, a.hour, a.pos AS i, b.pos AS j, (CASE WHEN a.op IS NOT DISTINCT FROM b.op THEN 1.0::DOUBLE ELSE 0.0 END) + (CASE WHEN a.l <> '' AND a.l = b.l THEN 1.0::DOUBLE ELSE 0.0 END)
 + (CASE WHEN len(a.ow) > 0 AND len(b.ow) > 0 THEN len(list_intersect(a.ow, b.ow))::DOUBLE / least(len(a.ow), len(b.ow)) ELSE 0 END) + (CASE WHEN len(a.aw) > 0 AND len(b.aw) > 0 THEN len(list_intersect(a.aw, b.aw))::DOUBLE / least(len(a.aw), len(b.aw)) ELSE 0 END) AS score
 FROM n a JOIN n b ON a.one AND NOT b.one AND a.client_id = b.client_id AND a.hour = b.hour),
r AS (SELECT *, row_number() OVER (PARTITION BY client_id, hour ORDER BY score DESC, i, j) AS r FROM p WHERE score > 0),
g AS (SELECT DISTINCT client_id, hour, 0::BIGINT AS r, []::BIGINT[] AS us, []::BIGINT[] AS ut, []::STRUCT(i BIGINT, j BIGINT, score DOUBLE)[] AS kept FROM r
 UNION ALL SELECT g.client_id, g.hour, r.r, CASE WHEN ok THEN list_append(us, r.i) ELSE us END, CASE WHEN ok THEN list_append(ut, r.j) ELSE ut END, CASE WHEN ok THEN list_append(kept, {'i': r.i, 'j': r.j, 'score': r.score}) ELSE kept END
 FROM g JOIN r ON r.client_id = g.client_id AND r.hour = g.hour AND r.r = g.r + 1, LATERAL (SELECT NOT list_contains(g.us, r.i) AND NOT list_contains(g.ut, r.j) AS ok)),
k AS (SELECT client_id, hour, k.i AS i, k.j AS j, k.score AS score, x AS x FROM (SELECT client_id, hour, unnest(kept) AS k, generate_subscripts(kept, 1) AS x FROM (SELECT client_id, hour, arg_max(kept, r) AS kept FROM g GROUP BY ALL))),
f AS (SELECT client_id, hour, i, j, score, 0 AS part, x FROM k UNION ALL SELECT client_id, hour, pos, NULL, NULL, 1, pos FROM n WHERE one AND NOT EXISTS (FROM k WHERE k.client_id = n.client_id AND k.hour = n.hour AND k.i = n.pos)
 UNION ALL SELECT client_id, hour, NULL, pos, NULL, 2, pos FROM n WHERE NOT one AND NOT EXISTS (FROM k WHERE k.client_id = n.client_id AND k.hour = n.hour AND k.j = n.pos)),
o AS (SELECT f.*, (row_number() OVER (PARTITION BY f.client_id, f.hour ORDER BY part, x) - 1)::INTEGER AS norm_index, a.op AS op1, b.op AS op2, a.pos IS NOT NULL AND b.pos IS NOT NULL AS paired,
 a.segment AS s1, b.segment AS s2, CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN list_filter([CASE WHEN a.op IS DISTINCT FROM b.op THEN 'deontic' END, CASE WHEN len(list_intersect(a.aw, b.aw))::DOUBLE / least(len(a.aw), len(b.aw)) < 0.5 THEN 'actor' END, CASE WHEN a.l <> b.l THEN 'action_lemma' END,
 CASE WHEN len(a.ow) + len(b.ow) > 0 AND coalesce(len(list_intersect(a.ow, b.ow))::DOUBLE / nullif(least(len(a.ow), len(b.ow)), 0), 0) < 0.5 THEN 'object' END, CASE WHEN len(a.rw) + len(b.rw) > 0 AND coalesce(len(list_intersect(a.rw, b.rw))::DOUBLE / nullif(least(len(a.rw), len(b.rw)), 0), 0) < 0.5 THEN 'recipient' END,
 CASE WHEN a.tw <> b.tw THEN 'thresholds' END], lambda y: y IS NOT NULL) END AS diffs
 FROM f LEFT JOIN n a ON a.one AND a.client_id = f.client_id AND a.hour = f.hour AND a.pos = f.i LEFT JOIN n b ON NOT b.one AND b.client_id = f.client_id AND b.hour = f.hour AND b.pos = f.j)"""


@query(f"WITH RECURSIVE {_READ} SELECT client_id, hour, norm_index, coalesce(i, -1) AS i, coalesce(j, -1) AS j, round(score, 9) AS score, array_to_string(diffs, ',') AS diffs FROM o")
def aligned_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.align(*_two_readings(spark, sf_dir), ["client_id", "hour"])
    return made.select("client_id", "hour", "norm_index", F.coalesce("one.pos", F.lit(-1)).alias("i"), F.coalesce("two.pos", F.lit(-1)).alias("j"), F.round("score", 9).alias("score"), F.array_join("diffs", ",").alias("diffs"))


@query(f"""WITH RECURSIVE {_READ}, q AS (SELECT *, i IS NULL OR (paired AND op2 IN ('I', 'U') AND NOT coalesce(op1 IN ('I', 'U'), false)) AS second FROM o)
SELECT client_id, hour, norm_index, CASE WHEN second THEN op2 ELSE op1 END AS deontic, CASE WHEN second THEN s2 ELSE s1 END AS action_lemma, NOT paired OR len(diffs) > 0 AS uncertain, CASE WHEN NOT paired THEN 'found by one of two passes' WHEN len(diffs) > 0 THEN 'passes disagreed' ELSE 'agreed' END AS reason,
CASE WHEN paired AND len(diffs) > 0 THEN CASE WHEN second THEN i ELSE j END ELSE -1 END AS alternative_pos, CASE WHEN paired AND op1 IS DISTINCT FROM op2 THEN CASE WHEN second THEN op1 ELSE op2 END END AS deontic_alternative FROM q""")
def conservative_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = ["client_id", "hour"]
    made = A.resolve(A.align(*_two_readings(spark, sf_dir), unit), unit, actionable=("I", "U"))
    return made.select(*unit, "norm_index", "deontic", "action_lemma", "uncertain", "reason", F.coalesce("alternative.pos", F.lit(-1)).alias("alternative_pos"), "deontic_alternative")


def _brand_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand: its parts in rows, the type stated where it changes, the name left out for every seventh size."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type", "p_size", "p_name")
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    above = F.lag("p_type").over(by)
    cell = lambda name, text: F.concat(F.lit(f'<entry colname="{name}"><al>'), F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("</al></entry>"))
    row = F.concat(F.lit("<row>"), F.when(above.eqNullSafe(F.col("p_type")), "").otherwise(cell("a", F.col("p_type"))), cell("b", F.col("p_size")), F.when(F.col("p_size") % 7 == 0, "").otherwise(cell("c", F.col("p_name"))), F.lit("</row>"))
    rows = part.withColumn("row", row).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"]), "").alias("body"))
    head = '<table><tgroup><colspec colname="a"/><colspec colname="b"/><colspec colname="c"/><thead><row><entry namest="a" nameend="b">Kind</entry><entry colname="c">Name</entry></row><row><entry colname="a">type</entry><entry colname="b">size</entry><entry colname="c">Name</entry></row></thead><tbody>'
    return rows.select("p_brand", F.concat(F.lit(head), "body", F.lit("</tbody></tgroup></table>")).alias("xml"))


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS row_no FROM part),
n AS (SELECT *, coalesce(last_value(CASE WHEN p_size % 7 <> 0 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey), '(geen)') AS name FROM r)
SELECT p_brand, row_no, 0 AS column_no, 'Kind – type' AS header, p_type AS text FROM n UNION ALL SELECT p_brand, row_no, 1, 'Kind – size', p_size::VARCHAR FROM n UNION ALL SELECT p_brand, row_no, 2, 'Name', name FROM n""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table_grid(_brand_tables(spark, sf_dir), "p_brand").select("p_brand", "row_no", "column_no", "header", "text")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of actors as texts have them, made of clients' segments and cities in four ways."""
    c = table(spark, sf_dir, "clients").select("client_id", F.coalesce("segment", F.lit("groep")).alias("s"), F.coalesce("city", F.lit("Stad")).alias("t"))
    way = F.pmod("client_id", F.lit(4))
    phrase = F.when(way == 0, F.concat(F.lit("a) de "), "s", F.lit(" als bedoeld in artikel 43, lid 2, van deze verordening"))).when(way == 1, F.concat(F.lit("door alle  "), "s", F.lit("s die wonen in "), "t")).when(way == 2, F.lit("Zij")).otherwise(F.concat(F.lit("“"), "t", F.lit("” en/of het "), "s"))
    return c.filter("client_id IS NOT NULL").select(way.alias("way"), phrase.alias("phrase"))


@query("""WITH c AS (SELECT client_id % 4 AS way, coalesce(segment, 'groep') AS s, coalesce(city, 'Stad') AS t FROM clients WHERE client_id IS NOT NULL)
SELECT CASE way WHEN 0 THEN 'a) de ' || s || ' als bedoeld in artikel 43, lid 2, van deze verordening' WHEN 1 THEN 'door alle  ' || s || 's die wonen in ' || t WHEN 2 THEN 'Zij' ELSE '“' || t || '” en/of het ' || s END AS phrase,
CASE way WHEN 0 THEN s WHEN 1 THEN s || 's' WHEN 2 THEN '' ELSE t || ' of het ' || s END AS actor,
CASE way WHEN 0 THEN 'list mark,reference,signs at the ends,leading words' WHEN 1 THEN 'relative clause,spaces,preposition at the front,leading words' WHEN 2 THEN 'pronoun' ELSE 'quotes,and/or' END AS rules, count(*) AS n FROM c GROUP BY ALL""")
def cleaned_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _phrases(spark, sf_dir).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))  # each phrase is cleaned once
    return phrases.withColumn("r", P.rewritten(F.col("phrase"))).select("phrase", F.col("r.text").alias("actor"), F.array_join("r.trace", ",").alias("rules"), "n")


@query("""WITH c AS (SELECT DISTINCT segment AS s, source AS o, city AS t FROM clients WHERE segment IS NOT NULL AND source IS NOT NULL AND city IS NOT NULL)
SELECT s || 's en ' || o || 'en, de ' || s || ' van ' || t AS phrase, 0 AS place, s || 's van ' || t AS part, s || 's' AS head FROM c
UNION ALL SELECT s || 's en ' || o || 'en, de ' || s || ' van ' || t, 1, o || 'en van ' || t, o || 'en' FROM c UNION ALL SELECT s || 's en ' || o || 'en, de ' || s || ' van ' || t, 2, s || ' van ' || t, s FROM c""")
def coordinated_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").filter("segment IS NOT NULL AND source IS NOT NULL AND city IS NOT NULL")
    phrases = c.select(F.concat("segment", F.lit("s en "), "source", F.lit("en, de "), "segment", F.lit(" van "), "city").alias("phrase")).distinct()
    parts = phrases.select("phrase", F.posexplode(P.conjuncts(F.col("phrase"))).alias("place", "part"))
    return parts.withColumn("head", P.head_split(F.col("part"))["head"])


@query()
def stem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of all documents and its key."""
    words = table(spark, sf_dir, "documents").select(F.explode(P.words_of(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return words.withColumn("key", P.word_key(F.col("word")))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as defined terms of their brand, endings of their names as heads, items of whole tens as key entries."""
    items = table(spark, sf_dir, "items").filter("name IS NOT NULL AND brand IS NOT NULL AND kind IS NOT NULL")
    thing = F.substring_index("name", " ", -1)
    definitions = items.select(F.col("brand").alias("document"), F.col("item_id").alias("position"), F.concat("name", F.lit(" voor "), "kind").alias("term"), F.col("item_id").alias("article"), F.lit(None).cast("string").alias("paragraph"), F.col("name").alias("definition"))
    heads = items.filter("size < 30").groupBy(F.substring(thing, -4, 4).alias("ending")).agg(F.min("kind").alias("class"))
    heads = heads.union(items.filter("item_id < 2").select(thing, F.lit("-")).distinct())
    keyed = items.filter("item_id % 10 = 0")
    curated = keyed.select(F.col("item_id").alias("position"), F.col("name").alias("label"), F.array(F.concat("name", F.lit(" voor "), "kind")).alias("aliases"), F.when(F.col("item_id") % 20 == 0, F.array(F.lit("eu"))).otherwise(F.array("brand")).alias("scope"), F.col("kind").alias("class"), F.concat(F.lit("large "), thing).alias("part_of"))
    return I.actor_inventory(definitions, heads, curated)


_ITEMS = r"""i AS (SELECT *, split_part(name, ' ', -1) AS thing, lower(strip_accents(name || ' voor ' || kind)) AS plain, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '_', 'g') AS slug FROM items WHERE name IS NOT NULL AND brand IS NOT NULL AND kind IS NOT NULL),
h AS (SELECT lower(right(thing, 4)) AS ending, min(kind) AS class FROM i WHERE size < 30 GROUP BY ALL), no AS (SELECT DISTINCT lower(thing) AS w FROM i WHERE item_id < 2),
f AS (SELECT thing, unnest([lower(thing), CASE WHEN thing LIKE '%s' AND length(thing) > 3 THEN left(lower(thing), -1) END, CASE WHEN thing LIKE '%en' AND length(thing) > 4 THEN left(lower(thing), -2) END, CASE WHEN thing LIKE '%n' AND length(thing) > 3 THEN left(lower(thing), -1) END]) AS form, unnest([1, 2, 3, 4]) AS turn FROM (SELECT DISTINCT thing FROM i WHERE lower(thing) NOT IN (FROM no))),
c AS (SELECT thing, arg_min(class, turn * 100 - length(ending)) AS class FROM f JOIN h ON ends_with(form, ending) GROUP BY thing),
d AS (SELECT i.*, c.class AS own, row_number() OVER (PARTITION BY brand, plain ORDER BY item_id, name || ' voor ' || i.kind) AS r FROM i JOIN c ON i.thing = c.thing),
k AS (SELECT *, 'KEY:' || CASE WHEN item_id % 20 = 0 THEN 'EU' ELSE brand END || ':' || trim(slug, '_') AS id FROM i WHERE item_id % 10 = 0),
t AS (SELECT lower(strip_accents(name)) AS label, arg_max(id, item_id) AS id FROM k GROUP BY ALL)"""


@query(rf"""WITH {_ITEMS}
SELECT brand || ':' || trim(regexp_replace(plain, '[^a-z0-9]+', '_', 'g'), '_') AS id, name || ' voor ' || kind AS label, 'defined' AS kind, brand AS scope, '' AS excluded, own AS class, NULL AS part_of, brand || ' art. ' || item_id AS source FROM d WHERE r = 1
UNION ALL SELECT k.id, k.name, 'key', CASE WHEN item_id % 20 = 0 THEN 'eu' ELSE brand END, coalesce((SELECT string_agg(DISTINCT d.brand, ',' ORDER BY d.brand) FROM d WHERE d.plain = k.plain), ''), k.kind, t.id, 'curated' FROM k LEFT JOIN t ON t.label = lower(strip_accents('large ' || k.thing))""")
def actor_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.array_join(F.coalesce("documents", "scope"), ",")
    return _inventory(spark, sf_dir).select("id", "label", "kind", scope.alias("scope"), F.array_join(F.coalesce("excluded", F.array().cast("array<string>")), ",").alias("excluded"), "class", "part_of", "source")


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS whole, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, 'whole' AS kind, [whole] AS parts FROM b UNION ALL SELECT item_id, 'shortened', [lower(array_to_string(w[1:9], ' ')), lower(array_to_string(w[-7:], ' '))] FROM b WHERE len(w) > 20 UNION ALL SELECT item_id, 'short', [lower(array_to_string(w[1:3], ' '))] FROM b WHERE item_id % 4 = 0)
SELECT DISTINCT doc_id, item_id, kind FROM n JOIN s ON contains(t, parts[1]) AND (len(parts) = 1 OR contains(substr(t, instr(t, parts[1]) + length(parts[1])), parts[2]))""")
def verbatim_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in whole texts: whole, shortened to their first nine and last seven words, and the first three words of some."""
    b = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").withColumn("w", F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "))
    join = lambda *x: F.array_join(F.slice("w", *x), " ")
    spans = b.select("item_id", F.lit("whole").alias("kind"), F.col("text").alias("span"))
    spans = spans.union(b.filter("size(w) > 20").select("item_id", F.lit("shortened"), F.concat(join(1, 9), F.lit(" ... "), join(-7, 7)))).union(b.filter("item_id % 4 = 0").select("item_id", F.lit("short"), join(1, 3)))
    spans = spans.select(F.struct("item_id", "kind").alias("span_id"), "span")
    found = C.verbatim_pairs(spans, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    return found.select(F.col("text_id").alias("doc_id"), "span_id.item_id", "span_id.kind")
