"""Projections, text functions, grouped merges and checks, in the form of `portable`.

The dialects name some functions differently; these are written in capitals and filled in.
"""

_SPARK = {"RLIKE(": "regexp_like(", " GLOBAL)": ")", "SIZE(": "size(", "UNIQUE(": "array_distinct(", "BOTH(": "array_intersect(", "EACH(": "explode(", "JOINED(": "array_join("}
_OTHER = {"RLIKE(": "regexp_matches(", " GLOBAL)": ", 'g')", "SIZE(": "len(", "UNIQUE(": "list_distinct(", "BOTH(": "list_intersect(", "EACH(": "unnest(", "JOINED(": "array_to_string("}


def _two(sql: str) -> tuple[str, str]:
    out = []
    for names in (_SPARK, _OTHER):
        text = sql
        for name, own in names.items():
            text = text.replace(name, own)
        out.append(text)
    return out[0], out[1]


#: Function words of four languages.
_FUNCTION_WORDS = {"en": "the|and|of|to|in", "fr": "le|la|les|des|et", "de": "der|die|das|und|ist", "es": "el|los|las|que|y"}
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+', 0)"

_SQL: dict[str, str] = {
    # Projections
    "flatten_with_ordinal": "WITH n AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ordinal FROM {lineitem}) SELECT l_orderkey, ordinal, l_returnflag FROM n WHERE l_returnflag IN ('R', 'A')",
    "paragraph_resolution": "SELECT doc_id, CASE WHEN n_chars > 600 THEN 'index' WHEN lang = 'en' THEN 'number' WHEN text IS NOT NULL THEN 'joined' ELSE 'none' END AS resolution, coalesce(nullif(trim(text), ''), lang) AS paragraph FROM {documents}",
    "graph_uid": "SELECT doc_id, coalesce(source, 'unknown') || ':' || coalesce(lang, '?') || ':' || CAST(doc_id AS VARCHAR(20)) AS uid FROM {documents}",
    "addressee_cascade": "SELECT p_partkey, CASE WHEN RLIKE(p_type, 'BRASS$') THEN 'AUTHORITY' WHEN RLIKE(p_type, '^(PROMO|ECONOMY)') THEN 'REGULATED_ENTITY' WHEN p_size > 40 THEN 'MEMBER_STATE' WHEN p_brand LIKE '%1' THEN 'PERSON' END AS addressee FROM {part}",
    "sibling_inference": "WITH s AS (SELECT o_custkey, o_orderpriority AS kind, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderpriority), t AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total FROM s) SELECT o_custkey, kind, CASE WHEN n = total THEN 'unanimous' ELSE 'majority' END AS rule FROM t WHERE 2 * n > total",
    "canonical_reading": "SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[ ]+', ' ' GLOBAL))) AS reading FROM {documents}",
    "norm_text": "SELECT p_partkey, coalesce(nullif(trim(p_name), ''), p_brand || ' ' || p_type) || coalesce(' ; ' || CASE WHEN p_size > 10 THEN p_type END, '') AS norm_text FROM {part}",
    "duty_projection": "SELECT o_orderkey AS norm_id, o_orderstatus AS deontic, o_orderpriority AS deadline_raw FROM {orders} WHERE o_orderstatus IN ('O', 'F')",
    "label_qualifier_split": "SELECT p_partkey, regexp_extract(p_type, '^([A-Z]+) (.*)$', 1) AS head, regexp_extract(p_type, '^([A-Z]+) (.*)$', 2) AS qualifier, substr(p_brand, 1, 6) AS domain FROM {part}",
    "identity_migration": "WITH m AS (SELECT o_custkey AS old_id, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS new_id FROM {orders} GROUP BY o_custkey) SELECT old_id, CASE WHEN n = 1 THEN CAST(new_id AS VARCHAR(20)) END AS new_id, n > 1 AS at_risk FROM m",
    "status_projection": "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'mapped' WHEN s_acctbal > 0 THEN 'fallback' WHEN s_acctbal IS NULL THEN 'unknown' ELSE 'not_actor' END AS status, regexp_extract(s_name, '^([^#]*)#', 1) AS document FROM {supplier}",
    # Text functions
    "content_words": f"SELECT doc_id, CAST(SIZE(UNIQUE({_WORDS})) AS BIGINT) AS n_words FROM {{documents}}",
    "content_overlap": f"WITH w AS (SELECT doc_id, UNIQUE({_WORDS}) AS w FROM {{documents}}) SELECT a.doc_id AS i, b.doc_id AS j, CAST(SIZE(BOTH(a.w, b.w)) AS BIGINT) AS shared, SIZE(BOTH(a.w, b.w)) >= 0.2 * least(SIZE(a.w), SIZE(b.w)) AND least(SIZE(a.w), SIZE(b.w)) > 0 AS same_function FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
    "slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_' GLOBAL), '^_+|_+$', '' GLOBAL) AS slug FROM {part}",
    "reference_counts": "SELECT doc_id, CAST(SIZE(regexp_extract_all(coalesce(text, ''), '[0-9]+', 0)) AS BIGINT) AS figures, CAST(SIZE(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+@[a-z]+', 0)) AS BIGINT) AS mails FROM {documents}",
    "extracted_references": "SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, EACH(regexp_extract_all(coalesce(text, ''), '[0-9][0-9]+', 0)) AS ref FROM {documents}) x",
    "excerpt": "SELECT doc_id, CASE WHEN instr(text, 'e') > 20 THEN '…' ELSE '' END || substr(text, greatest(1, instr(text, 'e') - 20), 40) || '…' AS excerpt FROM {documents} WHERE instr(text, 'e') > 0",
    "condition_cleanup": "SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '^(if|when|als|indien) ', '' GLOBAL) AS condition FROM {documents}",
    "deadline_hours": "WITH d AS (SELECT o_orderkey, CAST(o_custkey % 50 AS DOUBLE) AS v, CASE o_orderkey % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' WHEN 3 THEN 'month' ELSE 'year' END AS unit FROM {orders}), u(unit, hours) AS (VALUES ('hour', 1.0E0), ('day', 24.0E0), ('week', 168.0E0), ('month', 720.0E0)) SELECT d.o_orderkey, d.v * u.hours AS hours FROM d LEFT JOIN u ON d.unit = u.unit",
    "deadline_agreement": "WITH o AS (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_linestatus) AS raw_a, max(l_linestatus) AS raw_b FROM {lineitem} GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN lo < 5 THEN raw_a = raw_b ELSE lo = hi END AS agrees FROM o",
    "instrument_typing": "SELECT doc_id, CASE WHEN source LIKE 'src%' THEN 'EU' ELSE 'NL' END AS jurisdiction, regexp_extract(source, '[0-9]+', 0) AS number FROM {documents}",
    "language_check": "SELECT doc_id, " + ", ".join(f"CAST(SIZE(regexp_extract_all(' ' || lower(coalesce(text, '')), ' ({w})', 0)) AS BIGINT) AS {k}" for k, w in _FUNCTION_WORDS.items()) + " FROM {documents}",
    "length_check": "SELECT doc_id, CAST(SIZE(regexp_extract_all(coalesce(text, ''), '[^ ]+', 0)) AS BIGINT) AS words, SIZE(regexp_extract_all(coalesce(text, ''), '[^ ]+', 0)) > 1.1 * 120 AS too_long, CAST(round(least(50, greatest(10, 50 - 20 * (log10(greatest(SIZE(regexp_extract_all(coalesce(text, ''), '[^ ]+', 0)), 1)) - 1))), 4) AS DOUBLE) AS target FROM {documents}",
    "mechanical_line_checks": "WITH r AS (SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, EACH(regexp_extract_all(coalesce(text, ''), '[0-9]+', 0)) AS ref FROM {documents}) x) SELECT r.doc_id, r.ref FROM r WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = r.doc_id + 1 AND instr(d.text, r.ref) > 0)",
    "input_gates": "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 END) AS blank, count(*) = count(DISTINCT doc_id) AS unique_ids FROM {documents}",
    "verdict_checks": "SELECT doc_id, coalesce(CASE WHEN quality IS NULL THEN 'no quality' END, CASE WHEN toxic = 1 AND quality > 1 THEN 'good but toxic' END, CASE WHEN toxic NOT IN (0, 1) THEN 'label' END, 'consistent') AS reason FROM {labels}",
    "thesaurus_allow_list": "WITH c AS (SELECT p_partkey, 'http://t/' || p_brand AS uri FROM {part}), allowed(code) AS (VALUES ('Brand#11'), ('Brand#12'), ('Brand#23')) SELECT c.p_partkey, regexp_extract(c.uri, '[^/]+$', 0) AS concept FROM c WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.code = regexp_extract(c.uri, '[^/]+$', 0))",
    # Groups
    "article_pair_groups": "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, count(*) AS n, min(l_linenumber) AS priority, bool_or(l_returnflag = 'R') AS warned FROM {lineitem} GROUP BY 1, 2",
    "addressee_summary": "WITH c AS (SELECT c_nationkey, c_mktsegment AS v, count(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY c_nationkey) AS total, count(*) OVER (PARTITION BY c_nationkey) AS variants FROM c) SELECT c_nationkey, CAST(total AS BIGINT) AS total, variants, v || ' (' || CAST(n AS VARCHAR(20)) || ')' AS mode FROM r WHERE r = 1",
    "thesaurus_groups": "SELECT p_brand, min(p_type) AS first_type, count(DISTINCT p_type) AS types, count(DISTINCT p_type) > 1 AS ambiguous FROM {part} GROUP BY p_brand",
    "candidate_merge": "WITH c AS (SELECT l_orderkey, l_partkey AS concept, max(l_discount) AS confidence, min(l_linenumber) AS level FROM {lineitem} GROUP BY l_orderkey, l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, concept) AS r FROM c) SELECT l_orderkey, concept, confidence, level FROM r WHERE r <= 2",
    "burden_counts": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS recipients, count(DISTINCT l_quantity) AS deadlines, count(DISTINCT l_partkey) AS instruments FROM {lineitem} GROUP BY l_orderkey HAVING count(*) > 1",
    "coverage_report": "SELECT d.source, count(*) AS n, count(l.doc_id) AS checked, count(*) - count(l.doc_id) AS unchecked FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source",
    "lexicon_hits": f"WITH w AS (SELECT EACH(UNIQUE({_WORDS})) AS w FROM {{documents}}) SELECT w AS lemma, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY w ORDER BY n DESC, lemma LIMIT 25",
    "review_totals": "SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS warned FROM {customer} GROUP BY c_mktsegment",
    "list_screen": "SELECT c.c_custkey, c.c_name, c.c_mktsegment FROM {customer} c WHERE lower(c.c_name) LIKE '%00%' AND c.c_mktsegment = 'BUILDING' ORDER BY CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END, c_custkey",
}

SHAPING: dict[str, tuple[str, str | None]] = {name: _two(sql) for name, sql in _SQL.items()}
