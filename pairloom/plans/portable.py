"""Queries that read the same in Spark SQL and in the checking dialect; tables stand in braces.

A second text is given only where the dialects differ.
"""

PORTABLE: dict[str, tuple[str, str | None]] = {
    # Filters and cascades
    "eligible_filter": ("SELECT doc_id, lang FROM {documents} WHERE text IS NOT NULL AND n_chars >= 200 AND lang IN ('en', 'fr') AND source IS NOT NULL", None),
    "keyword_family_flags": ("SELECT doc_id, lower(text) LIKE '%license%' OR lower(text) LIKE '%licensed%' AS has_license, text LIKE '%@%' AS has_mail, lower(text) LIKE '%token%' AS has_token FROM {documents}", None),
    "skip_reason_case": ("SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN n_chars < 100 THEN 'short' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' WHEN source = 'src0' THEN 'source' ELSE 'eligible' END AS reason FROM {documents}", None),
    "resolution_cascade": ("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'poor' END, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END, 'unknown') AS resolved FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", None),
    "null_wildcard_lookup": ("SELECT n.n_nationkey, r.change FROM {nation} n JOIN (SELECT 0 AS rk, CAST(NULL AS INT) AS nk, 'whole region' AS change UNION ALL SELECT 1, 2, 'one nation') r ON n.n_regionkey = r.rk AND (r.nk IS NULL OR r.nk = n.n_nationkey)", None),
    "anti_done": ("SELECT o.o_orderkey FROM {orders} o LEFT ANTI JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_returnflag = 'R'", "SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_returnflag = 'R')"),
    # Aggregations
    "frequency_table": ("SELECT o_orderpriority AS label, count(*) AS n FROM {orders} GROUP BY o_orderpriority", None),
    "same_group_pairs_closed_form": ("SELECT CAST(sum(c) * (sum(c) - 1) / 2 AS BIGINT) AS all_pairs, CAST(sum(c * (c - 1) / 2) AS BIGINT) AS same_pairs FROM (SELECT label, count(*) AS c FROM {embeddings} GROUP BY label) t", None),
    "dedupe_merge": ("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY text HAVING count(*) > 1", None),
    "merge_conflict_policy": ("SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS agreed, CAST(count(DISTINCT p_type) AS BIGINT) AS variants FROM {part} GROUP BY p_brand", None),
    "stakeholder_matrix": ("SELECT c.c_nationkey AS buyer, s.s_nationkey AS seller, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey GROUP BY c.c_nationkey, s.s_nationkey", None),
    "importance_points": ("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 ELSE 1 END + CASE WHEN p_retailprice >= 1500 THEN 2 ELSE 0 END AS points FROM {part}", None),
    "chapter_rollup": ("SELECT r.r_name AS chapter, n.n_name AS section, count(*) AS n FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)", None),
    "concentration_topk": ("SELECT o_custkey, n, round(n / t, 6) AS share FROM (SELECT o_custkey, n, sum(n) OVER () AS t FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM {orders} GROUP BY o_custkey) a) b ORDER BY n DESC, o_custkey LIMIT 20", None),
    "bands": ("SELECT CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM {part} GROUP BY 1", None),
    # Windows and top-k
    "occurrence_number": ("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS INT) AS occurrence FROM {lineitem}", None),
    "topk_per_group": ("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) t WHERE r <= 3", None),
    "share_of_total": ("SELECT p_brand, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM (SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand) t", None),
    "dhondt_allocation": ("SELECT c_mktsegment, count(*) AS seats FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY q DESC, c_mktsegment, k) AS r FROM (SELECT c_mktsegment, k, CAST(n AS DOUBLE) / k AS q FROM (SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment) v CROSS JOIN (SELECT explode(sequence(1, 25)) AS k) s) t) u WHERE r <= 25 GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS seats FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY q DESC, c_mktsegment, k) AS r FROM (SELECT c_mktsegment, k, CAST(n AS DOUBLE) / k AS q FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment) v CROSS JOIN (SELECT unnest(range(1, 26)) AS k) s) t) u WHERE r <= 25 GROUP BY c_mktsegment"),
    # Joins
    "left_default_join": ("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", None),
    "suffix_head_join": ("SELECT p.p_partkey, h.class FROM {part} p JOIN (SELECT 'TIN' AS ending, 'metal' AS class UNION ALL SELECT 'STEEL', 'metal' UNION ALL SELECT 'COPPER', 'metal') h ON upper(p.p_type) LIKE concat('%', h.ending)", None),
    "relation_closure": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 'same' ELSE 'sibling' END AS relation FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey", None),
    "scope_overlap": ("SELECT a.c_custkey AS i, b.c_custkey AS j FROM {customer} a JOIN {customer} b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE abs(a.c_acctbal - b.c_acctbal) < 50", None),
    # Scores
    "deontic_table": ("WITH d AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS s FROM {lineitem} GROUP BY l_returnflag, l_linestatus) SELECT a, b, s FROM d UNION ALL SELECT b, a, s FROM d", None),
    "combined_score": ("SELECT p_partkey, round(0.5 * least(1, p_size / 50.0) + 0.3 * least(1, p_retailprice / 2000.0) + 0.2 * CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END, 6) AS score FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand FROM {part}) t", "SELECT p_partkey, round(0.5::DOUBLE * least(1::DOUBLE, p_size / 50.0::DOUBLE) + 0.3::DOUBLE * least(1::DOUBLE, p_retailprice / 2000.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END, 6) AS score FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand FROM part) t"),
    "confidence_tier": ("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 OR toxic = 0 THEN 'medium' ELSE 'low' END AS tier FROM {labels}", None),
    # Evaluation
    "precision_recall": ("SELECT CAST(sum(CASE WHEN p = 1 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN p = 0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM (SELECT CASE WHEN d.n_chars < 200 THEN 1 ELSE 0 END AS p, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) t", None),
    "wilson": ("SELECT source, n, k, round((p + 1.9208D / n - 1.96D * sqrt(p * (1 - p) / n + 0.9604D / (n * n))) / (1 + 3.8416D / n), 6) AS low, round((p + 1.9208D / n + 1.96D * sqrt(p * (1 - p) / n + 0.9604D / (n * n))) / (1 + 3.8416D / n), 6) AS high FROM (SELECT source, n, k, CAST(k AS DOUBLE) / n AS p FROM (SELECT d.source, count(*) AS n, CAST(sum(l.toxic) AS BIGINT) AS k FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source) a) b", "SELECT source, n, k, round((p + 1.9208::DOUBLE / n - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n), 6) AS low, round((p + 1.9208::DOUBLE / n + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n), 6) AS high FROM (SELECT source, n, k, CAST(k AS DOUBLE) / n AS p FROM (SELECT d.source, count(*) AS n, CAST(sum(l.toxic) AS BIGINT) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source) a) b"),
    "invariants_zero_rows": ("SELECT l.l_orderkey FROM {lineitem} l LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL", None),
    "hash_ids": ("SELECT event_id, substr(md5(concat(CAST(user_id AS STRING), '|', event_type)), 1, 16) AS id FROM {events}", None),
    "log_dedupe": ("SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM {events} GROUP BY user_id, event_type", None),
    "html_paragraphs": ("SELECT page_id, CAST(size(regexp_extract_all(html, '<p[ >]', 0)) AS BIGINT) AS paragraphs FROM {pages}", "SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages"),
}
