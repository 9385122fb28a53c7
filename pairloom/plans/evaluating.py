"""Statistics, sampling, sets, graphs and state, in the form of `portable`."""

#: Score levels of the documents as strata, their sizes and what a labelled sample found in them.
_STRATA = """
s AS (SELECT CASE WHEN d.n_chars < 400 THEN 'short' WHEN d.n_chars < 1200 THEN 'middle' ELSE 'long' END AS h, l.toxic AS y FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id),
h AS (SELECT h, count(*) AS size, count(y) AS n, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS hits FROM s GROUP BY h)"""
_EDGES = """
e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'supplies' AS kind FROM {lineitem}
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'seated' FROM {supplier} UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM {nation})"""

EVALUATING: dict[str, tuple[str, str | None]] = {
    "stratified_proportion": (f"WITH {_STRATA}, t AS (SELECT h.*, size / sum(size) OVER () AS w, hits / n AS p FROM h WHERE n > 1) SELECT round(sum(w * p), 6) AS estimate, round(sum(w * w * (1 - n / size) * p * (1 - p) / (n - 1)), 9) AS variance FROM t", None),
    "newcombe_difference": (f"""WITH {_STRATA}, c AS (SELECT h, n, hits / n AS p, (hits / n + 1.9208 / n) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n) AS half FROM h WHERE n > 0)
SELECT a.h AS h_a, b.h AS h_b, round(a.p - b.p, 6) AS diff, round(a.p - b.p - sqrt(power(a.p - a.mid + a.half, 2) + power(b.mid + b.half - b.p, 2)), 6) AS lo, round(a.p - b.p + sqrt(power(a.mid + a.half - a.p, 2) + power(b.p - b.mid + b.half, 2)), 6) AS hi FROM c a JOIN c b ON a.h < b.h""", None),
    "mix_adjusted_rates": ("WITH s AS (SELECT d.lang AS grp, CASE WHEN d.n_chars < 700 THEN 0 ELSE 1 END AS level, l.quality AS y FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL), w AS (SELECT level, count(*) * 1.0 / sum(count(*)) OVER () AS w FROM s GROUP BY level), r AS (SELECT grp, level, avg(y) AS p FROM s GROUP BY grp, level) SELECT r.grp, round(sum(CAST(w.w AS DOUBLE) * r.p) / sum(CAST(w.w AS DOUBLE)), 4) AS adjusted FROM r JOIN w ON r.level = w.level GROUP BY r.grp", None),
    "expected_half_width": (f"WITH {_STRATA} SELECT h, round(1.96 * sqrt(0.25 / greatest(n, 1)), 6) AS half_width FROM h", None),
    "confusion_matrix": ("SELECT CASE WHEN d.n_chars >= 700 THEN 'long' ELSE 'short' END AS level, sum(CASE WHEN l.quality = 0 THEN 1.0E0 ELSE 0.0E0 END) AS poor, sum(CASE WHEN l.quality = 1 THEN 1.0E0 ELSE 0.0E0 END) AS fair, sum(CASE WHEN l.quality > 1 THEN 1.0E0 ELSE 0.0E0 END) AS good FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY 1", None),
    "gold_outcome": ("WITH f AS (SELECT doc_id, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS found FROM {documents}) SELECT CASE WHEN l.toxic = 1 AND f.found = 1 THEN 'CAUGHT' WHEN l.quality = 0 AND f.found = 1 THEN 'OTHER_TYPE' ELSE 'MISSED' END AS outcome, count(*) AS n FROM {labels} l JOIN f ON l.doc_id = f.doc_id WHERE l.toxic = 1 OR l.quality = 0 GROUP BY 1", None),
    "stored_recheck": ("SELECT count(*) AS n, sum(CASE WHEN n_chars <> length(coalesce(text, '')) THEN 1.0E0 ELSE 0.0E0 END) / count(*) > 0.01 AS fails FROM {documents}", None),
    "flip_rate": ("SELECT o_orderpriority AS arm, count(*) AS n, sum(CASE WHEN (o_totalprice > 150000) <> (o_orderstatus = 'O') THEN 1.0E0 ELSE 0.0E0 END) / count(*) AS flips FROM {orders} GROUP BY o_orderpriority", None),
    "under_extraction": ("WITH u AS (SELECT l_orderkey AS k, count(*) AS points, sum(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END) AS acts FROM {lineitem} GROUP BY l_orderkey) SELECT k, points, acts FROM u WHERE points >= 3 AND acts <= 1", None),
    "label_import": ("WITH new(doc_id, quality) AS (VALUES (0, 2), (1, NULL), (2, 9), (-5, 1)) SELECT l.doc_id, CAST(coalesce(n.quality, l.quality) AS INT) AS quality FROM {labels} l LEFT JOIN new n ON l.doc_id = n.doc_id AND n.quality BETWEEN 0 AND 2", None),
    "label_import_rejects": ("WITH new(doc_id, quality) AS (VALUES (0, 2), (1, NULL), (2, 9), (-5, 1)) SELECT n.doc_id, CASE WHEN n.quality NOT BETWEEN 0 AND 2 THEN 'label' ELSE 'id' END AS why FROM new n WHERE n.quality IS NOT NULL AND (n.quality NOT BETWEEN 0 AND 2 OR NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = n.doc_id))", None),
    # Sampling
    "census_and_sample": ("WITH f AS (SELECT o_custkey AS label, count(*) AS freq FROM {orders} GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, label) AS r, md5('s' || label) AS h FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY r <= 20 ORDER BY h, label) AS q FROM r) SELECT label, freq, CASE WHEN r <= 20 THEN 'census' ELSE 'sample' END AS part FROM s WHERE r <= 20 OR q <= 30", None),
    "round_robin_draw": ("WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('r' || doc_id), doc_id) AS turn FROM {documents}) SELECT doc_id, lang, source, turn FROM r ORDER BY turn, lang, source, doc_id LIMIT 40", None),
    "half_split": ("SELECT doc_id, CASE WHEN substr(md5('h' || doc_id), 32, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'b' ELSE 'a' END AS half FROM {documents}", None),
    # Sets
    "signal_union": ("WITH u AS (SELECT l_orderkey AS k, true AS returned, false AS deep FROM {lineitem} WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, false, true FROM {lineitem} WHERE l_discount >= 0.09) SELECT k, bool_or(returned) AS returned, bool_or(deep) AS deep FROM u GROUP BY k", None),
    "symmetric_difference": ("SELECT 'left' AS side, k FROM (SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) x UNION ALL SELECT 'right', k FROM (SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}) y", None),
    "queue_and_signal_union": ("WITH u AS (SELECT doc_id, 0 AS pri, 'queue' AS src FROM {documents} WHERE n_chars > 600 UNION ALL SELECT doc_id, 1, 'signal' FROM {labels} WHERE toxic = 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pri) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM u) SELECT doc_id, src, n FROM r WHERE r = 1", None),
    # Graph
    "graph_nodes": (f"WITH {_EDGES}, known AS (SELECT 's' || s_suppkey AS node FROM {{supplier}} UNION SELECT 'p' || p_partkey FROM {{part}} UNION SELECT 'n' || n_nationkey FROM {{nation}}), ends AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT ends.node, known.node IS NULL AS out_of_corpus FROM ends LEFT JOIN known ON ends.node = known.node", None),
    "simple_undirected": (f"WITH {_EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst AND kind <> 'supplies'", None),
    "degrees_by_kind": (f"WITH {_EDGES} SELECT src AS node, kind, count(DISTINCT dst) AS n FROM e GROUP BY src, kind", None),
    "citation_count": (f"WITH {_EDGES} SELECT dst AS node, count(DISTINCT src) AS cited_by FROM e GROUP BY dst", None),
    "citation_resolution": (f"WITH {_EDGES} SELECT e.src, coalesce('p' || p.p_partkey, 'instrument:' || substr(e.dst, 1, 1)) AS target FROM e LEFT JOIN {{part}} p ON e.dst = 'p' || p.p_partkey AND p.p_size > 10", None),
    "two_step_closure": (f"WITH {_EDGES}, t AS (SELECT src, dst FROM e WHERE kind <> 'supplies') SELECT src, dst, 1 AS steps FROM t UNION SELECT a.src, b.dst, 2 FROM t a JOIN t b ON a.dst = b.src", None),
    # State
    "resume_pending": ("SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL) AND coalesce(d.n_chars, 0) > 0", None),
    "cache_hits_and_misses": ("WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'v2' ELSE 'v1' END AS version FROM {labels}) SELECT CASE WHEN c.doc_id IS NULL THEN 'miss' WHEN c.version <> 'v2' THEN 'stale' ELSE 'hit' END AS state, count(*) AS n FROM {documents} d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY 1", None),
    "phrase_log_once": ("WITH r AS (SELECT event_id, lower(trim(event_type)) AS phrase, row_number() OVER (PARTITION BY lower(trim(event_type)) ORDER BY ts, event_id) AS r FROM {events}) SELECT phrase, event_id AS first_seen FROM r WHERE r = 1", None),
    "stale_prune": ("SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o_custkey AND c.c_acctbal >= 0)", None),
    "progress_counters": ("SELECT user_id, count(*) AS done, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS accepted, count(CASE WHEN event_type = 'error' THEN 1 END) AS declined FROM {events} GROUP BY user_id", None),
    "public_projection": ("WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) SELECT c.c_custkey, CASE WHEN r.event_type = 'purchase' THEN lower(c.c_name) ELSE c.c_name END AS line, coalesce(r.event_type, 'none') AS decision FROM {customer} c LEFT JOIN r ON c.c_custkey = r.user_id AND r.r = 1 WHERE coalesce(r.event_type, 'none') <> 'error'", None),
}
