"""Pair filters, pair joins and pair scores, in the form of `portable`.

Lines of one order stand for the norms of one candidate group, so groups of pairs stay small
at any size of the tables.
"""

_PAIRS = """
p AS (SELECT a.l_orderkey AS k, a.l_linenumber AS i, b.l_linenumber AS j, a.l_partkey AS pa, b.l_partkey AS pb, a.l_suppkey AS sa, b.l_suppkey AS sb,
a.l_returnflag AS fa, b.l_returnflag AS fb, a.l_linestatus AS la, b.l_linestatus AS lb, a.l_quantity AS qa, b.l_quantity AS qb, a.l_discount AS da, b.l_discount AS db
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"""

SCORING: dict[str, tuple[str, str | None]] = {
    # A null key equals nothing, so such pairs stay.
    "same_article_exclusion": (f"WITH {_PAIRS} SELECT k, i, j FROM p WHERE NOT coalesce(nullif(sa, 0) = nullif(sb, 0) AND fa = fb, false)", None),
    "similarity_floor_link_rescue": (f"WITH {_PAIRS}, link AS (SELECT DISTINCT o_orderkey AS k FROM {{orders}} WHERE o_orderpriority = '1-URGENT') SELECT p.k, p.i, p.j, link.k IS NOT NULL AS linked FROM p LEFT JOIN link ON p.k = link.k WHERE NOT (p.qa > 0 AND p.qb > 0 AND abs(p.qa - p.qb) > 5 AND link.k IS NULL)", None),
    "opposing_family_pairs": (f"WITH {_PAIRS}, f AS (SELECT p_partkey AS pk, CASE WHEN p_size < 15 THEN 1 ELSE 0 END + CASE WHEN p_type LIKE '%BRASS%' THEN 2 ELSE 0 END AS lo, CASE WHEN p_size >= 35 THEN 1 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL%' THEN 2 ELSE 0 END AS hi FROM {{part}}) SELECT p.k, p.i, p.j, (x.lo & y.hi) | (x.hi & y.lo) AS families FROM p JOIN f x ON p.pa = x.pk JOIN f y ON p.pb = y.pk WHERE ((x.lo & y.hi) | (x.hi & y.lo)) <> 0", None),
    "cross_role_flags": (f"WITH {_PAIRS} SELECT k, i, j FROM p WHERE (fa = 'R' AND lb = 'O') OR (fb = 'R' AND la = 'O')", None),
    "dual_reporting": (f"WITH {_PAIRS} SELECT k, i, j, CASE WHEN sa <> sb THEN 'recipient' WHEN qa <> qb THEN 'deadline' ELSE 'one-sided' END AS why FROM p WHERE fa = 'N' AND fb = 'N' AND pa <> pb AND (sa <> sb OR qa <> qb OR (da = 0) <> (db = 0))", None),
    "vertical_pairs": ("SELECT n.n_nationkey, s.s_suppkey FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey WHERE EXISTS (SELECT 1 FROM {region} r WHERE r.r_regionkey = n.n_regionkey AND r.r_name LIKE 'A%')", None),
    "direction_flip": (f"WITH {_PAIRS} SELECT k, least(sa, sb) AS lo, greatest(sa, sb) AS hi, CASE WHEN sa > sb THEN CASE WHEN qa < qb THEN 'hi_narrower' ELSE 'lo_narrower' END ELSE CASE WHEN qa < qb THEN 'lo_narrower' ELSE 'hi_narrower' END END AS direction FROM p WHERE sa <> sb", None),
    "deontic_pair_lookup": (f"WITH {_PAIRS}, d(a, b, score) AS (VALUES ('A', 'A', 0.2), ('A', 'N', 0.5), ('A', 'R', 1.0), ('N', 'N', 0.1), ('N', 'R', 0.8)) SELECT p.k, p.i, p.j, CAST(coalesce(d.score, 0.5) AS DOUBLE) AS score, d.score IS NULL AS neutral FROM p LEFT JOIN d ON d.a = least(p.fa, p.fb) AND d.b = greatest(p.fa, p.fb)", None),
    "action_pair_score": (f"WITH {_PAIRS}, t AS (SELECT p_partkey AS pk, p_type AS lemma, p_brand AS axis, p_size % 5 AS fam FROM {{part}}) SELECT p.k, p.i, p.j, CAST(CASE WHEN x.pk IS NULL OR y.pk IS NULL THEN 0 WHEN x.lemma = y.lemma THEN 1 WHEN x.axis = y.axis THEN 1 WHEN x.fam = y.fam THEN 0.5 ELSE -0.5 END AS DOUBLE) AS score FROM p LEFT JOIN t x ON p.pa = x.pk LEFT JOIN t y ON p.pb = y.pk", None),
    "actor_pair_score": (f"WITH {_PAIRS}, s AS (SELECT s.s_suppkey AS sk, s.s_nationkey AS nk, n.n_regionkey AS rk FROM {{supplier}} s JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey) SELECT p.k, p.i, p.j, CAST(CASE WHEN x.sk IS NULL OR y.sk IS NULL THEN 0 WHEN x.sk = y.sk THEN 1 WHEN x.nk = y.nk THEN 0.7 WHEN x.rk = y.rk THEN 0.2 ELSE -0.25 END AS DOUBLE) AS score FROM p LEFT JOIN s x ON p.sa = x.sk LEFT JOIN s y ON p.sb = y.sk", None),
    "best_actor_pair": (f"WITH {_PAIRS}, s AS (SELECT s_suppkey AS sk, s_nationkey AS nk FROM {{supplier}}), c AS (SELECT p.k, p.sa, p.sb, CASE WHEN p.sa = p.sb THEN 3 WHEN x.nk = y.nk THEN 2 ELSE 1 END AS strength FROM p JOIN s x ON p.sa = x.sk JOIN s y ON p.sb = y.sk), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY strength DESC, sa, sb) AS r FROM c) SELECT k, sa, sb, strength FROM r WHERE r = 1", None),
    "recipient_match_kind": (f"WITH {_PAIRS} SELECT CASE WHEN sa = sb THEN 'same_named' WHEN fa = 'A' OR fb = 'A' THEN 'generic_unresolved' WHEN sa <> sb THEN 'different' ELSE 'unknown' END AS kind, count(*) AS n FROM p GROUP BY 1", None),
    "subtype_router": (f"WITH {_PAIRS} SELECT k, i, j, CASE WHEN qa <> qb AND fa = fb THEN 'deadline' WHEN da <> db AND la = lb THEN 'threshold' WHEN sa <> sb AND fa = 'A' THEN 'competence' WHEN fa <> fb THEN 'polarity' ELSE 'duty' END AS subtype FROM p", None),
    "overlap_strength": (f"WITH {_PAIRS} SELECT k, i, j, CASE WHEN da IS NULL OR db IS NULL THEN NULL WHEN abs(da - db) < 0.011 THEN 'high' WHEN abs(da - db) < 0.041 THEN 'medium' ELSE 'low' END AS strength FROM p", None),
    "geometric_mean_top": (f"WITH {_PAIRS}, g AS (SELECT k, i, j, pa, pb, round(power(greatest(qa / 50, 0) * greatest(qb / 50, 0) * greatest(1 - abs(da - db), 0), 1.0E0 / 3.0E0), 6) AS score FROM p WHERE fa <> fb) SELECT k, i, j, pa, pb, score FROM g ORDER BY score DESC, k, i, j, pa, pb LIMIT 50", None),
    "noisy_or": ("SELECT l_orderkey AS k, round(1 - exp(sum(ln(1 - l_discount))) + 1E-10, 6) AS belief FROM {lineitem} WHERE l_discount < 1 GROUP BY l_orderkey", None),
    "signature_compressed_pairs": ("WITH g AS (SELECT c_nationkey AS doc, c_mktsegment AS sig, count(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment) SELECT a.doc AS doc_a, b.doc AS doc_b, a.sig, CASE WHEN a.doc = b.doc THEN CAST(floor(a.n * (a.n - 1) / 2) AS BIGINT) ELSE a.n * b.n END AS pairs FROM g a JOIN g b ON a.sig = b.sig AND a.doc <= b.doc", None),
    "fixed_group_product": ("SELECT a.n_name AS basis, b.n_name AS safeguard FROM {nation} a CROSS JOIN {nation} b WHERE a.n_regionkey = 0 AND b.n_regionkey IN (1, 2)", None),
    "gold_scope_join": ("WITH g AS (SELECT l.doc_id, d.source FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.toxic = 1) SELECT d.source, count(*) AS n, count(DISTINCT d.lang) AS langs FROM {documents} d WHERE EXISTS (SELECT 1 FROM g WHERE g.source = d.source AND g.doc_id <> d.doc_id) GROUP BY d.source", None),
    "label_cascade": ("WITH c AS (SELECT p_partkey, 1 AS level, p_type AS label FROM {part} WHERE p_type LIKE '%BRASS%' UNION ALL SELECT p_partkey, 2, p_brand FROM {part} WHERE p_size > 25 UNION ALL SELECT p_partkey, 3, 'none' FROM {part}), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY level) AS r FROM c) SELECT p_partkey, level, label FROM r WHERE r = 1", None),
    "triangular_pair_id": ("SELECT i, j, i * n - CAST(floor(i * (i + 1) / 2) AS BIGINT) + j - i - 1 AS pair_id FROM (SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, CAST(25 AS BIGINT) AS n FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey)", None),
    "review_priority": ("WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'conflict' ELSE 'none' END AS v FROM {labels}), b AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'conflict' ELSE 'none' END AS v FROM {labels} WHERE quality < 2) SELECT d.doc_id, CAST(least(5, CASE WHEN d.source IS NULL THEN 1 WHEN a.v = b.v THEN 2 WHEN a.v IS NULL OR b.v IS NULL THEN 3 ELSE 4 END + CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) AS INT) AS priority FROM {documents} d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN b ON d.doc_id = b.doc_id", None),
    "cascade_stratum": (f"WITH {_PAIRS}, s AS (SELECT CASE WHEN fa = 'R' AND fb = 'R' THEN 'S1' WHEN da = db THEN 'S3' WHEN sa = sb THEN 'S4' WHEN qa = qb THEN 'S5' WHEN la <> lb THEN 'S6' ELSE 'S7' END AS stratum FROM p) SELECT stratum, count(*) AS n FROM s GROUP BY stratum", None),
    "cascade_final_verdict": ("WITH first AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'yes' ELSE 'no' END AS v FROM {labels}), second AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS v FROM {labels} WHERE doc_id % 2 = 0) SELECT d.doc_id, coalesce(second.v, CASE WHEN first.v = 'yes' THEN 'RECHECK' ELSE first.v END, 'PENDING') AS verdict FROM {documents} d LEFT JOIN first ON d.doc_id = first.doc_id LEFT JOIN second ON d.doc_id = second.doc_id", None),
}
