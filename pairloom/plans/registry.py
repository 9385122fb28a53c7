"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from ..operators import ranks as K
from ..operators import review as R
from ..operators.steady import steady
from ..sources import TABLES, table
from .evaluating import EVALUATING
from .laws import LAW_ORACLES, LAW_QUERIES
from .norms import NORM_ORACLES, NORM_QUERIES
from .portable import PORTABLE
from .scoring import SCORING
from .shaping import SHAPING
from .texts import TEXT_ORACLES, TEXT_QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _checking(sql: str, oracle: str | None) -> str:
    return (oracle or sql).replace("{", "").replace("}", "")


def _once(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no two documents have one id, so that each of their keys is there once."""
    return table(spark, sf_dir, "documents").groupBy("doc_id").count().filter("count > 1").isEmpty()


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("owner"), "lang", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("key"))


_KEYS_SQL = """
k AS (SELECT DISTINCT doc_id AS owner, lang, key FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+')) AS key FROM documents) WHERE length(key) >= 4),
n AS (SELECT count(DISTINCT owner) AS n FROM k),
spec AS (SELECT key, count(*) AS df, round(1 - ln(1 + count(*)) / ln(1 + (SELECT n FROM n)), 6) AS specificity FROM k GROUP BY key)"""


@query(f"""WITH {_KEYS_SQL},
p AS (SELECT k.owner, k.lang, k.key, s.specificity FROM k JOIN spec s ON k.key = s.key WHERE s.df >= 2)
SELECT i, j, count(*) AS shared, max(specificity) AS score, substr(md5(i || '|' || j), 1, 16) AS pair
FROM (SELECT a.owner AS i, b.owner AS j, a.specificity FROM p a JOIN p b ON a.key = b.key AND a.owner < b.owner AND a.lang <> b.lang)
GROUP BY i, j ORDER BY score DESC, pair LIMIT 20""")
def related_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.most_related(_keys(spark, sf_dir), 20, "lang", _once(spark, sf_dir))


@query(f"WITH {_KEYS_SQL} SELECT key, df, specificity FROM spec")
def key_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_specificity(_keys(spark, sf_dir), once=_once(spark, sf_dir))


@query(f"""WITH {_KEYS_SQL}, p AS (SELECT k.owner, k.key, s.specificity FROM k JOIN spec s ON k.key = s.key WHERE s.df >= 2 AND s.specificity >= 0.7)
SELECT a.owner AS i, b.owner AS j, count(*) AS shared, max(a.specificity) AS score FROM p a JOIN p b ON a.key = b.key AND a.owner < b.owner GROUP BY a.owner, b.owner""")
def inverted_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a score of at least 0.7; shared counts the keys that reach it."""
    return P.inverted_index_pairs(_keys(spark, sf_dir), min_score=0.7, once=_once(spark, sf_dir))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"""SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label) WHERE sim >= 0.3""")
def all_pairs_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.floor_pairs(table(spark, sf_dir, "embeddings"), 0.3)


@query(f"""WITH s AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same, round({_COS}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i, same ORDER BY sim DESC, j) AS INTEGER) AS rank FROM s)
SELECT i, j, same, rank FROM r WHERE rank <= CASE WHEN same THEN 3 ELSE 8 END AND sim > 0""")
def knn_two_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.knn_two_budgets(table(spark, sf_dir, "embeddings"), 3, 8).select("i", "j", "same", "rank")


@query(f"""WITH {_KEYS_SQL}, u AS (SELECT k.owner, k.key, s.specificity AS weight FROM k JOIN spec s ON k.key = s.key WHERE s.df >= 2 AND s.specificity >= 0.7),
b AS (SELECT a.owner AS i, b.owner AS j, a.key AS unit, least(a.weight, b.weight) AS w FROM u a JOIN u b ON a.key = b.key AND a.owner < b.owner)
SELECT i, j, unit, w FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY w DESC, unit) AS r FROM b) WHERE r = 1""")
def best_unit_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    spec = P.key_specificity(keys, once=_once(spark, sf_dir)).filter("df >= 2 AND specificity >= 0.7").drop("df")
    return P.best_unit_pair(steady(keys.select("owner", "key").join(spec, "key").withColumn("weight", F.col("specificity"))))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
c AS (SELECT i, j, count(*) AS common FROM p JOIN e a ON a.src = i JOIN e b ON b.src = j AND b.dst = a.dst GROUP BY ALL),
d AS (SELECT p.i, p.j, count(e.src) > 0 AS direct FROM p LEFT JOIN e ON (src = p.i AND dst = p.j) OR (src = p.j AND dst = p.i) GROUP BY ALL)
SELECT d.i, d.j, direct, coalesce(common, 0) AS common, direct OR coalesce(common, 0) > 0 AS linked FROM d LEFT JOIN c ON c.i = d.i AND c.j = d.j""")
def adjacency_common_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation as candidates: who delivers the same parts."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("group"))
    return P.connected_groups(nodes, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("SELECT p_partkey, round(count(*) OVER (ORDER BY p_retailprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / count(*) OVER (), 6) AS rank_le FROM part")
def percentile_rank_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.share_up_to(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("rank_le", 6).alias("rank_le"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority")
def interp_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.9], "o_orderpriority").select("o_orderpriority", F.round("quantile", 4).alias("p90"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, md5(CAST(s_suppkey AS VARCHAR))) AS INT) AS place FROM supplier")
def global_sort_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return K.placed(rows, [F.desc("s_acctbal"), F.md5(F.col("s_suppkey").cast("string"))]).select("s_suppkey", F.col("place").cast("int").alias("place"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity::DOUBLE), 6) AS mean, round(stddev_pop(l_quantity::DOUBLE), 6) AS std, min(l_quantity::DOUBLE) AS least, max(l_quantity::DOUBLE) AS most, round(quantile_cont(l_quantity::DOUBLE, 0.01), 6) AS p1, round(quantile_cont(l_quantity::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(l_quantity::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(l_quantity::DOUBLE, 0.2), 6) AS p20, round(quantile_cont(l_quantity::DOUBLE, 0.25), 6) AS p25, round(quantile_cont(l_quantity::DOUBLE, 0.3), 6) AS p30, round(quantile_cont(l_quantity::DOUBLE, 0.4), 6) AS p40, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_quantity::DOUBLE, 0.6), 6) AS p60, round(quantile_cont(l_quantity::DOUBLE, 0.7), 6) AS p70, round(quantile_cont(l_quantity::DOUBLE, 0.75), 6) AS p75, round(quantile_cont(l_quantity::DOUBLE, 0.8), 6) AS p80, round(quantile_cont(l_quantity::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(l_quantity::DOUBLE, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.described(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")
    return out.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in K.PERCENTILES])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id, event_type FROM r WHERE r = 1 AND event_type <> 'error'""")
def latest_decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return out.select("user_id", "event_id", "event_type")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS size FROM documents)
SELECT doc_id, source, size, round(least(1.0, 5.0 / size), 6) AS probability FROM r WHERE r <= 5""")
def hash_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.stratified_sample(docs, "source", "doc_id", 5).select("doc_id", "source", "size", "probability")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS verdict FROM orders""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("verdict"))
    return R.cache_upsert(old, old.filter("o_orderkey % 10 = 0").withColumn("verdict", F.lit("new")), "o_orderkey")


def _top_tier(posted: DataFrame, budget: int, cap: int, minimum: float) -> DataFrame:
    """The greedy top tier and its ties among the pairs of posted keys, those of the fewest owners first: whole once its cut-off is above the score of any key unread."""
    most = 4
    while True:
        top = R.greedy_budget_cap(steady(P.meeting(posted, "lang", most=most)), budget, cap, minimum)
        found = top.collect()  # at most 1.1 budgets
        unread = posted.filter(F.col("df") > most).agg(F.max("specificity")).first()[0]
        if unread is None or (len(found) >= budget and found[budget - 1]["score"] > unread + 1e-8):
            return top
        most *= 2


def review_queue(keys: DataFrame, budget: int, cap: int, minimum: float, calibration: int, once: bool = False) -> DataFrame:
    """i, j, score, rank, selection and band: the greedy top tier, its ties, and a sample of the pairs not taken.

    All pairs that reach the minimum take part, but few are made: the top tier reads the keys of
    the fewest owners first (`_top_tier`); the sample is of the least keys, so pairs of greater ones need not be counted.
    """
    spark = keys.sparkSession
    posted = steady(P.postings(keys, "lang", min_score=minimum, once=once))  # read by every pass
    top = _top_tier(posted, budget, cap, minimum).collect()  # at most 1.1 budgets
    taken = {(r["i"], r["j"]) for r in top}
    for bits in (50, 56, 63):
        least = None if bits == 63 else R.sample_key() < F.lit(-(1 << 63) + (1 << bits))
        rest = P.meeting(posted, "lang", only=least)
        if taken:
            gone = spark.createDataFrame(sorted(taken), "i long, j long")
            rest = rest.join(F.broadcast(gone), ["i", "j"], "left_anti")  # at most 1.1 budgets
        sample = R.calibration_sample(rest, calibration, [minimum])
        if len(sample) == calibration:
            break
    rows = [(*r, None) for r in top] + [(i, j, score, None, "calibration", f">= {minimum} (not selected)") for i, j, score, _ in sample]
    return spark.createDataFrame(rows, "i long, j long, score double, rank int, selection string, band string")


@query()
def greedy_budget_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(_keys(spark, sf_dir), 200, 3, 0.5, 6, _once(spark, sf_dir))


@query(f"""WITH RECURSIVE {_KEYS_SQL}, p AS (SELECT k.owner, k.lang, k.key, s.specificity FROM k JOIN spec s ON k.key = s.key WHERE s.df >= 2 AND s.specificity >= 0.7),
x AS (SELECT i, j, max(specificity) AS score FROM (SELECT a.owner AS i, b.owner AS j, a.specificity FROM p a JOIN p b ON a.key = b.key AND a.owner < b.owner AND a.lang <> b.lang) GROUP BY i, j),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5(i || '|' || j), i, j) AS r FROM x),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS used, 0 AS n, 0.0::DOUBLE AS cut, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS score, false AS ok
UNION ALL SELECT o.r, CASE WHEN t.ok THEN g.used || [o.i, o.j] ELSE g.used END, g.n + t.ok::INT, CASE WHEN t.ok AND g.n < 40 THEN o.score ELSE g.cut END, o.i, o.j, o.score, t.ok
FROM g JOIN o ON o.r = g.r + 1 AND (g.n < 40 OR (g.n < 44 AND g.cut - o.score < 1e-9)), LATERAL (SELECT len(list_filter(g.used, lambda y: y = o.i)) < 3 AND len(list_filter(g.used, lambda y: y = o.j)) < 3 AS ok) t)
SELECT i, j, score, n AS rank, CASE WHEN n <= 40 THEN 'top' ELSE 'tie_extension' END AS selection FROM g WHERE ok""")
def greedy_top_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 40 pairs of different languages with at most three an owner, and those tied with the last."""
    return _top_tier(steady(P.postings(_keys(spark, sf_dir), "lang", min_score=0.7, once=_once(spark, sf_dir))), 40, 3, 0.7)


@query(_checking(*PORTABLE["scope_overlap"]))
def scope_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment whose balances are less than 50 apart; only those in one range of balances or the next meet."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    return P.near_pairs(c, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal", 50)


@query(_checking(*SHAPING["burden_counts"]))
def burden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_partkey")
    return K.distinct_counts(lines, "l_orderkey", {"recipients": "l_suppkey", "deadlines": "l_quantity", "instruments": "l_partkey"}, 2)


@query(_checking(*SCORING["best_actor_pair"]))
def best_actor_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order are met once, as its array, and of their pairs only the best so far is kept."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s_suppkey")).filter("k IS NOT NULL AND n IS NOT NULL")
    known = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    orders = known.groupBy("k").agg(F.collect_list(F.struct("n", F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nk"))).alias("of"))
    strength = "CASE WHEN x.s = y.s THEN 3 WHEN x.nk = y.nk THEN 2 ELSE 1 END"
    pair = f"named_struct('less', -({strength}), 'sa', x.s, 'sb', y.s)"
    none = "CAST(NULL AS STRUCT<less: INT, sa: BIGINT, sb: BIGINT>)"
    best = F.expr(f"aggregate(of, {none}, (b, x) -> aggregate(filter(of, y -> y.n > x.n), b, (c, y) -> CASE WHEN c IS NULL OR {pair} < c THEN {pair} ELSE c END))")
    return orders.withColumn("b", best).filter("b IS NOT NULL").select("k", "b.sa", "b.sb", (-F.col("b.less")).alias("strength"))


_WAYS = """CASE o_orderkey % 6 WHEN 0 THEN 'binnen ' || o_custkey % 90 || ' uur nadat hij kennis kreeg' WHEN 1 THEN 'Uiterlijk drie  dagen' WHEN 2 THEN 'onverwijld' WHEN 3 THEN 'zo spoedig mogelijk' WHEN 4 THEN 'vier jaar ervaring' ELSE 'binnen 72 uur en binnen 4 weken' END"""


@query(f"""SELECT phrase, CASE way WHEN 0 THEN k::DOUBLE WHEN 1 THEN 3 WHEN 5 THEN 72 END AS value, CASE way WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 5 THEN 'hour' ELSE 'undelayed' END AS unit, count(*) AS n
FROM (SELECT {_WAYS} AS phrase, o_orderkey % 6 AS way, o_custkey % 90 AS k FROM orders) WHERE way <> 4 GROUP BY ALL""")
def deadline_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines as orders word them, each phrase parsed once."""
    phrases = table(spark, sf_dir, "orders").select(F.expr(_WAYS).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return phrases.withColumn("d", T.deadline(F.col("phrase"))).filter("d is not null").select("phrase", "d.value", "d.unit", "n")


_SUMS = """CASE o_orderkey % 5 WHEN 0 THEN o_custkey || ' 000 EUR' WHEN 1 THEN '€ ' || o_custkey || '.000,-' WHEN 2 THEN o_custkey || ',5 euro' WHEN 3 THEN o_custkey % 100 || ' % van de totale wereldwijde jaaromzet' ELSE 'betrouwbaarheidsniveau hoog' END"""


@query(f"""SELECT phrase, CASE way WHEN 0 THEN 1000.0 * k WHEN 1 THEN 1000.0 * k WHEN 2 THEN k + 0.5 ELSE k % 100 END::DOUBLE AS value, CASE way WHEN 3 THEN 'percent' ELSE 'eur' END AS kind, count(*) AS n
FROM (SELECT {_SUMS} AS phrase, o_orderkey % 5 AS way, o_custkey AS k FROM orders) WHERE way <> 4 GROUP BY ALL""")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as orders word them, each phrase parsed once."""
    phrases = table(spark, sf_dir, "orders").select(F.expr(_SUMS).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return phrases.withColumn("a", T.amount(F.col("phrase"))).filter("a is not null").select("phrase", "a.value", "a.kind", "n")


def _portable(name: str, sql: str, oracle: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
        return spark.sql(sql, **used)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _checking(sql, oracle)


for _name, (_sql, _oracle) in {**PORTABLE, **SCORING, **EVALUATING, **SHAPING}.items():
    if _name not in QUERIES:  # those above run otherwise than their text, which checks them
        _portable(_name, _sql, _oracle)

QUERIES.update(NORM_QUERIES)
ORACLES.update(NORM_ORACLES)
QUERIES.update(LAW_QUERIES)
ORACLES.update(LAW_ORACLES)
QUERIES.update(TEXT_QUERIES)
ORACLES.update(TEXT_ORACLES)
