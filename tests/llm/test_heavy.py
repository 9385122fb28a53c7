"""Heavy keys against plain sums, the bounds of the summary, and odd rows."""

import json
import random
from collections import Counter
from datetime import datetime

import duckdb
import pytest

from pairloom.llm import heavy

SCHEMA = "stream string, grp long, item string, weight long, shard long"
DATA = "/root/testdata/sf0.001"


def plain(rows, share=20):
    w, n = Counter(), Counter()
    for s, g, k, v, _ in rows:
        if None not in (s, g, k, v):
            w[s, g, k] += v
            n[s, g] += 1
    total = Counter()
    for (s, g, _), v in w.items():
        total[s, g] += v
    return {(s, g, k): (v, total[s, g], n[s, g]) for (s, g, k), v in w.items() if share * v > total[s, g]}


def check(spark, rows, **how):
    made = heavy.heavy_keys(spark.createDataFrame(rows, SCHEMA), **how).collect()
    share, slack = how.get("share", 20), how.get("slack", 10)
    want = plain(rows, share)
    assert {(r.stream, r.grp, r["item"]): (r.w, r.total, r.n_entries) for r in made} == want and len(made) == len(want)
    for r in made:
        assert r.low <= r.w <= r.high and r.low <= r.estimate <= r.high
        assert share * slack * (r.high - r.low) <= r.total or r.total < 0
    return made


def test_skewed_groups_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [("a", 1 if rng.random() < 0.4 else rng.randrange(60), f"k{int(rng.paretovariate(0.6))}", rng.randrange(50), rng.randrange(-5, 40)) for _ in range(6000)]
    rows += [(None, 1, "x", 1, 1), ("a", None, "x", 1, 1), ("a", 1, None, 9, 1), ("a", 1, "x", None, 1), ("a", 2, "", 3, None), ("b", 1, "k1", 0, 0), ("b", -7, "é", 5, 2)] + [("b", 9, "same", 1, 3)] * 50
    check(spark, rows)
    made = check(spark, rows, share=4, slack=2, shards=3)
    assert any(r.high > r.low for r in made)  # some lists were missing, so the summary was not the whole


def test_negative_weights_keep_the_bounds(spark):
    rng = random.Random(2)
    check(spark, [("a", rng.randrange(4), f"k{rng.randrange(40)}", rng.randrange(-20, 90), rng.randrange(16)) for _ in range(3000)])
    check(spark, [("a", 1, "x", -5, 0), ("a", 1, "y", 2, 1)])


def test_no_rows(spark):
    assert heavy.heavy_keys(spark.createDataFrame([], SCHEMA)).count() == 0


def test_summary_is_bounded(spark):
    rows = [("a", 1, f"k{i}", 1, i % 16) for i in range(30_000)] + [("a", 1, "big", 9000, i) for i in range(16)]
    (r,) = check(spark, rows)
    assert r["item"] == "big"


@pytest.mark.parametrize("text", ['{"a": 1} x', '{"a": 1', "{'a': 1}", '{"a": NaN}', '{"device": {"os": "w"}, "t": 01}', '{"device": {"os": "w"}},{"a":1}', '{"device": {"os": "w"}, "a": "\\ud800"}', "[1]", "3", '"x"', "null", "", None, "[" * 100_000])
def test_no_keys_of_what_is_no_object(text):
    assert heavy.keys_of_props(text) == []


def test_keys_of_props():
    keys = heavy.keys_of_props(' {"k": 1, "device": {"os": "web"}, "tags": ["a", "a", null, 7, 1.50, true, [1, "é"], {"x": 1e3}], "items": [{"sku": 12, "qty": 1}, {"sku": null}, {}, 5, {"sku": "s"}]}\n')
    assert keys == ["os=web", "tag=a", "tag=a", "tag=7", "tag=1.50", "tag=true", 'tag=[1,"é"]', 'tag={"x":1e3}', "sku=12", "sku=s"]
    assert heavy.keys_of_props('{"device": "web", "tags": "a", "items": {"sku": 1}}') == []
    assert heavy.keys_of_props('{"device": {"os": "a"}, "device": {"os": "b"}}') == ["os=a"]


def test_entries_of_the_shop(spark):
    clicks = [(1, datetime(2024, 3, 31, 2, 30), 5, json.dumps({"tags": ["b"]})), (None, datetime(1969, 12, 31, 23, 59), 5, "{"), (3, None, None, '{"tags": ["c"]}')]
    c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, props string").withColumns({"grp": heavy.F.lit(1), "item": heavy.F.lit("clash")})
    lines = spark.createDataFrame([(1, 1, 7, 3, 4), (1, None, None, 3, 4), (None, 2, 7, None, None)], "sale_id long, line_no int, item_id long, vendor_id long, quantity int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour that this zone does not have
        got = {(r.stream, r.grp, r["item"], r.weight) for r in heavy.shop_entries(c, lines).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert ("user", 475514, "5", 1) in got and ("user", -1, "5", 1) in got and ("part", 3, "7", 4) in got
    assert {x for x in got if x[0] == "prop"} == {("prop", 5, "tag=b", 1)}


def test_query_equals_its_sql(spark):
    got = heavy.heavy_hitters(spark, DATA).collect()
    con = duckdb.connect()
    for t in ("clicks", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(heavy.ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cur.fetchall())
