"""Guaranteed heavy hitters of groups: the three-phase uniform-threshold protocol over sorted shard lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import read, tune, written

#: A key is heavy with more than 1 / SHARE of its group's weight; bounds are SLACK times as fine.
SHARE, SLACK = 20, 10
#: Lists a group is dealt to.  A summary holds at most 2 * SHARE * SLACK * SHARDS entries (weights not negative).
SHARDS = 16
#: Groups with more than 1 / HOT of all list entries are broadcast with their totals; there are fewer than HOT.
HOT = 1000
#: The width of a group of the stream `user`.
HOURS = 1


def heavy_keys(entries: DataFrame, share: int = SHARE, slack: int = SLACK, shards: int = SHARDS) -> DataFrame:
    """The keys with share * w > T in their groups, and bounds of w from a bounded summary.

    entries: stream string, grp long, item string, weight long, shard long (which of the
    lists 0 .. shards - 1 the entry belongs to; any rule that looks at the row alone).  Each
    shard adds up its entries to lists, sorted by weight.

    1. Totals T go to the shards; each publishes its list down to the uniform threshold
       t = T / (2 * share * slack * shards), floored.
    2. A key of which m lists are missing has low = published (less m * t if the group has negative
       sums) and high = published + m * t; keys with share * high > T survive, at most about 22 a group.
    3. The lists give the surviving keys' exact weights, which decide.

    Result: stream, grp, item, n_entries, total, w, low, estimate, high; share * slack *
    (high - low) <= T wherever T >= 0.  Entries with a null in grp, item or weight drop out, repeated ones
    count again, a null shard is list 0.  A group with a negative total publishes all it has.  An empty table has no groups.  Hot groups:
    no step gathers a group; lists and fetches are dealt by key, totals are joined by broadcast
    for the fewer than 1000 groups that can hold over a thousandth of all, by shuffle for the rest.
    """
    good = entries.filter("stream IS NOT NULL AND grp IS NOT NULL AND item IS NOT NULL AND weight IS NOT NULL")
    lists = good.groupBy("stream", "grp", "item", F.pmod(F.coalesce("shard", F.lit(0)), F.lit(shards)).cast("int").alias("shard"))
    lists = lists.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    lists = written(lists.sortWithinPartitions("stream", "grp", "shard", F.desc("w")), "heavy-lists")
    whole = lists.groupBy("stream", "grp").agg(F.sum("n").alias("n_entries"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("rows"), F.min("w").alias("least"))
    whole = written(whole, "heavy-totals")
    every = whole.agg(F.sum("rows")).first()[0] or 0
    held = whole.withColumn("t", F.floor(F.greatest("total", F.lit(0)) / (2 * share * slack * shards)).cast("long")).withColumn("less", F.expr("if(least < 0, t, 0L)"))
    hot, rest = held.filter(F.col("rows") * HOT > every).drop("rows", "least"), held.filter(F.col("rows") * HOT <= every).drop("rows", "least")

    above = "abs(w) > t OR total < 0"
    cold = lists.join(F.broadcast(hot.select("stream", "grp")), ["stream", "grp"], "left_anti").join(rest.hint("shuffle_hash"), ["stream", "grp"])
    published = lists.join(F.broadcast(hot), ["stream", "grp"]).filter(above).unionByName(cold.filter(above))
    missing = F.lit(shards) - F.count(F.lit(1))
    summary = published.groupBy("stream", "grp", "item", "n_entries", "total").agg(
        (F.sum("w") - missing * F.max("less")).alias("low"),
        (F.sum("w") + missing * F.max("t")).alias("high"),
    )
    survivors = summary.filter(F.col("high") * share > F.col("total"))

    exact = lists.join(survivors.hint("shuffle_hash"), ["stream", "grp", "item"]).groupBy("stream", "grp", "item", "n_entries", "total", "low", "high").agg(F.sum("w").alias("w"))
    heavy = exact.filter(F.col("w") * share > F.col("total"))
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    return heavy.select("stream", "grp", "item", "n_entries", "total", "w", "low", middle.cast("long").alias("estimate"), "high")


class _Number(str):
    """A number as it is written."""


def _no_constant(_: str) -> None:
    raise ValueError("not in the JSON grammar")


#: The first of repeated names counts; numbers stay as written.
_decode = json.JSONDecoder(object_pairs_hook=lambda pairs: dict(reversed(pairs)), parse_float=_Number, parse_int=_Number, parse_constant=_no_constant).decode


def _shown(x: object) -> str:
    """A value inside a list or an object as compact JSON."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_shown(v)}" for k, v in reversed(x.items())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_shown, x)) + "]"
    return x if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)


def _plain(x: object) -> str | None:
    return x if isinstance(x, str) else None if x is None else _shown(x)


def keys_of_props(text: str | None) -> list[str]:
    """os=, tag= and sku= keys of one JSON text; none if any of it is not valid JSON or it is no object."""
    try:
        props = _decode(text) if text else None
        if not isinstance(props, dict):
            return []
        device, tags, items = props.get("device"), props.get("tags"), props.get("items")
        found = [("os=", _plain(device.get("os")))] if isinstance(device, dict) else []
        found += [("tag=", _plain(x)) for x in tags] if isinstance(tags, list) else []
        found += [("sku=", _plain(x.get("sku"))) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
        keys = [a + b for a, b in found if b is not None]
        if text.find("\\u") >= 0:
            _check_halves(props)
        return keys
    except (ValueError, RecursionError):
        return []


def _check_halves(x: object) -> None:
    """Raise on half a surrogate pair anywhere, which is no text."""
    json.dumps(x, ensure_ascii=False).encode()


def _explode_props(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        keys = [keys_of_props(t) for t in b.column("props").to_pylist()]
        again = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("grp").take(again), pa.array([x for k in keys for x in k], pa.string()), b.column("shard").take(again)], names=["grp", "item", "shard"])


def hour_of(ts: Column, kind: T.DataType, hours: int = HOURS) -> Column:
    """floor(ts / hours) since 1970; a timestamp without a zone is read as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        at = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)
    else:
        at = F.floor(F.unix_micros(ts) / 3_600_000_000)
    return F.floor(at / hours).cast("long")


def shop_entries(clicks: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """The entries of the streams user, part and prop; a row's list follows from its ids alone, so reruns agree on every layout."""
    by_click = F.pmod(F.coalesce("click_id", F.lit(0)), F.lit(SHARDS))
    user = clicks.select(F.lit("user").alias("stream"), hour_of(F.col("ts"), clicks.schema["ts"].dataType).alias("grp"), F.col("client_id").cast("string").alias("item"), F.lit(1).cast("long").alias("weight"), by_click.alias("shard"))
    by_line = F.pmod(F.coalesce("sale_id", F.lit(0)) + 5 * F.coalesce("line_no", F.lit(0)), F.lit(SHARDS))
    part = sale_lines.select(F.lit("part").alias("stream"), F.col("vendor_id").cast("long").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("quantity").cast("long").alias("weight"), by_line.alias("shard"))
    props = clicks.filter("client_id IS NOT NULL AND props IS NOT NULL").select(F.col("client_id").cast("long").alias("grp"), "props", by_click.cast("long").alias("shard"))
    prop = props.mapInArrow(_explode_props, "grp long, item string, shard long").select(F.lit("prop").alias("stream"), "grp", "item", F.lit(1).cast("long").alias("weight"), "shard")
    return user.unionByName(part).unionByName(prop)


def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy clients an hour, items a vendor and property values a client; see `heavy_keys`.

    Props: a value that is no text is written as in the JSON text (numbers) or as compact
    JSON; nulls drop out; of repeated names the first counts; a text nested too deeply for the parser has no entry.
    """
    tune(spark)
    return heavy_keys(shop_entries(read(spark, sf_dir, "clicks"), read(spark, sf_dir, "sale_lines")))


ORACLE = f"""
WITH ok AS (SELECT client_id, click_id, props FROM clicks WHERE client_id IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT'),
found AS (
  SELECT client_id, click_id, 'os=' || json_extract_string(props, '$.device.os') AS item FROM ok
  UNION ALL SELECT client_id, click_id, 'tag=' || unnest(json_extract_string(props, '$.tags[*]')) FROM ok
  UNION ALL SELECT client_id, click_id, 'sku=' || unnest(json_extract_string(props, '$.items[*].sku')) FROM ok),
entries AS (
  SELECT 'user' AS stream, floor(epoch_us(ts) / {HOURS * 3_600_000_000}.0)::BIGINT AS grp, client_id::VARCHAR AS item, 1::BIGINT AS weight, coalesce(click_id, 0) % {SHARDS} AS shard FROM clicks
  UNION ALL SELECT 'part', vendor_id, item_id::VARCHAR, quantity, (coalesce(sale_id, 0) + 5 * coalesce(line_no, 0)) % {SHARDS} FROM sale_lines
  UNION ALL SELECT 'prop', client_id, item, 1, coalesce(click_id, 0) % {SHARDS} FROM found),
lists AS (SELECT stream, grp, item, shard, sum(weight)::BIGINT AS w, count(*) AS n FROM entries WHERE grp IS NOT NULL AND item IS NOT NULL AND weight IS NOT NULL GROUP BY ALL),
totals AS (SELECT stream, grp, sum(n)::BIGINT AS n_entries, sum(w)::BIGINT AS total FROM lists GROUP BY ALL),
lines AS (SELECT *, total // {2 * SHARE * SLACK * SHARDS} AS t FROM totals),
keys AS (
  SELECT stream, grp, item, n_entries, total, sum(w)::BIGINT AS w, coalesce(sum(w) FILTER (w > t), 0)::BIGINT AS low,
    coalesce(sum(w) FILTER (w > t), 0)::BIGINT + ({SHARDS} - count(*) FILTER (w > t)) * t AS high
  FROM lists JOIN lines USING (stream, grp) GROUP BY stream, grp, item, n_entries, total, t)
SELECT stream, grp, item, n_entries, total, w, low, (low + high) // 2 AS estimate, high FROM keys WHERE {SHARE} * w > total
"""
