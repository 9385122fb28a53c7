"""Two extractions of the same units: aligned one to one, compared field by field, and resolved without losing a reading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

#: The deontic types that detection takes up.
ACTIONABLE = ("OBLIGATION", "PROHIBITION", "PERMISSION", "COMPETENCE", "EXEMPTION")
#: How each field of a norm is compared.
FIELDS = {"deontic": "same", "actor": "text", "action_lemma": "lemma", "object": "text", "trigger_event": "text", "deadline_raw": "deadline", "recipient": "list", "thresholds": "list", "conditions": "list"}
#: Least share of the smaller word set that spans must have in common.
LEAST = 0.5


def by_place(*unit: str, order: str = "k") -> WindowSpec:
    """The window that numbers the readings of a unit."""
    return Window.partitionBy(*unit).orderBy(order)


def word_set(c: Column) -> Column:
    """The distinct words of a text after normalising; none of null."""
    return F.array_distinct(F.array_remove(F.split(T.normalise(F.coalesce(c, F.lit(""))), " "), ""))


def list_words(c: Column) -> Column:
    """The distinct words of all items of a list of texts."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), word_set)))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set that both have; 1 of two empty ones, 0 of one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def comparable(kind: str, c: Column) -> Column:
    """What of a field is compared: itself (`same`), its normalised text (`lemma`), its words (`text`, `list`) or what it parses to (`deadline`)."""
    plain = T.normalise(F.coalesce(c, F.lit(""))) if kind in ("lemma", "deadline") else None
    if kind == "deadline":
        d = T.deadline(c)
        return F.struct(d.isNotNull().alias("there"), d["value"].alias("value"), d["unit"].alias("unit"), plain.alias("raw"), F.coalesce(T.deadline_start(c), F.lit("")).alias("since"))
    return {"same": lambda: c, "lemma": lambda: plain, "text": lambda: word_set(c), "list": lambda: list_words(c)}[kind]()


def agrees(kind: str, a: Column, b: Column) -> Column:
    """Whether two comparable readings of a field agree; deadlines that give no number agree as texts."""
    if kind in ("same", "lemma"):
        return a.eqNullSafe(b)
    if kind == "deadline":
        bare = a["value"].isNull() & b["value"].isNull()
        return F.when(~a["there"] | ~b["there"], a["there"] == b["there"]).when(bare, a["raw"] == b["raw"]).otherwise(a["value"].eqNullSafe(b["value"]) & (a["unit"] == b["unit"]) & (a["since"] == b["since"]))
    return overlap(a, b) >= LEAST


def align(first: DataFrame, second: DataFrame, unit: Sequence[str], *, pos: str = "pos", fields: Mapping[str, str] = FIELDS, deontic: str = "deontic", lemma: str = "action_lemma", spans: Sequence[str] = ("object", "actor", "trigger_event")) -> DataFrame:
    """Each unit's readings of two passes, one to one: unit, norm_index, one, two, score, diffs.

    A pair scores 1 for the same deontic, 1 for the same lemma (if there is one) and the overlap
    of each of `spans` that both have.  The best pairs go first, ties to the lesser position in the
    first list, then in the second; a reading is taken once, and pairs that score 0 never.  What
    is left stands alone, `one` or `two` null, the first list's before the second's.  one and two are structs of pos and
    fields; diffs names the fields that disagree, in the order of fields (null for one alone).
    norm_index counts from 0 in that order.  Null units match each other.

    A unit is a passage, read twice: its pairs are made and chosen together.  Readings are few
    there, and work grows with the product of its two lists.
    """
    columns = [F.col(pos).cast("long").alias("pos"), *[F.col(f) for f in fields]]
    ready = [comparable(k, F.col(f)).alias(f"c_{f}") for f, k in fields.items()]  # once a reading, not once a pair
    sides = [df.select(*unit, F.struct(*columns, *ready).alias("r")).groupBy(*unit).agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("r")) for df in (first, second)]
    kind = sides[0].schema["r"].dataType.simpleString()
    on = None
    for u in unit:
        same = F.col(f"a.{u}").eqNullSafe(F.col(f"b.{u}"))
        on = same if on is None else on & same
    none = F.array().cast(kind)
    both = sides[0].alias("a").join(sides[1].alias("b"), on, "full").select(*[F.coalesce(f"a.{u}", f"b.{u}").alias(u) for u in unit], F.coalesce("a.r", none).alias("ones"), F.coalesce("b.r", none).alias("twos"))

    def score(a: Column, b: Column) -> Column:
        x, y = a[f"c_{lemma}"], b[f"c_{lemma}"]
        total = F.when(a[deontic].eqNullSafe(b[deontic]), 1.0).otherwise(0.0) + F.when((x != "") & (x == y), 1.0).otherwise(0.0)
        for f in spans:
            wa, wb = a[f"c_{f}"], b[f"c_{f}"]
            total = total + F.when((F.size(wa) > 0) & (F.size(wb) > 0), overlap(wa, wb)).otherwise(0.0)
        return total

    pairs = F.flatten(F.transform("ones", lambda a, i: F.transform("twos", lambda b, j: F.struct((-score(a, b)).alias("less"), i.alias("i"), j.alias("j")))))
    sorted_ = F.array_sort(F.filter(pairs, lambda p: p["less"] < 0))
    start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"), F.array().cast("array<struct<less:double,i:int,j:int>>").alias("taken"))
    step = lambda s, p: F.when(F.array_contains(s["i"], p["i"]) | F.array_contains(s["j"], p["j"]), s).otherwise(F.struct(F.array_append(s["i"], p["i"]).alias("i"), F.array_append(s["j"], p["j"]).alias("j"), F.array_append(s["taken"], p).alias("taken")))
    chosen = both.withColumn("pairs", sorted_).withColumn("t", F.aggregate("pairs", start, step))
    gone = F.lit(None).cast("int")
    alone = lambda c, used, left: F.transform(F.filter(F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>")), lambda k: ~F.array_contains(used, k)), lambda k: F.struct(F.lit(None).cast("double").alias("less"), (k if left else gone).alias("i"), (gone if left else k).alias("j")))
    rows = F.concat(F.col("t.taken"), alone(F.col("ones"), F.col("t.i"), True), alone(F.col("twos"), F.col("t.j"), False))
    flat = chosen.select(*unit, "ones", "twos", F.posexplode(rows).alias("norm_index", "p"))
    out = flat.select(*unit, "norm_index", F.get("ones", F.col("p.i")).alias("one"), F.get("twos", F.col("p.j")).alias("two"), (-F.col("p.less")).alias("score"))
    diffs = F.array_compact(F.array(*[F.when(~agrees(k, F.col(f"one.c_{f}"), F.col(f"two.c_{f}")), F.lit(f)) for f, k in fields.items()]))
    out = out.withColumn("diffs", F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), diffs))
    bare = [f"c_{f}" for f in fields]
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c).dropFields(*bare)) for c in ("one", "two")})


def resolve(aligned: DataFrame, unit: Sequence[str], *, fields: Mapping[str, str] = FIELDS, deontic: str = "deontic", actionable: Sequence[str] = ACTIONABLE) -> DataFrame:
    """One norm for each aligned row, so that no reading is lost: unit, norm_index, fields, uncertain, reason, alternative, deontic_alternative.

    Where two readings differ, the one whose deontic is actionable stands (the first of both or
    none are) and the other is kept in `alternative`; its deontic also in
    deontic_alternative if it is another.  A reading of one pass alone stands, uncertain.  reason
    is `agreed`, `passes disagreed` or `found by one of two passes`.
    """
    able = lambda c: F.coalesce(c[deontic].isin(*actionable), F.lit(False))
    one, two = F.col("one"), F.col("two")
    # The first stands unless only the second can be taken up, or the first is missing.
    second = one.isNull() | (two.isNotNull() & able(two) & ~able(one))
    base, other = F.when(second, two).otherwise(one), F.when(second, one).otherwise(two)
    lone = one.isNull() | two.isNull()
    differ = ~lone & (F.size("diffs") > 0)
    out = aligned.select(*unit, "norm_index", base.alias("base"), F.when(differ, other).alias("alternative"), F.when(~lone & ~other[deontic].eqNullSafe(base[deontic]), other[deontic]).alias("deontic_alternative"), (lone | differ).alias("uncertain"), F.when(lone, "found by one of two passes").when(differ, "passes disagreed").otherwise("agreed").alias("reason"))
    return out.select(*unit, "norm_index", *[F.col(f"base.{f}").alias(f) for f in fields], "uncertain", "reason", "alternative", "deontic_alternative")


def resolve_queue(queue: DataFrame, first: DataFrame, second: DataFrame, unit: Sequence[str], *, pos: str = "pos", fields: Mapping[str, str] = FIELDS, **how: object) -> tuple[DataFrame, DataFrame]:
    """The norms of a review queue and the units that stay unresolved.

    queue: unit, located, grounded_1 and grounded_2 (whether that pass gave a result that its text bears
    out).  Units with two results are aligned and resolved; of one alone its norms stand,
    uncertain, with the reason `single grounded pass`.  Dropped, with a drop_reason: units not located
    (`provision_not_relocated`), without a result (`no_grounded_pass`), or with one that is empty (`single_pass_empty_unconfirmed`).
    """
    keyed = lambda df, want: df.join(queue.filter(want).select(*unit), list(unit), "left_semi")
    here = F.coalesce("located", F.lit(False))
    g1, g2 = F.coalesce("grounded_1", F.lit(False)), F.coalesce("grounded_2", F.lit(False))
    two = resolve(align(keyed(first, here & g1 & g2), keyed(second, here & g1 & g2), unit, pos=pos, fields=fields, **how), unit, fields=fields)
    single = keyed(first, here & g1 & ~g2).select(*unit, pos, *fields).unionByName(keyed(second, here & ~g1 & g2).select(*unit, pos, *fields))
    found = single.select(*unit).distinct().withColumn("any", F.lit(True))
    # Positions count from 0 in a unit of one pass, whatever they were.
    listed = single.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).cast("long").alias("pos"), *fields)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("r"))
    alone = listed.select(*unit, F.posexplode("r").alias("norm_index", "base")).select(*unit, "norm_index", *[F.col(f"base.{f}").alias(f) for f in fields], F.lit(True).alias("uncertain"), F.lit("single grounded pass").alias("reason"), F.lit(None).cast(two.schema["alternative"].dataType).alias("alternative"), F.lit(None).cast("string").alias("deontic_alternative"))
    why = F.when(~here, "provision_not_relocated").when(~g1 & ~g2, "no_grounded_pass").when((g1 != g2) & F.col("any").isNull(), "single_pass_empty_unconfirmed")
    dropped = queue.join(found, list(unit), "left").withColumn("drop_reason", why).filter("drop_reason IS NOT NULL").select(*unit, "drop_reason")
    return two.unionByName(alone), dropped
