"""Multi-party dialogues: the same talk rendered once from each speaker's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, rendered and spans, a row for each speaker of a conversation.

    turns has conv_id, turn, role (the speaker's name) and text.  From a speaker's side their
    own turns are the assistant's, all others are those of a user of that name, and system
    turns stay as they are:

        <|im_start|>assistant\\n TEXT <|im_end|>\\n
        <|im_start|>user name=ROLE\\n TEXT <|im_end|>\\n

    No text or name can open or close a turn: `<|` in them is written `< |`, and each line break of a name a space.

    spans are the (start, stop) code points that training should see: the text and the
    end mark of each of the speaker's own turns.  Turns stand by turn, then role, then text;
    a null turn comes first.  A null role is a speaker of its own, without
    a name (speaker null, `<|im_start|>user\\n`); a null text is empty.
    Turns of null conv_id belong to no conversation and are left out; a conversation of
    system turns alone has no speaker and gives no row; repeated rows are turns of their own.
    Other columns are left out.  Offsets are running sums over a conversation's turns, so no
    more than one rendered dialogue is ever gathered.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    system = F.col("role").eqNullSafe(F.lit(SYSTEM))
    speakers = rows.filter(~system).select("conv_id", F.col("role").alias("speaker")).distinct()
    own = F.col("role").eqNullSafe(F.col("speaker"))
    name = F.coalesce(F.concat(F.lit(" name="), safe(F.translate("role", "\r\n", "  "))), F.lit(""))
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(system, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user"), name, F.lit("\n")))
    order = Window.partitionBy("conv_id", "speaker").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sides = rows.join(speakers, "conv_id").withColumn("own", own).withColumn("head", head)
    sides = sides.withColumn("piece", F.concat("head", "text", F.lit("<|im_end|>\n"))).withColumn("seq", F.row_number().over(order))
    end = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("conv_id", "speaker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    sides = sides.withColumn("stop", end - 1).withColumn("start", F.col("stop") + 1 - F.length("piece") + F.length("head"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece", "own", "start", "stop")))
    out = sides.groupBy("conv_id", "speaker").agg(pieces.alias("p"))
    mine = F.filter("p", lambda x: x["own"])
    return out.select(
        "conv_id",
        "speaker",
        F.size("p").cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_own"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"),
        F.transform(mine, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"),
    )


def rotate_conversations(turns: DataFrame) -> DataFrame:
    """The rotation with its spans as text, start:stop joined by commas."""
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return rotate(turns).select("conv_id", "speaker", "n_turns", "n_own", "rendered", spans.alias("spans"))


ORACLE = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
r AS (SELECT t.*, s.speaker, t.role IS NOT DISTINCT FROM s.speaker AS own,
        CASE WHEN t.role IS NOT DISTINCT FROM s.speaker THEN '<|im_start|>assistant' || chr(10) WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user' || coalesce(' name=' || replace(translate(t.role, chr(13) || chr(10), '  '), '<|', '< |'), '') || chr(10) END AS head,
        row_number() OVER (PARTITION BY t.conv_id, s.speaker ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text) AS seq
      FROM t JOIN s ON t.conv_id = s.conv_id),
p AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM r),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS stop FROM p)
SELECT conv_id, speaker, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own,
  string_agg(piece, '' ORDER BY seq) AS rendered,
  coalesce(string_agg(CAST(stop + 1 - length(piece) + length(head) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY seq) FILTER (WHERE own), '') AS spans
FROM o GROUP BY conv_id, speaker
"""
