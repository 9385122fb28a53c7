"""The stream of decisions against the whole log at once."""

import random

from pairloom.streaming import decisions as D

LOG = "user string, thing long, at long, seq long, verdict string, owner string"


def test_state_of_a_stream_with_withdrawals(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["u1", "u2", None]), rng.randrange(12), rng.randrange(30), i, rng.choice(["yes", "no", None]), "clash") for i in range(400)]
    rows += [("u1", 99, 5, 1, "a", ""), ("u1", 99, 5, 1, "b", ""), ("u2", 99, 5, 1, None, ""), ("u2", 99, 5, 1, "kept", ""), ("u1", None, 1, 1, "x", ""), ("u1", 1, None, 1, "x", "")]
    source, home = tmp_path / "log", str(tmp_path / "home")
    cut = [rows[:150], rows[150:151], rows[151:]]
    want = {}
    for u, k, at, seq, v, _ in rows:
        if None not in (u, k, at, seq):
            want[u, str(k)] = max(want.get((u, str(k)), (-1, -1, "")), (at, seq, v or ""))
    want = {k: v for k, v in want.items() if v[2]}
    for n, part in enumerate(cut):  # each run goes on where the one before stopped
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
        D.keep_state(D.entries(stream, "user", "thing", "at", "seq", "verdict"), home)
        if n == 1:
            D.keep_state(D.entries(stream, "user", "thing", "at", "seq", "verdict"), home)  # nothing new
    shown = lambda df: {(r.owner, r["item"]): (r["at"], r.seq, r.verdict) for r in df.collect()}
    assert shown(D.current_state(spark, home)) == want
    assert shown(D.batch_state(D.entries(spark.createDataFrame(rows, LOG), "user", "thing", "at", "seq", "verdict"))) == want
