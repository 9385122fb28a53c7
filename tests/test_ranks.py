"""Places, shares and percentiles against NumPy and plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import ranks as K


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, rng.choice(["a", "b", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 9, 7.0]), "clash") for i in range(700)] + [(900, "one", 4.0, ""), (901, "none", None, "")]


def test_places_and_shares(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, v double, place string").repartition(5)
    got = {r.id: r.at for r in K.placed(df, [F.desc_nulls_last("v"), F.col("id")], "at").collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    low = lambda v: -1.0 if v is None else v
    shares = {r.id: r.rank_le for r in K.share_up_to(df, "v").collect()}
    assert shares == {r[0]: sum(low(x[2]) <= low(r[2]) for x in rows) / len(rows) for r in rows}
    assert K.placed(df.limit(0), [F.col("id")]).count() == 0 and K.share_up_to(df.limit(0), "v").count() == 0


def test_percentiles_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, v double, n string")
    for by in ("g", None):
        got = {(r.g if by else 0): r for r in K.described(df, "v", by).collect()}
        groups = {(r[1] if by else 0) for r in rows if r[2] is not None}
        assert set(got) == groups
        for g in groups:
            v = np.array([r[2] for r in rows if r[2] is not None and (not by or r[1] == g)])
            want = [len(v), v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, K.PERCENTILES)]
            mine = [got[g][c] for c in ("n", "mean", "std", "least", "most", *[f"p{p}" for p in K.PERCENTILES])]
            assert np.allclose(mine, want)
