"""Nearest labels against all pairs."""

import numpy as np
import pytest

from pairloom.operators import nearest as N


def plain(units, labels):
    out = {}
    good = [(k, np.asarray(v, float)) for k, v in labels if k is not None and v is not None and None not in v and len(v)]
    good = [(k, v / np.linalg.norm(v)) for k, v in good if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    for k, v in units:
        if k is None or v is None or None in v or not len(v) or not np.isfinite(np.asarray(v, float)).all() or np.linalg.norm(v) == 0:
            continue
        v = np.asarray(v, float) / np.linalg.norm(v)
        sims = [(-round(float(v @ w), 12), name) for name, w in good]
        out[k] = min(sims)[1]
    return out


def rows(rng, n, clusters, spread, first):
    middle = np.random.default_rng(1).normal(size=(clusters, 16))
    return [(first + i, [float(x) for x in middle[rng.integers(clusters)] + spread * rng.normal(size=16)]) for i in range(n)]


@pytest.mark.parametrize(("clusters", "spread", "block", "piece", "centres"), [(12, 0.05, 2000, 20_000, 16), (1, 1.0, 70, 40, 8), (300, 0.3, 50, 10, 1)])
def test_equal_to_all_pairs(spark, monkeypatch, clusters, spread, block, piece, centres):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIECE", piece)
    rng = np.random.default_rng(2)
    units, labels = rows(rng, 400, clusters, spread, 0), rows(rng, 500, clusters, spread, 1000)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    labels += [(900, labels[0][1]), (2000, [2 * x for x in labels[3][1]]), *odd]
    u = spark.createDataFrame([(*r, "clash") for r in units + odd], "id long, vector array<double>, label string")
    near = N.nearest_labels(u, spark.createDataFrame([(*r, "clash") for r in labels], "label long, vector array<double>, id string"), centres=centres)
    got = near.collect()
    assert {r.id: r.label for r in got} == plain(units + odd, labels) and len(got) == 400
    if clusters == 12:
        assert sum(r.compared for r in got) < 0.5 * 400 * 500  # most pairs are ruled out where the data cluster


def test_no_labels_and_no_units(spark):
    u = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    none = spark.createDataFrame([], "label long, vector array<double>")
    assert N.nearest_labels(u, none).count() == 0
    assert N.nearest_labels(u.filter("id > 1"), spark.createDataFrame([(1, [1.0, 2.0])], "label long, vector array<double>")).count() == 0


def test_fallback(spark):
    near = spark.createDataFrame([(i, 0, 0.1 * i, 1) for i in range(1, 11)], "id long, label long, cosine double, compared long")
    got = {r.id: (r.percentile, r.accepted, r.confidence) for r in N.with_fallback(near, 20.0, 0.3, 0.7).collect()}
    assert got[1] == (10.0, False, None) and got[2] == (20.0, True, 0.3) and got[6] == (60.0, True, 0.5) and got[10] == (100.0, True, 0.7)


def test_vectors_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    monkeypatch.setattr(N, "PIECE", 20)
    rng = np.random.default_rng(4)
    units, labels = rows(rng, 150, 5, 0.4, 0), [(f"l{k:04}", v) for k, v in rows(rng, 200, 5, 0.4, 0)]
    labels += [(f"k{k}", [3 * x for x in labels[k][1]]) for k in range(40)]
    near = N.nearest_labels(spark.createDataFrame(units, "id long, vector array<double>"), spark.createDataFrame(labels, "label string, vector array<double>"), centres=6)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan
    got = near.collect()
    assert {r.id: r.label for r in got} == plain(units, labels) and len(got) == 150
