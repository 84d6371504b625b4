"""PCA against the covariance matrix; k-means elbow and cluster heads by their invariants."""

import numpy as np
from pyspark.sql import functions as F

from lignum.operators import vectors as V


def points(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6)) * 8
    x = centres[np.arange(200) % 5] + rng.normal(size=(200, 6)) * 0.1
    rows = [(i, f"l{i}" if i % 7 else f"l{i}<sep>x", [float(a) for a in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, label string, vec array<double>")


def test_pca_matches_covariance(spark):
    x, df = points(spark)
    got = np.array([r.pc for r in V.pca2(df).orderBy("vec_id").collect()])
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    assert np.allclose(np.abs(got), np.abs(c @ vectors[:, ::-1][:, :2]), atol=1e-8)
    assert np.allclose(got.var(axis=0, ddof=1), values[::-1][:2])


def test_kmeans_elbow_and_heads(spark):
    x, df = points(spark)
    k, costs, clustered = V.kmeans_elbow(df, 2, 10)
    assert [c[0] for c in costs] == list(range(2, 10)) and k in range(2, 10)
    (k0, c0), (k1, c1) = costs[0], costs[-1]
    gaps = {a: abs((c1 - c0) * (a - k0) - (k1 - k0) * (c - c0)) for a, c in costs}
    assert gaps[k] == max(gaps.values())
    rows = clustered.orderBy("vec_id").collect()
    groups = np.array([r.cluster for r in rows])
    assert len(rows) == 200 and len(set(groups)) <= k
    # the cost of the chosen fit is that of its own clusters about their means
    own = sum(((x[groups == g] - x[groups == g].mean(axis=0)) ** 2).sum() for g in set(groups))
    assert own <= dict(costs)[k] * (1 + 1e-6) + 1e-9
    heads = V.cluster_heads(clustered, "label", "vec_id", 3).collect()
    assert all("<sep>" not in h.label and h.pos <= 3 for h in heads)
    plain = [(r.cluster, r.vec_id) for r in rows if "<sep>" not in r.label]
    for g in set(groups):
        want = sorted(i for c, i in plain if c == g)[:3]
        assert sorted(h.vec_id for h in heads if h.cluster == g) == want


def test_shared_passes_equal_single_fits(spark):
    _x, df = points(spark)
    seeds = V.nested_seeds(df, 9, 42)
    together = V.lloyd(df, {k: seeds[:k] for k in range(2, 10)})
    for k in (2, 5, 9):
        centres, cost = V.lloyd(df, {k: seeds[:k]})[k]
        assert np.isclose(cost, together[k][1]) and np.allclose(centres, together[k][0])
    same = spark.createDataFrame([(i, "l", [1.0, 2.0]) for i in range(6)], "vec_id long, label string, vec array<double>")
    k, costs, out = V.kmeans_elbow(same, 2, 5)
    assert [c for _k, c in costs] == [0.0] * 3 and {r.cluster for r in out.collect()} == {0}


def test_knn_prunes_and_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.round(centres[np.arange(600) % 12] + rng.normal(size=(600, 8)), 2)
    x[100:110] = x[5]                                                      # ties
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(9000, None)], "vec_id long, vec array<double>")
    q = np.concatenate([x[::40], centres[:3] + 40])
    qs = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(q)] + [(99, None)], "query long, vec array<double>")
    stats = {}
    got = V.knn(df, qs, 15, ball_rows=20, stats=stats).collect()
    want = set()
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        for rank, j in enumerate(np.lexsort((np.arange(600), d))[:15]):
            want.add((i, int(j), rank + 1))
    assert {(r.query, r.vec_id, r["rank"]) for r in got} == want
    assert stats["all"] == 600 * len(q) and stats["compared"] < stats["all"] / 2
    few = V.knn(df.limit(3), qs, 15, ball_rows=1)
    assert few.groupBy("query").count().where("count > 3").isEmpty()
    assert V.knn(df.limit(0), qs, 3).count() == 0 and V.knn(df, qs.limit(0), 3).count() == 0


def test_kmeans_elbow_tries_the_range_of_the_reference(spark, monkeypatch):
    from lignum.plans import vocab_vectors
    from lignum.plans.registry import QUERIES
    tried = []

    def elbow(df, k_min, k_max):
        tried.extend(range(k_min, k_max))
        return 4, [], df.selectExpr("*", "0 AS cluster")
    rows = spark.createDataFrame([(k, k % 3, [1.0, float(k)], "c") for k in range(8)],
                                 "vec_id long, label int, vec array<double>, lang string")
    monkeypatch.setattr(vocab_vectors, "vectors", lambda *_: rows)
    monkeypatch.setattr(vocab_vectors.V, "kmeans_elbow", elbow)
    assert QUERIES["kmeans_elbow"](spark, "").count() == 8
    assert tried == list(range(4, 80))
