"""Result analytics: ranks, Kendall's W, Wilcoxon, argmax ties."""

import itertools

from pyspark.sql import functions as F

from lignum.operators import results as R


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)], "g int, v double")
    r = sorted(x.r for x in df.select(R.average_rank(F.col("v"), ["g"]).alias("r")).collect())
    assert r == [1.0, 2.5, 2.5, 4.0]


def test_argmax_keeps_ties(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.5), ("m", 3, 0.1)], "model string, layer int, f1 double")
    assert sorted(r.layer for r in R.argmax_rows(df, "model", "f1").collect()) == [1, 2]


def test_kendall_w_perfect_agreement(spark):
    rows = [("m", lang, layer, float(layer)) for lang in ("a", "b", "c") for layer in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "model string, lang string, layer int, f1 double")
    assert abs(R.kendall_w(df).first().W - 1.0) < 1e-12


def test_wilcoxon_exact(spark):
    x = [0.9, 0.8, 0.76, 0.6, 0.55, 0.7]
    y = [0.85, 0.82, 0.7, 0.5, 0.56, 0.4]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(zip(x, y))], "k string, x double, y double")
    out = R.wilcoxon(df, "k", "x", "y").first()
    d = [a - b for a, b in zip(x, y)]
    order = sorted(range(6), key=lambda i: abs(d[i]))
    ranks = [0] * 6
    for r, i in enumerate(order):
        ranks[i] = r + 1
    wp = sum(r for r, v in zip(ranks, d) if v > 0)
    wm = sum(r for r, v in zip(ranks, d) if v < 0)
    stat = min(wp, wm)
    dist = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    p = min(1.0, 2 * sum(1 for w in dist if w <= stat) / len(dist))
    assert (out.w_plus, out.w_minus, out.statistic) == (wp, wm, stat)
    assert abs(out.p_value - p) < 1e-12
