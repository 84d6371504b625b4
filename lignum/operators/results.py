"""Experiment-result analytics.

Result tables are small relative to the corpora, but every operator here is a
plain DataFrame aggregate / window / join so it also runs over millions of
runs.  The exact Wilcoxon distribution is built rank by rank, without listing signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lignum.functions.constants import (LABEL_FAMILIES_CONTAINS, LABEL_FAMILY_EQUALS,
                                        LABEL_FAMILY_OTHER, MODEL_NAMES)


def recode(df: DataFrame, column: str, mapping: dict[str, str] = MODEL_NAMES) -> DataFrame:
    """Replace values of one column by a dictionary (others unchanged)."""
    return df.replace(mapping, subset=[column])


def parse_run_dirs(paths: DataFrame, path_col: str = "path", marker: str = "multilingual") -> DataFrame:
    """A10 + B15: ``.../<model>_<lang>_<layer>_<rank>/metrics`` -> typed columns; skip marker runs.

    The directory may be a partition directory (``run=<model>_...``)."""
    parent = F.regexp_replace(F.element_at(F.split(F.col(path_col), "/"), -2), "^[^=]*=", "")
    parts = F.split(parent, "_")
    return (paths.where(~parent.contains(marker))
            .withColumn("model", F.get(parts, 0)).withColumn("lang", F.get(parts, 1))
            .withColumn("layer", F.get(parts, 2).cast("int")).withColumn("rank", F.get(parts, 3).cast("int")))


def group_mean(runs: DataFrame, keys=("model", "layer"), value: str = "f1") -> DataFrame:
    """G1."""
    return runs.groupBy(*keys).agg(F.avg(value).alias(value))


def argmax_rows(df: DataFrame, group: str, value: str) -> DataFrame:
    """Every row achieving the group maximum (ties kept)."""
    w = W.partitionBy(group).orderBy(F.col(value).desc())
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") == 1).drop("_r")


def best_layer_table(runs: DataFrame) -> DataFrame:
    """G3 + J6: results restricted to each model's best (model, layer)."""
    best = argmax_rows(group_mean(runs), "model", "f1").select("model", "layer")
    return runs.join(best, ["model", "layer"], "left_semi").select("model", "lang", "layer", "f1")


def experiment_grid(models: DataFrame, langs, rank: int = 128) -> DataFrame:
    """Model x lang x layers 1..n_layers, from rows (model, n_layers)."""
    return (models.select("model", "n_layers", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
            .select("model", "lang", F.explode(F.sequence(F.lit(1), F.col("n_layers").cast("int"))).alias("layer"),
                    F.lit(rank).alias("rank")))


def transfer_grid(spark: SparkSession, langs) -> DataFrame:
    """Every source x target pair; one without results keeps its rows."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in langs])).alias("source"))
    return one.select("source", F.explode(F.array(*[F.lit(x) for x in langs])).alias("target"))


def outstanding(grid: DataFrame, runs: DataFrame, keys=("model", "lang", "layer", "rank")) -> DataFrame:
    """Grid rows with no result yet."""
    return grid.join(runs.select(*keys).distinct(), list(keys), "left_anti")


def pivot_matrix(df: DataFrame, row: str, col: str, value: str, values: list[str] | None = None) -> DataFrame:
    """One row per ``row`` value, one column per ``col`` value."""
    return df.groupBy(row).pivot(col, values).agg(F.first(value))


def average_rank(value: Column, partition: list[str]) -> Column:
    """Average ranks (ties share the mean rank), ascending."""
    w = W.partitionBy(*partition).orderBy(value)
    ties = W.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def kendall_w(runs: DataFrame, item: str = "layer", judge: str = "lang", group: str = "model",
              value: str = "f1") -> DataFrame:
    """Kendall's W per group without tie correction: 12 S / (m^2 (n^3 - n))."""
    r = runs.withColumn("_rank", average_rank(F.col(value), [group, judge]))
    sums = r.groupBy(group, item).agg(F.sum("_rank").alias("R"))
    dims = r.groupBy(group).agg(F.countDistinct(judge).alias("m"), F.countDistinct(item).alias("n"))
    s = (sums.withColumn("_mean", F.avg("R").over(W.partitionBy(group)))
         .groupBy(group).agg(F.sum(F.pow(F.col("R") - F.col("_mean"), 2)).alias("S")))
    return (s.join(dims, group)
            .select(group, "m", "n", "S",
                    (12 * F.col("S") / (F.col("m") ** 2 * (F.col("n") ** 3 - F.col("n")))).alias("W")))


MAX_EXACT = 200


def wilcoxon(pairs: DataFrame, key: str, x: str, y: str, group: list[str] | None = None,
             max_exact: int = MAX_EXACT) -> DataFrame:
    """Paired Wilcoxon signed-rank per group.

    Zero differences are dropped, |diff| gets average ranks, statistic =
    min(W+, W-).  Up to ``max_exact`` pairs the two-sided p-value is exact: the
    null distribution of W+ is built rank by rank over doubled ranks (average
    ranks are halves), ``O(n * sum of ranks)`` and no enumeration of signs.  Above,
    it is the normal approximation with tie correction.  A group whose
    differences are all zero gives n = 0 and p = 1.
    """
    if not group:
        pairs, group = pairs.withColumn("_all", F.lit(1)), ["_all"]
    d = pairs.select(*group, key, (F.col(x) - F.col(y)).alias("diff")).where(F.col("diff").isNotNull())
    zero = F.col("diff") == 0
    rank = average_rank(F.abs(F.col("diff")), [*group, "_zero"])
    d = d.withColumn("_zero", zero).withColumn("r", F.when(~zero, rank).otherwise(0.0))
    d = d.withColumn("_n", F.sum(F.when(~zero, 1).otherwise(0)).over(W.partitionBy(*group)))
    agg = d.groupBy(*group).agg(
        F.sum(F.when(~zero, 1).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("r") * F.col("r")).alias("_rr"),
        # ranks are gathered for small groups only
        F.sort_array(F.collect_list(F.when(~zero & (F.col("_n") <= max_exact), (2 * F.col("r")).cast("int")))).alias("_ranks"))
    agg = agg.withColumn("statistic", F.least("w_plus", "w_minus"))
    n = F.col("n")
    # distribution of 2 W+: ways to reach each sum, as doubles scaled by 2**-n
    ways = F.aggregate("_ranks", F.array(F.lit(1.0)), lambda acc, r: F.transform(
        F.sequence(F.lit(0), F.size(acc) + r - 1),
        lambda k: (F.coalesce(F.get(acc, k), F.lit(0.0)) + F.when(k >= r, F.coalesce(F.get(acc, k - r), F.lit(0.0)))
                   .otherwise(0.0)) / 2))
    agg = agg.withColumn("_ways", F.when(n <= max_exact, ways))
    upto = F.floor(2 * F.col("statistic") + 1e-9).cast("int")
    cdf = F.aggregate(F.slice("_ways", F.lit(1), upto + 1), F.lit(0.0), lambda a, b: a + b)
    mean = n * (n + 1) / 4.0
    # the variance under ties is the sum of squared ranks over four
    sd = F.sqrt(F.col("_rr") / 4.0)
    z0 = F.when(n > 0, (F.col("statistic") - mean) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0))
    p_exact = F.least(F.lit(1.0), 2 * cdf)
    p_normal = normal_two_sided(F.abs((F.col("statistic") - mean) / sd))
    p = F.when(n == 0, F.lit(1.0)).when(n <= max_exact, p_exact).otherwise(p_normal)
    return agg.select(*group, n.cast("long").alias("n"), "w_plus", "w_minus", "statistic", p.alias("p_value"), z0.alias("z"))


def normal_two_sided(z: Column) -> Column:
    """``2 (1 - Phi(z))`` for z >= 0 by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def label_family(label: Column) -> Column:
    """First matching family of a label."""
    e = None
    for fam in LABEL_FAMILIES_CONTAINS:
        e = F.when(label.contains(fam), F.lit(fam)) if e is None else e.when(label.contains(fam), F.lit(fam))
    return e.when(label == LABEL_FAMILY_EQUALS, F.lit(LABEL_FAMILY_EQUALS)).otherwise(F.lit(LABEL_FAMILY_OTHER))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values (ties by value), TakeOrderedAndProject."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(key)).limit(k)
