"""Registered result-analysis queries.

The ``runs`` table (model, lang, layer, rank, precision, recall, f1) is
derived from lineitem: model from the part key, language from the supplier's
nation, layer from the line number, scores from averages of tax, quantity and
discount.  Its size is fixed by the key domains but every row aggregates the
whole lineitem table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.constants import LANGUAGES, MODEL_NAMES
from lignum.operators import results as R
from lignum.plans.registry import finish, query
from lignum.sources.tables import table

MODELS = list(MODEL_NAMES)
# layer count per model (6 with 12 layers, 3 with 6)
MODEL_LAYERS = {m: (6 if m in ("codeberta", "distilbert", "distilroberta") else 12) for m in MODELS}


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def raw_runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_discount",
                                             "l_tax", "l_quantity")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.pmod("l_partkey", F.lit(9)) + 1).cast("int"))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.pmod("s_nationkey", F.lit(8)) + 1).cast("int"))
    return (j.groupBy(model.alias("model"), lang.alias("lang"), F.col("l_linenumber").alias("layer"))
            .agg(F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"))
            .select("model", "lang", "layer", F.lit(128).alias("rank"), (F.col("t") * 10).alias("precision"),
                    (F.col("q") / 50).alias("recall"), (F.col("dd") * 10).alias("f1")))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + B13: result rows with readable model names."""
    return R.recode(raw_runs(spark, sf), "model")


_CASE_NAMES = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_NAMES.items()) + " ELSE model END"

RAW_RUNS_CTE = f"""
raw_runs AS (
  SELECT ({_sql_list(MODELS)})[(l_partkey % 9) + 1] AS model,
         ({_sql_list(LANGUAGES)})[(s_nationkey % 8) + 1] AS lang,
         l_linenumber AS layer, 128 AS rank,
         avg(l_tax) * 10 AS precision, avg(l_quantity) / 50 AS recall, avg(l_discount) * 10 AS f1
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3),
runs AS (SELECT {_CASE_NAMES} AS model, lang, layer, rank, precision, recall, f1 FROM raw_runs),
gm AS (SELECT model, layer, avg(f1) AS f1 FROM runs GROUP BY model, layer),
best AS (SELECT model, layer, f1 FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY f1 DESC) AS rk FROM gm)
         WHERE rk = 1),
blt AS (SELECT r.model, r.lang, r.layer, r.f1 FROM runs r WHERE EXISTS
        (SELECT 1 FROM best b WHERE b.model = r.model AND b.layer = r.layer))
"""


@query("runs_table", sql="WITH " + RAW_RUNS_CTE + """
SELECT model, lang, layer::BIGINT AS layer, rank::BIGINT AS rank, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM runs""")
def runs_table(spark, sf):
    """The result table with readable model names."""
    return finish(runs(spark, sf))


@query("group_mean", sql="WITH " + RAW_RUNS_CTE + """
SELECT model, layer::BIGINT AS layer, round(f1, 6) AS f1 FROM gm""")
def group_mean(spark, sf):
    """G1: mean f1 per (model, layer)."""
    return finish(R.group_mean(runs(spark, sf)))


@query("best_layer", sql="WITH " + RAW_RUNS_CTE + """
SELECT model, layer::BIGINT AS layer, round(f1, 6) AS f1 FROM best""", headline=True)
def best_layer(spark, sf):
    """Best layer(s) per model, ties kept."""
    return finish(R.argmax_rows(R.group_mean(runs(spark, sf)), "model", "f1"))


@query("best_layer_table", sql="WITH " + RAW_RUNS_CTE + """
SELECT model, lang, layer::BIGINT AS layer, round(f1, 6) AS f1 FROM blt""")
def best_layer_table(spark, sf):
    """Per-language results at each model's best layer."""
    return finish(R.best_layer_table(runs(spark, sf)))


@query("layer_series", sql="WITH " + RAW_RUNS_CTE + """
SELECT lang, layer::BIGINT AS layer, round(f1, 6) AS f1 FROM runs WHERE model = 'GraphCodeBERT'""")
def layer_series(spark, sf):
    """Layer -> f1 per language for one model (plot input)."""
    r = runs(spark, sf).where(F.col("model") == "GraphCodeBERT").select("lang", "layer", "f1")
    return finish(r.orderBy("lang", "layer"))


def _grid_sql() -> str:
    rows = ", ".join(f"('{m}', {n})" for m, n in MODEL_LAYERS.items())
    return f"""
grid AS (SELECT m.model, l.lang, s.layer::BIGINT AS layer, 128::BIGINT AS rank
         FROM (VALUES {rows}) m(model, n)
         JOIN (SELECT unnest({_sql_list(LANGUAGES)}) AS lang) l ON true
         JOIN (SELECT unnest(range(1, 13)) AS layer) s ON s.layer <= m.n)"""


@query("grid_todo", sql="WITH " + RAW_RUNS_CTE + "," + _grid_sql() + """
SELECT g.model, g.lang, g.layer, g.rank FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM raw_runs r WHERE r.model = g.model AND r.lang = g.lang
                  AND r.layer = g.layer AND r.rank = g.rank)""")
def grid_todo(spark, sf):
    """Experiment grid (model x lang x layer) minus runs already present."""
    models = spark.createDataFrame(list(MODEL_LAYERS.items()), "model string, n_layers int")
    grid = R.experiment_grid(models, LANGUAGES)
    return finish(R.outstanding(grid, raw_runs(spark, sf)))


TRANSFER_CTE = f"""
transfer AS (
  SELECT ({_sql_list(LANGUAGES)})[(s_nationkey % 8) + 1] AS source,
         ({_sql_list(LANGUAGES)})[(c_nationkey % 8) + 1] AS target,
         avg(l_discount) * 10 AS f1
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)"""


def transfer(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    lang = lambda k: F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(su, F.col("l_suppkey") == F.col("s_suppkey")))
    return j.groupBy(lang(F.col("s_nationkey")).alias("source"), lang(F.col("c_nationkey")).alias("target")) \
        .agg((F.avg("l_discount") * 10).alias("f1"))


@query("transfer_pivot", sql="WITH " + TRANSFER_CTE + """
SELECT s.source, """ + ", ".join(f"round(max(f1) FILTER (WHERE target = '{x}'), 6) AS {x}" for x in LANGUAGES) + f"""
FROM (SELECT unnest({_sql_list(LANGUAGES)}) AS source) s LEFT JOIN transfer USING (source) GROUP BY s.source""")
def transfer_pivot(spark, sf):
    """The whole source x target grid with the transfers that have been run, as a matrix."""
    grid = R.transfer_grid(spark, LANGUAGES).join(transfer(spark, sf), ["source", "target"], "left")
    return finish(R.pivot_matrix(grid, "source", "target", "f1", list(LANGUAGES)))


@query("transfer_todo", sql="WITH " + TRANSFER_CTE + f"""
SELECT s.source, t.target FROM (SELECT unnest({_sql_list(LANGUAGES)}) AS source) s,
       (SELECT unnest({_sql_list(LANGUAGES)}) AS target) t
WHERE NOT EXISTS (SELECT 1 FROM transfer x WHERE x.source = s.source AND x.target = t.target AND x.f1 >= 0.5)""")
def transfer_todo(spark, sf):
    """Pairs of the grid without a transfer of at least 0.5."""
    done = transfer(spark, sf).where(F.col("f1") >= 0.5)
    return finish(R.outstanding(R.transfer_grid(spark, LANGUAGES), done, ("source", "target")))


@query("shared_report", sql="WITH " + RAW_RUNS_CTE + """
SELECT lang, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall
FROM runs WHERE layer = 5 GROUP BY lang""")
def shared_report(spark, sf):
    """Per-language scores of the shared (layer 5) setting."""
    r = runs(spark, sf).where(F.col("layer") == 5)
    return finish(r.groupBy("lang").agg(F.avg("f1").alias("f1"), F.avg("precision").alias("precision"),
                                        F.avg("recall").alias("recall")))


PAIRS = (("CodeBERT", "GraphCodeBERT"), ("CodeBERTa", "RoBERTa"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    b = R.best_layer_table(runs(spark, sf))
    out = None
    for a, c in PAIRS:
        x = b.where(F.col("model") == a).select("lang", F.col("f1").alias("x"))
        y = b.where(F.col("model") == c).select("lang", F.col("f1").alias("y"))
        p = x.join(y, "lang").withColumn("comparison", F.lit(f"{a} vs {c}"))
        out = p if out is None else out.unionByName(p)
    return out


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a} vs {c}' AS comparison, x.lang, x.f1 AS x, y.f1 AS y FROM blt x JOIN blt y "
    f"ON x.lang = y.lang AND x.model = '{a}' AND y.model = '{c}'" for a, c in PAIRS)


@query("wilcoxon", sql="WITH RECURSIVE " + RAW_RUNS_CTE + f""",
pr AS ({_PAIRS_SQL}),
df AS (SELECT comparison, lang, x - y AS diff FROM pr WHERE x - y <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY abs(diff))
                 + (count(*) OVER (PARTITION BY comparison, abs(diff)) - 1) / 2.0 AS r,
              row_number() OVER (PARTITION BY comparison ORDER BY lang) - 1 AS i FROM df),
ag AS (SELECT comparison, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus,
              sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus FROM rk GROUP BY comparison),
st AS (SELECT *, least(w_plus, w_minus) AS statistic FROM ag),
ways AS (
  SELECT comparison, -1 AS i, 0 AS total, 1.0::DOUBLE AS p FROM st
  UNION ALL
  SELECT w.comparison, w.i + 1, w.total + s.b * (2 * rk.r)::INTEGER, w.p / 2
  FROM (SELECT comparison, i, total, sum(p) AS p FROM ways GROUP BY ALL) w
  JOIN rk ON rk.comparison = w.comparison AND rk.i = w.i + 1 CROSS JOIN (VALUES (0), (1)) s(b)),
ex AS (SELECT st.comparison, sum(ways.p) AS cdf FROM st JOIN ways
       ON ways.comparison = st.comparison AND ways.i = st.n - 1 AND ways.total <= 2 * st.statistic + 1e-9
       GROUP BY st.comparison)
SELECT st.comparison, st.n, round(st.w_plus, 6) AS w_plus, round(st.w_minus, 6) AS w_minus,
       round(st.statistic, 6) AS statistic,
       round(CASE WHEN 2 * ex.cdf > 1 THEN 1.0 ELSE 2 * ex.cdf END, 6) AS p_value,
       round((st.statistic - st.n * (st.n + 1) / 4.0) / sqrt(st.n * (st.n + 1) * (2 * st.n + 1) / 24.0), 6) AS z
FROM st LEFT JOIN ex USING (comparison)""")
def wilcoxon(spark, sf):
    """Paired Wilcoxon signed-rank between model pairs over languages."""
    return finish(R.wilcoxon(paired(spark, sf), "lang", "x", "y", group=["comparison"]))


@query("kendall_w", sql="WITH " + RAW_RUNS_CTE + """,
rk AS (SELECT model, lang, layer, rank() OVER (PARTITION BY model, lang ORDER BY f1)
              + (count(*) OVER (PARTITION BY model, lang, f1) - 1) / 2.0 AS r FROM runs),
sm AS (SELECT model, layer, sum(r) AS R FROM rk GROUP BY model, layer),
dm AS (SELECT model, count(DISTINCT lang) AS m, count(DISTINCT layer) AS n FROM rk GROUP BY model),
ss AS (SELECT model, sum(pow(R - mr, 2)) AS S FROM (SELECT *, avg(R) OVER (PARTITION BY model) AS mr FROM sm)
       GROUP BY model)
SELECT model, m, n, round(S, 6) AS S, round(12 * S / (m * m * (n * n * n - n)), 6) AS W
FROM ss JOIN dm USING (model)""")
def kendall_w(spark, sf):
    """Kendall's W of layer rankings across languages, per model."""
    return finish(R.kendall_w(runs(spark, sf)))
