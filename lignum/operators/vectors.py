"""Vector analytics (V1-V10) on ``array<float>`` columns.

Per-row math uses built-in array functions; group means use ``Summarizer``
(JVM vector aggregation, no explode); PCA is ``pyspark.ml``.  K-means takes the
Lloyd steps of every number of clusters in one pass over the rows.  Nearest
neighbours deal the rows into balls, leave out the balls that the triangle
inequality rules out for a query, and compare blocks inside tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lignum.functions.constants import SEP
from lignum.operators.order import staged
from lignum.ship import ensure_shipped

QUERY_BLOCK = 1024   # queries compared in one task at a time
ROW_BLOCK = 16384    # rows compared in one task at a time
BALL_ROWS = 4096     # rows of a ball on average
MAX_BALLS = 4096     # balls; beyond it balls hold more rows, in blocks
SEED_ROWS = 4096     # rows that starting centres are chosen from


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalize(v: Column) -> Column:
    """V1: L2-normalised copy."""
    n = norm(v)
    return F.transform(v, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """V6: mean vector per group (Summarizer.mean over ml vectors)."""
    return (df.groupBy(group)
            .agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"), F.count(F.lit(1)).alias("n"))
            .select(group, "n", vector_to_array("_m").alias("centroid")))


def displace(df: DataFrame, cents: DataFrame, group: str, target: str, vec: str = "vec") -> DataFrame:
    """V8: move every vector by (centroid[target] - centroid[own group]); target rows unchanged."""
    t = cents.where(F.col(group) == target).select("centroid").first()
    if t is None:
        raise ValueError(f"no centroid for {target}")
    tv = F.array(*[F.lit(float(x)) for x in t[0]])
    c = cents.select(F.col(group), F.col("centroid").alias("_c"))
    out = df.join(c, group)  # one row per group: AQE broadcasts it by measured size
    moved = F.when(F.col(group) == target, F.col(vec)).otherwise(add(F.col(vec), sub(tv, F.col("_c"))))
    return out.withColumn(vec, moved).drop("_c")


def _nearest_pivot(pivots: np.ndarray):
    """Ball of a vector and its distance to the ball's centre."""
    @F.pandas_udf("ball int, far double")
    def near(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"ball": pd.Series([], dtype="int32"), "far": pd.Series([], dtype="float64")})
        far = np.empty(len(v))
        ball = np.empty(len(v), np.int32)
        for i, x in enumerate(v):
            d = ((pivots - np.asarray(x)) ** 2).sum(axis=1)
            ball[i] = d.argmin()
            far[i] = np.sqrt(d[ball[i]])
        return pd.DataFrame({"ball": ball, "far": far})
    return near


def _compare(rows: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int) -> tuple[DataFrame, int]:
    """The ``k`` nearest rows of each ball that a query asks: ``_q, _id, dist`` out of (``_q, _v, ball``).

    A ball of many rows, or asked by many queries, is cut into blocks; a task holds one pair of blocks.
    """
    wanted = {r.ball: r.n for r in asked.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a ball
    pairs = sum(n * sizes.get(b, 0) for b, n in wanted.items())
    spark = rows.sparkSession
    cuts = [(b, sizes[b] // ROW_BLOCK + 1, n // QUERY_BLOCK + 1) for b, n in wanted.items() if b in sizes]
    plan = lambda: spark.createDataFrame(cuts, "ball int, nr int, nq int")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan(), "ball").select("ball", "_id", "_v", block("_id", "nr").alias("rb"), every("nq").alias("qb"))
    right = asked.join(plan(), "ball").select("ball", "_q", "_v", block("_q", "nq").alias("qb"), every("nr").alias("rb"))
    q_type, id_type = asked.schema["_q"].dataType.simpleString(), rows.schema["_id"].dataType.simpleString()

    def nearest(rp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rp) and len(qp):
            rp = rp.sort_values("_id")
            ids, x = rp["_id"].to_numpy(), np.stack(rp["_v"].to_list())
            for q, v in zip(qp["_q"], qp["_v"], strict=True):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                top = np.argsort(d, kind="stable")[:k]
                out.append(pd.DataFrame({"_q": q, "_id": ids[top], "dist": d[top]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_id": [], "dist": []})

    return (left.groupBy("ball", "rb", "qb").cogroup(right.groupBy("ball", "rb", "qb"))
            .applyInPandas(nearest, f"_q {q_type}, _id {id_type}, dist double")), pairs


def knn(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "vec",
        qid: str = "query", ball_rows: int = BALL_ROWS, stats: dict | None = None) -> DataFrame:
    """V5: the ``k`` nearest rows of ``df`` to every query vector (Euclidean), ties by id.

    Rows are dealt into balls about pivots (a seeded choice of rows, ``ball_rows`` rows each on average, at most
    ``MAX_BALLS``); a ball's radius is the distance of its farthest row.  Each query first looks into its nearest
    balls until they hold ``k`` rows: the k-th distance found is a bound.  By the triangle inequality no row
    of a ball is nearer than the distance to its pivot less the radius, so only balls below the bound are
    looked into then.  The result is exact whatever the pivots.  Rows or queries without a vector take no part.
    ``stats`` receives the numbers of ``compared`` and ``all`` pairs.
    """
    ensure_shipped(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    qs = queries.select(F.col(qid).alias("_q"), F.col(vec).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    n = rows.count()
    n_balls = max(1, min(MAX_BALLS, -(-n // ball_rows)))
    if n_balls == 1:
        # nothing to rule out
        rows, qs = rows.withColumn("ball", F.lit(0)), staged(qs.withColumn("ball", F.lit(0)), "queries")
        found, compared = _compare(rows, qs, {0: n}, k)
    else:
        found, compared = _through_balls(staged(rows, "rows"), qs, k, n_balls)
    if stats is not None:
        stats.update(compared=compared, all=n * qs.count())
    found = found.select(F.col("_q").alias(qid), F.col("_id").alias(id_col), "dist")
    w = W.partitionBy(qid).orderBy("dist", id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _through_balls(rows: DataFrame, qs: DataFrame, k: int, n_balls: int) -> tuple[DataFrame, int]:
    """Candidates of every query (``_q, _id, dist``), all of its ``k`` nearest rows among them, and the pairs compared."""
    chosen = rows.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(n_balls).select("_v").collect()  # at most MAX_BALLS
    pivots = np.array([r["_v"] for r in chosen], dtype=np.float64)
    near = _nearest_pivot(pivots)
    rows = staged(rows.withColumn("_b", near("_v")).select("_id", "_v", "_b.ball", "_b.far"), "balls")
    balls = {r.ball: (r.radius, r.n) for r in rows.groupBy("ball").agg(
        F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_BALLS
    sizes = {b: x[1] for b, x in balls.items()}
    ids = np.array(sorted(balls), dtype=np.int32)
    radius, held, centres = np.array([balls[b][0] for b in ids]), np.array([balls[b][1] for b in ids]), pivots[ids]

    @F.pandas_udf("array<int>")
    def first_balls(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            order = np.argsort(((centres - np.asarray(x)) ** 2).sum(axis=1), kind="stable")
            out.append(ids[order[:np.searchsorted(np.cumsum(held[order]), k) + 1]])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<int>")
    def more_balls(v: pd.Series, seen: pd.Series, bound: pd.Series) -> pd.Series:
        out = []
        for x, s, b in zip(v, seen, bound, strict=True):
            least = np.sqrt(((centres - np.asarray(x)) ** 2).sum(axis=1)) - radius
            # a little is allowed for rounding, so that a tie is never lost
            open_ = ids[least <= (np.inf if b != b else b) * (1 + 1e-9) + 1e-9]
            out.append(open_[~np.isin(open_, s)])
        return pd.Series(out, dtype=object)

    qs = staged(qs.withColumn("_first", first_balls("_v")), "queries")
    one, n_one = _compare(rows, qs.select("_q", "_v", F.explode("_first").alias("ball")), sizes, k)
    one = staged(one, "neighbours")
    kth = one.groupBy("_q").agg(F.sort_array(F.collect_list("dist")).alias("_d")).select(
        "_q", F.get("_d", F.lit(k - 1)).alias("_bound"))
    more = more_balls("_v", "_first", F.coalesce("_bound", F.lit(float("nan"))))
    rest = staged(qs.join(kth, "_q", "left").select("_q", "_v", F.explode(more).alias("ball")), "queries")
    two, n_two = _compare(rows, rest, sizes, k)
    return one.unionByName(two), n_one + n_two


def pca2(df: DataFrame, vec: str = "vec", k: int = 2) -> DataFrame:
    """V2: centred PCA to ``k`` components (ml PCA does not centre, so scale first)."""
    from pyspark.ml.feature import PCA, StandardScaler
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    sc = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v)
    c = sc.transform(v)
    p = PCA(k=k, inputCol="_c", outputCol="_p").fit(c)
    return p.transform(c).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")


def nested_seeds(df: DataFrame, k: int, seed: int, vec: str = "vec") -> np.ndarray:
    """Up to ``k`` starting centres: k-means++ over a seeded choice of ``SEED_ROWS`` rows.  The first ``j`` of them
    are the start of ``j`` clusters."""
    rows = df.select(vec).orderBy(F.xxhash64(F.lit(seed), vec), vec).limit(SEED_ROWS).collect()  # a documented bound
    x = np.array([r[0] for r in rows], dtype=np.float64)
    rng = np.random.default_rng(seed)
    if not len(x):
        return x.reshape(0, 0)
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (ties: the first) and squared distance of every row."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
    at = d.argmin(axis=1)
    return at, ((x - c[at]) ** 2).sum(axis=1)


def lloyd(df: DataFrame, starts: dict[int, np.ndarray], vec: str = "vec", max_iter: int = 20,
          tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Lloyd's algorithm for several numbers of clusters at once: ``{k: (centres, cost)}``.

    One job a step moves the centres of every k that still moves; a task sends one row a centre.
    """
    spark = df.sparkSession
    ensure_shipped(spark)
    centres, done = dict(starts), {}
    for step in range(max_iter + 1):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches):
            acc = {k: (np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)) for k, c in shared.value.items()}
            for pdf in batches:
                x = np.stack(pdf["v"].to_list()).astype(np.float64)
                for k, c in shared.value.items():
                    at, far = _assign(x, c)
                    n, cost, total = acc[k]
                    n += np.bincount(at, minlength=len(c))
                    cost += np.bincount(at, weights=far, minlength=len(c))
                    np.add.at(total, at, x)
            yield pd.DataFrame([(k, i, n[i], cost[i], total[i]) for k, (n, cost, total) in acc.items() for i in range(len(n))],
                               columns=["k", "i", "n", "cost", "total"])

        parts = df.select(F.col(vec).alias("v")).mapInPandas(sums, "k int, i int, n double, cost double, total array<double>")
        got = (parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                           Summarizer.sum(array_to_vector("total")).alias("t")).collect())  # one row a centre
        moved = {k: c.copy() for k, c in centres.items()}
        cost = dict.fromkeys(centres, 0.0)
        for r in got:
            cost[r.k] += r.cost
            if r.n:
                moved[r.k][r.i] = r.t.toArray() / r.n
        for k in list(centres):
            if step == max_iter or ((moved[k] - centres[k]) ** 2).sum(axis=1).max() <= tol ** 2:
                done[k] = (centres.pop(k), cost[k])
            else:
                centres[k] = moved[k]
        if not centres:
            break
    return done


def kmeans_elbow(df: DataFrame, k_min: int, k_max: int, seed: int = 42, vec: str = "vec"):
    """V3: k-means for every k in [k_min, k_max), the elbow (largest distance to the chord) and its clusters.

    All k share each pass over the rows.  Where there are fewer distinct rows than k, a fit has that many clusters.
    """
    v = staged(df.withColumn(vec, F.col(vec).cast("array<double>")), "points")
    seeds = nested_seeds(v, k_max - 1, seed, vec)
    fits = lloyd(v, {k: seeds[:k] for k in range(k_min, k_max)}, vec)
    costs = [(k, fits[k][1]) for k in range(k_min, k_max)]
    (k0, c0), (k1, c1) = costs[0], costs[-1]
    best = max(costs, key=lambda t: abs((c1 - c0) * (t[0] - k0) - (k1 - k0) * (t[1] - c0)))[0]
    centres = df.sparkSession.sparkContext.broadcast(fits[best][0])

    @F.pandas_udf("int")
    def cluster(x: pd.Series) -> pd.Series:
        return pd.Series(_assign(np.stack(x.to_list()), centres.value)[0] if len(x) else [], dtype="int32")

    return best, costs, v.withColumn("cluster", cluster(F.col(vec)))


def cluster_heads(clustered: DataFrame, label: str, order: str, n: int = 10) -> DataFrame:
    """V4: the first ``n`` plain labels of each cluster."""
    w = W.partitionBy("cluster").orderBy(order)
    plain = clustered.where(~F.col(label).cast("string").contains(SEP))
    return plain.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
