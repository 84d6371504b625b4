"""Near-duplicate vectors by product quantisation.

Vectors are normalised and compared within their label only.  A coarse quantiser
cuts the space into cells (inverted lists); every vector is entered in its
``PROBES`` nearest cells, with the codes of its residual in ``SUBSPACES``
subspaces.  Within a cell, a query vector's distances to all codes come from one
table a subspace (asymmetric distances); pairs within the threshold plus the
codes' error bound are reranked by their exact cosine in double precision.  Two
vectors meet if they share a cell; a pair is counted in its smallest shared cell.

The quantisers are fitted on a bounded sample of about ``SAMPLE`` vectors; all
vectors are indexed.  Cells number about one for ``CELL`` distinct vectors, at most
``MAX_CELLS``.  Equal vectors of a label share one representative with a count, so
copies never meet pair by pair.  A cell with more than ``BLOCK`` entries is cut
into blocks; every two blocks meet by themselves, dealt over the tasks by cell and blocks.

Each cell returns, per vector, the number of links and a spanning forest of its
links, so what leaves a cell is linear in its entries and loses no connection.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing.  Vectors of different lengths do not link.
Rows with equal ids, or without an id, count as separate vectors.  A component is named by
its smallest id that is not null; ``kept`` is the null-safe equality of both, so a vector
without an id stays only if no vector of its component has one.  An empty table gives an
empty result; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import stored
from lignum.llm.components import components
from lignum.ship import ensure_shipped

THRESHOLD = 0.98
SAMPLE = 16_384
CELL = 256
MAX_CELLS = 16_384
PROBES = 6
SUBSPACES = 8
CODES = 64
BLOCK = 2048
SEED = 17


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centers))), np.int64)
    for lo in range(0, len(x), 1024):
        d = (centers ** 2).sum(1) - 2 * x[lo:lo + 1024] @ centers.T
        if out.shape[1] < d.shape[1]:
            best = np.argpartition(d, out.shape[1] - 1, 1)[:, :out.shape[1]]
        else:
            best = np.tile(np.arange(d.shape[1]), (len(d), 1))
        order = np.argsort(np.take_along_axis(d, best, 1), 1, kind="stable")
        out[lo:lo + 1024] = np.take_along_axis(best, order, 1)
    return out


class Quantiser:
    """Coarse centres, and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.centers = kmeans(sample, cells)
        rest = sample - self.centers[nearest(sample, self.centers, 1)[:, 0]]
        self.cuts = [s for s in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(s)]
        self.books = [kmeans(rest[:, s], CODES) for s in self.cuts]

    def probes(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centers, PROBES)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row's residual in a cell, and the length of what the codes miss."""
        rest = x - self.centers[cell]
        codes = np.stack([nearest(rest[:, s], b, 1)[:, 0] for s, b in zip(self.cuts, self.books, strict=True)], 1)
        missed = sum(((rest[:, s] - b[codes[:, j]]) ** 2).sum(1)
                     for j, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(missed)

    def candidates(self, q: np.ndarray, cell: int, codes: np.ndarray, missed: np.ndarray, reach: float) -> np.ndarray:
        """Pairs (query, entry) whose distance may be within ``reach``: table distance at most reach + what the code misses."""
        rest = q - self.centers[cell]
        d = np.zeros((len(q), len(codes)), np.float32)
        for j, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            lut = ((rest[:, None, s] - b[None]) ** 2).sum(2).astype(np.float32)
            d += lut[:, codes[:, j]]
        return np.argwhere(np.sqrt(np.maximum(d, 0)) <= (reach + missed + 1e-3)[None, :])


def normalised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` of the vectors that can link: not null, not zero, all components finite."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine
                     & F.exists("v", lambda x: x != 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Forest:
    """Union-find over a block's entries."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def cell_links(pdf: pd.DataFrame, quantiser: Quantiser, threshold: float) -> pd.DataFrame:
    """Links of one cell's two blocks: rows ``(vec, n)`` of link counts and ``(vec, other)`` of the forest."""
    cell, bi, bj = int(pdf["cell"].iloc[0]), int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
    ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
    x = np.stack(pdf["v"].to_numpy())
    probes = np.stack(pdf["probes"].to_numpy())
    codes, missed = quantiser.encode(x, np.full(len(x), cell))
    block = pdf["block"].to_numpy()
    a, b = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    for lo in range(0, len(a), 256):
        q = a[lo:lo + 256]
        hit = quantiser.candidates(x[q], cell, codes[b], missed[b], reach)
        i, j = q[hit[:, 0]], b[hit[:, 1]]
        keep = i < j if bi == bj else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 100_000):
            ii, jj = i[at:at + 100_000], j[at:at + 100_000]
            good = (x[ii] * x[jj]).sum(1) >= threshold
            ii, jj = ii[good], jj[good]
            # a pair counts in the smallest cell that both probe
            same = probes[ii][:, :, None] == probes[jj][:, None, :]
            lowest = np.where(same.any(2), probes[ii], np.iinfo(np.int64).max).min(1)
            ii, jj = ii[lowest == cell], jj[lowest == cell]
            np.add.at(links, ii, copies[jj])
            np.add.at(links, jj, copies[ii])
            edges += [(ids[p], ids[r]) for p, r in zip(ii, jj, strict=True) if forest.join(p, r)]
    some = np.flatnonzero(links)
    return pd.DataFrame({"vec": np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)]),
                         "other": pd.array([None] * len(some) + [e[1] for e in edges], dtype="Int64"),
                         "n": pd.array([*links[some], *[None] * len(edges)], dtype="Int64")})


def _cell_task(shared, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return cell_links(pdf, shared.value, threshold)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = vectors.sparkSession
    ensure_shipped(spark)
    good = normalised(vectors, id_col, vector_col, label_col)
    # equal vectors of a label: one representative and a count
    reps = stored(good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("rep", F.monotonically_increasing_id()), "reps")
    base = vectors.select(F.col(id_col).alias("vec_id"))
    total, dims = reps.count(), reps.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not total:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    counts, edges = None, None  # of representatives, by number
    for d in [r["d"] for r in dims]:
        mine = reps.where(F.size("v") == d)
        share = min(1.0, SAMPLE / total)
        pick = F.pmod(F.xxhash64(F.lit(SEED), F.col("v")), F.lit(1 << 30)) <= int(share * (1 << 30))
        sample = np.array([r["v"] for r in mine.where(pick).select("rep", "v").collect()])
        if not len(sample):
            sample = np.array([r["v"] for r in mine.limit(CELL).select("v").collect()])
        cells = max(1, min(MAX_CELLS, total // CELL, len(sample)))
        shared = spark.sparkContext.broadcast(Quantiser(unit(sample), cells))

        def enter(batches: Iterator[pa.RecordBatch], shared=shared, d=d) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                p = shared.value.probes(x)
                k = p.shape[1]
                rows = np.repeat(np.arange(len(x)), k)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(p.reshape(-1)), batch.column(2).take(take),
                     batch.column(3).take(take), pa.FixedSizeListArray.from_arrays(pa.array(p[rows].reshape(-1)), k).cast(
                         pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(
                         pa.array(x[rows].reshape(-1)), d).cast(pa.list_(pa.float64()))],
                    ["label", "cell", "rep", "copies", "probes", "v"])

        kind = reps.schema["label"].dataType.simpleString()
        entered = stored(mine.select("label", "v", "rep", "copies").mapInArrow(
            enter, f"label {kind}, cell long, rep long, copies long, probes array<long>, v array<double>"), "lists")
        size = entered.groupBy(F.col("label").alias("_l"), F.col("cell").alias("_c")).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        blocked = entered.join(size, (F.col("label") == F.col("_l")) & (F.col("cell") == F.col("_c"))).withColumn(
            "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("_l", "_c")
        met = blocked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "label", "cell", "rep", "copies", "probes", "v", "block",
            F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"))
        # dealt by all four: grouping alone would keep the join's partitioning, a cell's blocks in one task
        met = met.repartition("label", "cell", "bi", "bj")
        found = met.groupBy("label", "cell", "bi", "bj").applyInPandas(
            _cell_task(shared, threshold), "vec long, other long, n long")
        found = stored(found, "links")
        c, e = found.where(F.col("n").isNotNull()), found.where(F.col("other").isNotNull())
        counts = c if counts is None else counts.unionByName(c)
        edges = e if edges is None else edges.unionByName(e)
    per = counts.groupBy(F.col("vec").alias("_v")).agg(F.sum("n").alias("n"))
    labels = components(edges.select(F.col("vec").alias("u"), F.col("other").alias("v")))
    named = reps.select("rep", "least").join(labels, F.col("rep") == F.col("node"))
    smallest = named.groupBy(F.col("component").alias("_k")).agg(F.min("least").alias("cid"))
    named = named.join(smallest, F.col("component") == F.col("_k")).select("node", "cid")
    classes = (reps.join(per, F.col("rep") == F.col("_v"), "left")
               .join(named, F.col("rep") == F.col("node"), "left")
               .select(F.col("label").alias("_l"), F.col("v").alias("_x"),
                       F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("cid")).alias("cid"),
                       (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")))
    rows = good.join(classes, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_x"))).select(
        "vec_id", "links", "cid")
    rest = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(
        F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    bad = rest.where(~F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("cid"))
    out = rows.unionByName(bad)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("cid").alias("component_id"),
                      F.col("vec_id").eqNullSafe(F.col("cid")).alias("kept"))
