"""Registered queries of the training loop's data side."""

from __future__ import annotations

from pyspark.sql import functions as F

from lignum.functions.columns import md5_bucket
from lignum.functions.constants import BATCH_SIZE, RANK_LOSS_EPS, TRAIN_SEED
from lignum.operators import curate as U
from lignum.operators import losses as L
from lignum.operators import order as O
from lignum.plans import doc_trees as D
from lignum.plans.registry import finish, query
from lignum.sources.tables import table

EPOCHS = (1, 2)
SHARES = (0.8, 0.1)


def _batch_sql(epoch: str) -> str:
    return f"""row_number() OVER (PARTITION BY {epoch} ORDER BY md5(doc_id::VARCHAR || '#' || {epoch} || ':{TRAIN_SEED}'),
                               doc_id) - 1"""


@query("minibatches", sql=f"""
SELECT epoch::BIGINT AS epoch, doc_id, rn // {BATCH_SIZE} AS batch, rn % {BATCH_SIZE} AS slot FROM (
  SELECT doc_id, epoch, {_batch_sql('epoch')} AS rn FROM documents, (VALUES {', '.join(f'({e})' for e in EPOCHS)}) t(epoch))""")
def minibatches(spark, sf):
    """Batches of 32 documents, a fresh seeded permutation for each epoch."""
    ids = table(spark, sf, "documents").select("doc_id")
    out = None
    for e in EPOCHS:
        b = O.minibatches(ids, "doc_id", e).select(F.lit(e).alias("epoch"), "doc_id", "batch", "slot")
        out = b if out is None else out.unionByName(b)
    return finish(out)


@query("epoch_loss", sql="WITH " + D.GAPS_CTE + f""",
hg AS (SELECT tree_id, gap, d, d + (('0x' || substr(md5(tree_id::VARCHAR || ':' || gap::VARCHAR), 1, 6))::BIGINT % 7 - 3) * 0.3
              AS p FROM gaps),
pj AS (SELECT a.tree_id, count(*) AS n_pairs, sum(greatest(0.0, 1.0 - (a.p - b.p))) AS hinge,
              sum(exp(greatest(0.0, 1.0 - (a.p - b.p))) - 1) AS hinge_exp
       FROM hg a JOIN hg b ON a.tree_id = b.tree_id AND a.d > b.d GROUP BY a.tree_id),
far AS (SELECT tree_id, sum(abs(p - d)) AS off, count(*) AS n FROM hg GROUP BY tree_id),
bt AS (SELECT doc_id AS tree_id, ({_batch_sql("'1'")}) // {BATCH_SIZE} AS batch FROM documents),
pb AS (SELECT batch, coalesce(sum(hinge), 0) / (coalesce(sum(n_pairs), 0) + {RANK_LOSS_EPS}) AS rank_loss,
              coalesce(sum(hinge_exp), 0) / (coalesce(sum(n_pairs), 0) + {RANK_LOSS_EPS}) AS rank_loss_exp,
              coalesce(sum(off), 0) / greatest(coalesce(sum(n), 0), 1) AS l1
       FROM bt LEFT JOIN pj USING (tree_id) LEFT JOIN far USING (tree_id) GROUP BY batch)
SELECT count(*) AS n_batches, round(avg(rank_loss), 6) AS rank_loss, round(avg(rank_loss_exp), 6) AS rank_loss_exp,
       round(avg(l1), 6) AS l1 FROM pb""")
def epoch_loss(spark, sf):
    """Mean over the first epoch's batches of their rank losses and distances, for the noisy heights."""
    gaps = D.doc_encoding(spark, sf).gaps
    h = md5_bucket(F.concat_ws(":", F.col("tree_id").cast("string"), F.col("gap").cast("string")))
    g = gaps.select("tree_id", "gap", "d", (F.col("d") + (h % 7 - 3) * 0.3).alias("p"))
    pairs = L.pair_stats(g, "d", "p").select("tree_id", "n_pairs", "hinge", "hinge_exp")
    far = g.groupBy("tree_id").agg(F.sum(F.abs(F.col("p") - F.col("d"))).alias("off"), F.count(F.lit(1)).alias("n"))
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("tree_id"))
    rows = (O.minibatches(ids, "tree_id", 1).join(pairs, "tree_id", "left").join(far, "tree_id", "left")
            .na.fill(0, ["n_pairs", "hinge", "hinge_exp", "off", "n"]))
    return finish(O.mean_batch_loss(rows, "batch", {
        "rank_loss": (F.col("hinge"), F.col("n_pairs")), "rank_loss_exp": (F.col("hinge_exp"), F.col("n_pairs")),
        "l1": (F.col("off"), F.col("n"))}, eps={"rank_loss": RANK_LOSS_EPS, "rank_loss_exp": RANK_LOSS_EPS}))


@query("split_truncate", sql=f"""
SELECT doc_id, CASE WHEN rn < floor({SHARES[0]} * n) THEN 'train' WHEN rn < floor({SHARES[0]} * n) + floor({SHARES[1]} * n)
                    THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':{TRAIN_SEED}'), doc_id) - 1 AS rn,
             (count(*) OVER ())::DOUBLE AS n FROM documents)""")
def split_truncate(spark, sf):
    """Seeded shuffle of all documents, train and valid cut to whole numbers, the rest test."""
    return finish(U.truncate_split(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARES))
