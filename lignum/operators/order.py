"""Global row numbers without a one-task sort, and seeded minibatches on top of them.

Row numbers are made on two levels: range partitions are sorted side by side, a
row's place inside its partition is known there, and a prefix sum over the
number of rows per partition (one row a partition) gives where each begins.
The sorted rows are written once below ``spark.checkpoint.dir``, so places and
counts are of the same rows and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lignum.functions.columns import seeded_order_key
from lignum.functions.constants import BATCH_SIZE, TRAIN_SEED
from lignum.session import ensure_checkpoint_dir

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits of place


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lignum-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the dense place (from 0) of each row in ``order``.

    ``order`` should not tie for many rows: rows that tie in all of it share a range partition.
    """
    place = f"_place_{uuid.uuid4().hex[:8]}"
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(sorted_rows.withColumn(place, F.monotonically_increasing_id()), "order")
    part = F.shiftright(F.col(place), 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition: the only window without a key
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.join(begins, part == F.col("_part"))
            .select(*[F.col(f"`{c}`") for c in df.columns if c != name],
                    (F.col("_before") + F.col(place).bitwiseAND(F.lit(_IN_PARTITION))).alias(name)))


def minibatches(df: DataFrame, id_col: str, epoch: int, size: int = BATCH_SIZE, seed: int = TRAIN_SEED) -> DataFrame:
    """``df`` with ``batch`` and ``slot``: a fresh seeded permutation for every epoch, cut into
    batches of exactly ``size`` rows (the last one holds the rest).  ``id_col`` is unique."""
    key = f"_key_{uuid.uuid4().hex[:8]}"
    shuffled = df.withColumn(key, seeded_order_key(F.concat(F.col(id_col).cast("string"), F.lit(f"#{epoch}")), seed))
    ranked = row_numbers(shuffled, key, id_col, name="_rank")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("batch", "slot")]
    return ranked.select(*kept, F.floor(F.col("_rank") / size).alias("batch"), (F.col("_rank") % size).alias("slot"))


def mean_batch_loss(rows: DataFrame, batch: str, parts: dict[str, tuple[Column, Column]],
                    eps: dict[str, float] | None = None) -> DataFrame:
    """Per batch each loss is a ratio of sums (numerator, denominator) over its rows, and the epoch's
    loss is the mean of its batches, the ragged last one counted like any other.

    ``eps`` is added to a loss's denominator; without it an empty denominator counts as one.
    """
    sums = [F.sum(x).alias(f"_{k}_{i}") for k, pair in parts.items() for i, x in enumerate(pair)]

    def ratio(k: str) -> Column:
        below = F.col(f"_{k}_1")
        below = below + eps[k] if eps and k in eps else F.greatest(below, F.lit(1))
        return (F.col(f"_{k}_0") / below).alias(k)
    per_batch = rows.groupBy(batch).agg(*sums).select(batch, *[ratio(k) for k in parts])
    return per_batch.agg(F.count(F.lit(1)).alias("n_batches"), *[F.avg(k).alias(k) for k in parts])
