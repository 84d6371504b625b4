"""Corpus curation.

Skew: a dedupe key or a language may hold a large share of the rows, so
dedupe is a partial (map-side) ``max_by`` aggregate rather than a window,
and the per-language cap counts rows by the first digits of the order key,
keeps the digits that can reach the cap and ranks only those rows, so no task
ever sorts a whole language.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lignum.functions.columns import md5_bucket, seeded_order_key
from lignum.functions.constants import (DATASET_SEED, MAX_LENGTH, SAMPLE_CAP, SPECIAL_TOKENS, TEST_FRACTION,
                                        TRAIN_SEED, VALID_FRACTION)
from lignum.operators.order import row_numbers


def dedupe_last(df: DataFrame, key: Column | str, order: Column | str) -> DataFrame:
    """One row per key, the one with the largest ``order`` (last write wins)."""
    key = F.col(key) if isinstance(key, str) else key
    order = F.col(order) if isinstance(order, str) else order
    cols = df.columns
    best = (df.select(key.alias("_k"), order.alias("_o"), F.struct(*cols).alias("_r"))
            .groupBy("_k").agg(F.max_by("_r", "_o").alias("_r")))
    return best.select("_r.*")


def allowlist_join(allow: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """List-driven inner join; duplicate list entries give duplicate rows."""
    return allow.join(corpus, key, "inner")


def length_filter(df: DataFrame, counts: list[Column], max_length: int = MAX_LENGTH) -> DataFrame:
    """``max_subtokens`` over the tokenizers (``counts``: a row's sub-tokens under each) and ``keep`` (fits
    with specials); one scan, rows stay rows."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return (df.withColumn("max_subtokens", most)
            .withColumn("keep", F.col("max_subtokens") + SPECIAL_TOKENS <= max_length))


NODES = "array<struct<node_id:int,parent_id:int,type:string,is_terminal:boolean,start:int,end:int>>"


def guarded(parse: Callable[[list], list[tuple]], nodes: str = NODES):
    """``parse`` as a column function with an error channel: ``(nodes, failure)``, never an exception.

    A row that ``parse`` raises on has null nodes and the exception's text; a null input fails as well.
    """
    @F.pandas_udf(f"nodes {nodes}, failure string")
    def run(column: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for value in column:
            try:
                if value is None:
                    raise ValueError("null input")
                out.append((parse(value), None))
            except Exception as e:  # noqa: BLE001  (the channel is for any failure of a row)
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["nodes", "failure"])
    return run


def has_error_node(nodes: Column, error_type: str = "ERROR") -> Column:
    """B7 on a row's array of nodes."""
    return F.exists(nodes, lambda n: n["type"] == error_type)


def is_one_tree(nodes: Column) -> Column:
    """B8 on a row's array of nodes with ids in preorder: distinct ids, one root, and every other node below an
    earlier one."""
    ids = F.transform(nodes, lambda n: n["node_id"])
    roots = F.size(F.filter(nodes, lambda n: n["parent_id"].isNull()))
    below = F.forall(nodes, lambda n: n["parent_id"].isNull()
                     | ((n["parent_id"] < n["node_id"]) & F.array_contains(ids, n["parent_id"])))
    return (roots == 1) & (F.size(F.array_distinct(ids)) == F.size(ids)) & below


def curated(df: DataFrame, parsed: Column, counts: list[Column], max_length: int = MAX_LENGTH) -> DataFrame:
    """The composed filter.  ``df`` with ``nodes``, ``max_subtokens``, ``keep`` and ``reason``.

    ``parsed`` is a ``guarded`` parse.  The first test a row fails gives its reason: the parser's failure, an
    error node, not one tree, too long.  Rows stay rows, nothing is shuffled, no row fails the job.
    """
    p = length_filter(df.withColumn("_parsed", parsed), counts, max_length).withColumn("nodes", F.col("_parsed.nodes"))
    reason = (F.when(F.col("nodes").isNull(), F.concat(F.lit("parse: "), F.col("_parsed.failure")))
              .when(has_error_node(F.col("nodes")), "error node").when(~is_one_tree(F.col("nodes")), "not a tree")
              .when(~F.col("keep"), "too long"))
    return p.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull()).drop("_parsed")


PREFIX = 3  # hex digits of the order key: at most 4096 counts a group


def sample_cap(df: DataFrame, id_col: str, group: str = "lang", cap: int = SAMPLE_CAP,
               seed: int = DATASET_SEED) -> DataFrame:
    """S3: seeded shuffle then the first ``cap`` rows per group (``rn`` is 1-based)."""
    keyed = df.withColumn("_h", seeded_order_key(F.col(id_col), seed)).withColumn("_p", F.substring("_h", 1, PREFIX))
    before = W.partitionBy("_g").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    reach = (keyed.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .where(F.col("_b") < cap).select("_g", "_q"))
    near = keyed.join(reach, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left_semi")
    w = W.partitionBy(group).orderBy("_h", F.col(id_col))
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("_h", "_p")


def assign_splits(capped: DataFrame, group: str = "lang", test: float = TEST_FRACTION,
                  valid: float = VALID_FRACTION) -> DataFrame:
    """Split by the shuffled rank ``rn``: test = ceil(test * n), valid = ceil(valid * (n - test)), rest
    train (test first)."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    df = capped.withColumn("_n", n)
    n_test = F.ceil(F.col("_n") * test - 1e-9)
    n_valid = F.ceil((F.col("_n") - n_test) * valid - 1e-9)
    split = (F.when(F.col("rn") <= n_test, "test")
             .when(F.col("rn") <= n_test + n_valid, "valid").otherwise("train"))
    return df.withColumn("split", split).drop("_n")


def truncate_split(df: DataFrame, id_col: str, shares: tuple[float, float], seed: int = TRAIN_SEED) -> DataFrame:
    """Seeded shuffle of all rows, then the first ``int(shares[0] * n)`` train, the next
    ``int(shares[1] * n)`` valid and the rest test.  Ranks are global and no task sorts all rows."""
    shuffled = df.withColumn("_h", seeded_order_key(F.col(id_col), seed))
    ranked = row_numbers(shuffled, "_h", id_col, name="_rank")
    n = df.count()
    n_train, n_valid = int(shares[0] * n), int(shares[1] * n)
    split = (F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_valid, "valid").otherwise("test"))
    return ranked.withColumn("split", split).drop("_h", "_rank")


def hash_split(key: Column | str, seed: int = DATASET_SEED, test: float = TEST_FRACTION,
               valid: float = VALID_FRACTION) -> Column:
    """Split of a row by the seeded hash of its key alone: the shares hold in expectation, no row is
    ranked and none is left out, so any number of rows per language is split alike."""
    key = F.col(key) if isinstance(key, str) else key
    h = md5_bucket(F.concat(key.cast("string"), F.lit(f":{seed}"))) / F.lit(float(16 ** 6))
    return (F.when(h < test, "test").when(h < test + valid * (1 - test), "valid").otherwise("train"))


def exclude_langs(df: DataFrame, exclude, lang_col: str = "lang") -> DataFrame:
    """B11."""
    return df.where(~F.col(lang_col).isin(list(exclude)))


def split_sizes(n: int, test: float = TEST_FRACTION, valid: float = VALID_FRACTION) -> tuple[int, int, int]:
    """Reference sizes of the exact split for a group of ``n`` samples."""
    n_test = math.ceil(n * test - 1e-9)
    n_valid = math.ceil((n - n_test) * valid - 1e-9)
    return n - n_test - n_valid, n_test, n_valid
