"""Mixing sources to target weights by blocks.

Method: a source's words, its documents one after the other in a pseudorandom
order, are cut into blocks of ``BLOCK`` words.  A source with a quota of ``Q``
words and ``S`` words of its own fills ``Q div S`` passes over all its blocks and
a last pass over some of them.  Its slots are dealt to ``SHARDS`` output shards by a
multinomial draw of the shards' counts.  Slot ``j`` of a pass is block ``(a j + b) mod n``
with ``a`` prime to ``n`` and ``b`` of the pass: a permutation of the source's blocks.
Slots and blocks meet in a join by block index, and every word of the mix comes
through it; the last slot is cut so that the quota is met to the word.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; they
share 150 % of all sizes by weight, stop at twice their size, and what is left
over is shared again by weight until none is above.

Running offsets within a source are sums over hash buckets of rows, then
within a bucket, so that no source is ordered in one task.  Only one row per
source and bucket or shard, and scalars, are ever gathered.

Cases: a document without words has size 0 and is never taken.  Null ids, ids
that repeat and repeated rows are rows of their own (rows alike in id and text
are interchangeable).  Columns of any other name pass through
``mixed_documents``.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lignum.llm.common import GAP, WHITESPACE, WORD, stored, text_of, working_names
from lignum.operators.order import row_numbers
from lignum.ship import ensure_shipped

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 64
BUCKETS = 512
SHARDS = 256
SEED = 20
# Multipliers of the permutations; a count below their product is prime to one of them.
PRIMES = (1000003, 15485863, 32452843, 49979687, 67867967)
RUN = 65_536


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          row: str | None = None) -> DataFrame:
    """``doc_id, source, size`` in words, a hash ``fp`` of the text and a number ``row`` of the row (that of the
    column named, else a number that holds once the result is stored)."""
    text = text_of(F.col(f"`{text_col}`"))
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("fp"),
                       number.alias("row"))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank in code point order, null last."""
    return row_numbers(sources, F.col("source").asc_nulls_last(), name="rank")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` (double): shared by weight, stopped at ``cap`` times the size."""
    per = stored(ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    # `level` words for each unit of weight; a source stops once its share reaches its most
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most") if stopped >= 0 else F.lit(False)
        n, held, open_weight = per.agg(
            F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == stopped or not open_weight:
            break
        stopped, level = n, (total - held) / open_weight
    return per.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def placed(sized: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``sized`` plus ``begin``: where the row starts in its source's stream of words."""
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("fp"))
    rows = sized.where(F.col("size") > 0).withColumns({"_o": order, "_b": F.pmod(order, F.lit(buckets))})
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    # one row per source and bucket
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("source", "_b").orderBy("_o", "doc_id", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
            .select("row", "doc_id", "source", "size", (F.col("_start") + F.col("_in")).alias("begin")))


def quotas(goal: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per source: whole passes, words left to draw, number of blocks, and its permutation ``a, b``."""
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * CAP)
    q = goal.where(F.col("source_size") > 0).select(
        F.col("source").alias("qs"), F.col("source_size").alias("words"), quota.alias("quota"))
    n = F.ceil(F.col("words") / block).cast("long")
    q = q.withColumns({"passes": F.floor(F.col("quota") / F.col("words")).cast("long"),
                       "rest": F.col("quota") % F.col("words"), "n": n})
    # a prime that does not divide n is prime to it
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("qs")), F.lit(len(PRIMES)))
    tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(PRIMES) - 1)), lambda i: F.get(
        primes, ((i + at) % len(PRIMES)).cast("int"))), lambda p: F.col("n") % p != 0)
    # slots of the last pass that may hold words
    last = F.when(F.col("rest") > 0, F.least(F.col("n"), F.ceil(F.col("rest") / block).cast("long") + 1)).otherwise(0)
    return q.withColumns({"a": F.get(tries, F.lit(0)), "slots": F.col("passes") * F.col("n") + last})


def permuted(j: Column, a: Column, b: Column, n: Column) -> Column:
    """Block of slot ``j`` of a pass; the product has up to 38 digits."""
    wide = j.cast("decimal(19,0)") * a.cast("decimal(19,0)") % n.cast("decimal(19,0)")
    return (wide.cast("long") + b) % n


@F.pandas_udf(T.ArrayType(T.LongType()))
def multinomial(seed: pd.Series, slots: pd.Series, shards: pd.Series) -> pd.Series:
    """Ends of the shards' runs of slots: cumulative counts of a multinomial draw with equal chances."""
    return pd.Series([np.random.default_rng(abs(s)).multinomial(n, np.full(k, 1 / k)).cumsum()
                      for s, n, k in zip(seed, slots, shards, strict=True)], dtype=object)


def slots(q: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every slot ``j`` of every ``pass``: its ``shard`` and the block ``index`` that it takes."""
    ensure_shipped(q.sparkSession)
    ends = multinomial(F.xxhash64(F.lit(seed + 2), F.col("qs")), F.col("slots"), F.lit(shards))
    # one row per source and shard, then runs, so that a large source's slots are not one row's work
    per = (q.where(F.col("slots") > 0).withColumn("_ends", ends)
           .select("qs", "words", "passes", "rest", "n", "a", "_ends", F.posexplode("_ends").alias("shard", "_to"))
           .withColumn("_from", F.when(F.col("shard") > 0, F.get("_ends", F.col("shard") - 1)).otherwise(0))
           .drop("_ends").where(F.col("_from") < F.col("_to")))
    runs = per.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(
        (F.col("_to") - F.col("_from") - 1) / RUN).cast("long")))).repartition("qs", "shard", "_run")
    first = F.col("_from") + F.col("_run") * RUN
    each = runs.withColumn("_g", F.explode(F.sequence(first, F.least(first + RUN, F.col("_to")) - 1)))
    each = each.withColumn("pass", F.floor(F.col("_g") / F.col("n")).cast("long")).withColumn("j", F.col("_g") % F.col("n"))
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("qs"), F.col("pass")), F.col("n"))
    short = F.col("words") - (F.col("n") - 1) * block
    return each.select("qs", "pass", "j", "shard", "passes", "rest", "n", short.alias("short"),
                       permuted(F.col("j"), F.col("a"), shift, F.col("n")).alias("index"))


def drawn(q: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Slots with the words each takes: whole blocks, and in the last pass a cut one where the quota is met."""
    s = slots(q, block, shards, seed)
    is_last = F.col("index") == F.col("n") - 1
    # the last pass may meet the source's short block: one row a source
    where = s.where(is_last & (F.col("pass") == F.col("passes"))).select(F.col("qs").alias("_ls"), F.col("j").alias("_lj"))
    s = s.join(where, F.col("qs").eqNullSafe(F.col("_ls")), "left")
    before = F.col("j") * block - F.when(F.col("_lj") < F.col("j"), block - F.col("short")).otherwise(0)
    length = F.when(is_last, F.col("short")).otherwise(F.lit(block))
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - before))
    return s.withColumn("take", take).where(F.col("take") > 0).select("qs", "pass", "index", "take", "shard", "j")


def mix(sized: DataFrame, goal: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Parts of the mix ``row, doc_id, source, size, pass, word_from, word_to, shard``: half-open word ranges of rows."""
    q = stored(quotas(goal, block, seed), "quotas")
    docs = stored(placed(sized), "placed")
    end = F.col("begin") + F.col("size")
    blocks = docs.withColumn("index", F.explode(F.sequence(
        F.floor(F.col("begin") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    picked = drawn(q, block, shards, seed).withColumnRenamed("index", "_i")
    # slots are made from a small table, but they grow with the words: never broadcast
    joined = blocks.join(picked.hint("merge"), F.col("source").eqNullSafe(F.col("qs")) & (F.col("index") == F.col("_i")))
    lo = F.greatest(F.col("begin"), F.col("index") * block)
    hi = F.least(end, F.col("index") * block + F.col("take"))
    return joined.where(lo < hi).select("row", "doc_id", "source", "size", "pass", (lo - F.col("begin")).alias("word_from"),
                                        (hi - F.col("begin")).alias("word_to"), "shard")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    goal = stored(targets(sized), "targets")
    got = (mix(sized, goal).groupBy(F.col("row").alias("_r")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_t")))
    goal = goal.withColumnRenamed("source", "_g")
    return (sized.join(goal, F.col("source").eqNullSafe(F.col("_g"))).join(got, F.col("row") == F.col("_r"), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce(F.col("_t"), F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes words of a document, with the text of these words.

    A pass that takes all of a text gives it as it is; otherwise the taken stretches keep the white space
    inside them, and stretches that do not meet are joined by line ends.
    """
    key, passes, one, words = working_names(docs, "_row", "_all", "_one", "_words")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows", "zstd")
    sized = stored(sizes(rows, id_col, text_col, source_col, key), "sizes")
    parts = mix(sized, stored(targets(sized), "targets"))
    spans = parts.groupBy("row", "pass", "size").agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("n"),
        F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("cut"))
    spans = spans.groupBy(F.col("row").alias(key)).agg(F.array_sort(F.collect_list(
        F.struct("pass", (F.col("n") == F.col("size")).alias("whole"), "cut"))).alias(passes))
    text = F.col(f"`{text_col}`").cast("string")
    # a word with the white space after it
    with_gaps = F.when(F.exists(passes, lambda p: ~p["whole"]), F.regexp_extract_all(text, F.lit(f"{WORD}(?:{GAP})?"), F.lit(0)))
    each = rows.join(spans, key).withColumn(words, with_gaps).withColumn(one, F.explode(passes))
    cut = F.col(one)["cut"]
    stretch = F.transform(cut, lambda c, i: F.concat(
        F.when((i > 0) & (F.get(cut, i - 1)["word_to"] != c["word_from"]), "\n").otherwise(""),
        F.array_join(F.slice(F.col(words), c["word_from"].cast("int") + 1, (c["word_to"] - c["word_from"]).cast("int")), "")))
    part = F.when(F.col(one)["whole"], text).otherwise(F.rtrim(F.array_join(stretch, ""), F.lit(WHITESPACE)))
    return each.select(*[part.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
