"""Line deduplication across documents (native DataFrame operations only).

A line's key is the line stripped of white space at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in two or more documents
lose all their lines except in the smallest document id holding them.

Method: occurrences ``(hash, document, position)`` are range-partitioned by hash
and sorted by document and position, and the first document of each hash is
streamed off the order.  A frequent line does not land in one task: the range
key is ``(hash, salt of the document)``, so its occurrences are cut into up to
``SALTS`` runs.  Within a run every occurrence after the first document's goes at
once; only the occurrences in the first document of each run (so at most ``SALTS``
documents a hash) are shuffled once more, to find the first run.  What comes back is
one run-length compressed keep bitmap per document that loses lines, never text.

Cases: null or empty text is one empty line (too short to be dropped).  Rows
with the same id are the same document.  A null id is one document that orders
after all others.  Rows alike in id and text give the same result, once each.
An empty table gives an empty result.  Other columns pass through under any name;
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lignum.llm.common import UPPER, WHITESPACE, row_key, same_row, stored, text_of

MIN_CHARS = 10
SALTS = 1024


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), UPPER, UPPER.lower())


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that can be dropped: ``_id, _fp, h1, h2, doc, pos``.

    ``doc`` orders documents (null last); two 64-bit hashes stand for the key.
    """
    text = text_of(F.col(text_col))
    lines = docs.select(*row_key(F.col(id_col), text),
                        F.posexplode(split_lines(text)).alias("pos", "line"))
    # length() >= min_chars is necessary before the costlier key is made
    keyed = (lines.where(F.length("line") >= min_chars)
             .select("_id", "_fp", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars))
    return keyed.select("_id", "_fp", "pos",
                        F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id")).alias("doc"),
                        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def dropped_lines(occ: DataFrame, salts: int = SALTS) -> DataFrame:
    """Occurrences that go: their hash has a smaller document elsewhere."""
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos")
    run = salted.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first("doc").over(stream))
    later = run.where(F.col("doc") > F.col("first"))
    heads = run.where(F.col("doc") == F.col("first")).withColumn(
        "smallest", F.min("doc").over(Window.partitionBy("h1", "h2")))
    beaten = heads.where(F.col("doc") > F.col("smallest"))
    return later.select("_id", "_fp", "pos").unionByName(beaten.select("_id", "_fp", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """``_id, _fp, drop_from, drop_len, n_dropped`` per document that loses lines.

    ``drop_from[i]`` and ``drop_len[i]`` are the runs of zeros of the document's
    keep bitmap (all other bits are one): the bitmap, run-length compressed.
    """
    # written once: the range partitioner samples its input, and the order is read twice
    occ = stored(occurrences(docs, id_col, text_col, min_chars), "lines")
    gone = dropped_lines(occ, salts)
    pos = gone.groupBy("_id", "_fp").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    runs = pos.select("_id", "_fp", F.size("p").cast("long").alias("n_dropped"),
                      starts.alias("drop_from"), ends.alias("drop_to"))
    return runs.select("_id", "_fp", "n_dropped", "drop_from",
                       F.zip_with("drop_from", "drop_to", lambda a, b: b - a + 1).alias("drop_len"))


def keep_flags(n: Column, drop_from: Column, drop_len: Column) -> Column:
    """The bitmap of ``n`` lines as an array of booleans."""
    before = F.transform(drop_from, lambda x, i: x - F.when(
        i > 0, F.get(drop_from, i - 1) + F.get(drop_len, i - 1)).otherwise(0))
    runs = F.zip_with(before, drop_len, lambda k, d: F.concat(
        F.array_repeat(F.lit(True), k), F.array_repeat(F.lit(False), d)))
    tail = n - F.coalesce(F.element_at(drop_from, -1) + F.element_at(drop_len, -1), F.lit(0))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(True), tail))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, salts)
    text = text_of(F.col(text_col))
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # the columns of the input travel as one, so that none can clash with a working column
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *row_key(F.col(id_col), text),
                       text.alias("_text"))
    joined = left.join(maps, same_row(left, maps), "left").select(
        left["_row"], left["_text"], maps["drop_from"].alias("_from"), maps["drop_len"].alias("_len"),
        F.coalesce(maps["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"))
    lined = joined.withColumn("_lines", split_lines(F.col("_text")))
    flagged = lined.withColumn("_keep", F.when(F.col("_from").isNotNull(), keep_flags(
        F.size("_lines"), F.col("_from"), F.col("_len"))))
    kept = F.when(F.col("_from").isNull(), F.col("_text")).otherwise(
        F.array_join(F.filter("_lines", lambda x, i: F.get("_keep", i)), "\n"))
    done = flagged.withColumns({"kept_text": kept, "n_lines": F.size("_lines").cast("long")})
    return done.select("_row.*", "kept_text", "n_lines", "n_dropped")
