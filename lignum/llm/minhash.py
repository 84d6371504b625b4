"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is a bag of word shingles (five words); a shingle weighs its count
times an inverse document frequency.  ``BANDS * ROWS`` consistent weighted
samples (Ioffe's improved scheme) are drawn per document, so that two documents
agree on a sample with the probability of their weighted Jaccard similarity.
Bands of ``ROWS`` samples name buckets; documents that share a bucket are
candidates, and every link is verified by the exact weighted Jaccard similarity.

Document frequencies cover all documents.  With ``N`` documents the idf of a shingle is
``1 + ln(N / df) / ln(N)``: 2 for one of a single document, 1 for one that every
document holds.  Shingles that hold at least ``1 / COMMON`` of all (document, shingle)
pairs, at most ``COMMON`` of them, are counted exactly by hash buckets first and the
shingles of full buckets after, and lie in memory.  The frequencies of all rarer
shingles of candidates are counted and joined by a shuffle, so every link is verified
with exact weights.  Only the samples take rarer shingles for unique ones.

Exact copies share one representative (the smallest id).  In every bucket the
smallest member is compared with the others, which costs one pair a member.  A
bucket that still holds more than one class is closed inside tasks: there, members
of different classes are compared exactly over a common list of shingles, and only
links that join two classes come out.  Buckets of more than ``BLOCK`` members are
cut into blocks, and every two blocks are one task's work.  So no pair of a bucket
that could join two classes is skipped, and no pairs are written.

Cases: null, empty and word-less texts are alike to nothing (each its own
class).  A text of fewer than five words is one shingle of all its words.  Rows
with a null id found no class: one that copies a text with an id comes back with that
text's class, any other with a null class, and both as kept (number the rows first, as
the pipeline does, to have them removed).  Rows alike in id and text come back once
each; rows with one id and different texts are compared under that id and share a class.
Memory grows with the longest text (all its shingles are one value).  An empty table
gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import giving_back, stored
from lignum.llm.components import components
from lignum.llm.hashing import U, bitmap, in_bitmap, mix, portions, shingles, utf8
from lignum.ship import ensure_shipped

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
COMMON = 1 << 16
BUCKETS = 1 << 20
CHUNK = 1 << 10  # counts of buckets that travel in one row
BLOCK = 512
SEED = 11


def _in_rows(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Order of ``h`` within each row (``row`` does not fall): one sort by the row above the first bits of ``h``."""
    bits = U(max(int(rows).bit_length(), 1))
    key = (row.astype(U) << (U(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key = key[order]
    tied = key[1:] == key[:-1]
    if (tied & (h[order[1:]] != h[order[:-1]])).any():  # alike in all bits of the key
        return np.lexsort((h, row))
    return order


def _unique(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted; their counts; how many each row has."""
    row = np.repeat(np.arange(len(count)), count)
    h = h[_in_rows(h, row, len(count))]  # rows keep their places
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return h[at], tf, np.bincount(row[at], minlength=len(count))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(44)).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def common_shingles(texts: DataFrame, width: int = WIDTH, common: int = COMMON) -> tuple[dict[int, int], int, int]:
    """``(frequency of each common shingle, least frequency, documents with words)``; at most ``common`` entries."""

    def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in portions(batch, 1):
                h, _tf, n = _unique(*shingles(*utf8(part.column(1)), width))
                counts[:BUCKETS] += np.bincount(_bucket(h), minlength=BUCKETS)
                counts[BUCKETS] += int((n > 0).sum())
        for lo in np.unique(np.flatnonzero(counts) // CHUNK).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lo], pa.int64()), pa.array([counts[lo * CHUNK:(lo + 1) * CHUNK].tobytes()], pa.binary())], ["chunk", "counts"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")]
        n = np.sum(parts, axis=0)
        some = np.flatnonzero(n)
        return pa.table({"b": pa.array(some + key[0].as_py() * CHUNK, pa.int64()), "n": pa.array(n[some], pa.int64())})

    # a task's counts travel in runs of buckets, not in a row for each
    runs = texts.mapInArrow(giving_back(bucket_counts), "chunk long, counts binary")
    buckets = stored(runs.groupBy("chunk").applyInArrow(added, "b long, n long"), "df")
    n_docs = sum(r.n for r in buckets.where(F.col("b") == BUCKETS).collect())
    pairs = buckets.where(F.col("b") < BUCKETS).agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-pairs // common))
    # at most `common` buckets hold that many pairs
    full = np.zeros(BUCKETS, bool)
    full[[r.b for r in buckets.where((F.col("b") < BUCKETS) & (F.col("n") >= least)).select("b").collect()]] = True
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(full))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_full = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            seen = []
            for part in portions(batch, 1):
                h, _tf, _n = _unique(*shingles(*utf8(part.column(1)), width))
                seen.append(h[is_full[_bucket(h)]])
            h, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    found = (texts.mapInArrow(giving_back(counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least).collect())  # at most `common` rows, since their sum is at most `pairs`
    return {r.h & (1 << 64) - 1: r.n for r in found}, least, n_docs


class Weights:
    """Idf of shingles."""

    def __init__(self, frequency: dict[int, int], least: int, n_docs: int):
        keys = np.array(sorted(frequency), U)
        df = np.array([frequency[int(k)] for k in keys], np.float64)
        scale = max(np.log(max(n_docs, 1) / least), 1e-9)
        self.keys, self.scale, self.n_docs = keys, scale, n_docs
        self.idf = np.clip(1 + np.log(max(n_docs, 1) / np.maximum(df, least)) / scale, 1.0, 2.0)

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), 2.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            idf[hit] = self.idf[at[hit]]
        return tf * idf

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which shingles have their frequency in memory."""
        if not len(self.keys):
            return np.zeros(len(h), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h

    def of_df(self, df: np.ndarray) -> np.ndarray:
        """Idf of shingles of these frequencies."""
        return np.clip(1 + np.log(max(self.n_docs, 1) / df) / self.scale, 1.0, 2.0)


def exact_weights(texts: DataFrame, width: int = WIDTH, common: int | None = None) -> Weights:
    """Weights by the frequencies in memory; ``with_frequencies`` brings all others."""
    frequency, _least, n_docs = common_shingles(texts, width, COMMON if common is None else common)
    return Weights(frequency, 1, n_docs)


def samples(h: np.ndarray, weight: np.ndarray, n: np.ndarray, k_samples: int, seed: int = SEED) -> np.ndarray:
    """Consistent weighted samples of each row (rows x samples, 64-bit names of (shingle, level)).

    Rows without shingles get zeros.
    """
    rows = np.flatnonzero(n)
    out = np.zeros((len(n), k_samples), U)
    if not len(rows):
        return out
    begin = np.concatenate(([0], np.cumsum(n)))[:-1][rows]
    sizes = n[rows]
    seeds = mix(np.arange(1, k_samples + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    log_w = np.log(weight).astype(np.float32)
    step, eps = 1 << 15, np.float32(2.0 ** -17)
    score = np.empty(len(h), np.float32)
    level = np.empty(len(h), np.float32)
    for k in range(k_samples):
        for lo in range(0, len(h), step):
            part = slice(lo, lo + step)
            x = mix(h[part] ^ seeds[k])
            y = x * U(0x94D049BB133111EB)
            y ^= y >> U(31)
            u = x.astype("<u8").view("<u2").reshape(-1, 4).astype(np.float32)
            u *= np.float32(2.0 ** -16)
            u += eps
            beta = (y >> U(40)).astype(np.float32) * np.float32(2.0 ** -24)
            r = -np.log(u[:, 0] * u[:, 1])  # Gamma(2, 1)
            log_c = np.log(-np.log(u[:, 2] * u[:, 3]))
            t = np.floor(log_w[part] / r + beta)
            level[part] = t
            score[part] = log_c - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(score, begin)
        hit = np.flatnonzero(score == np.repeat(least, sizes))
        owner = np.searchsorted(begin, hit, "right") - 1
        first = np.ones(len(hit), bool)
        first[1:] = owner[1:] != owner[:-1]
        hit = hit[first]
        out[rows, k] = mix(h[hit] * U(0xBF58476D1CE4E5B9) + level[hit].astype(np.int64).view(U) * U(0x94D049BB133111EB))
    return out


def signatures(texts: DataFrame, weights, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, copy`` (digest of the text), ``total`` (weight) and ``bands`` (bucket names; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                buf, off = utf8(part.column(1))
                h, tf, n = _unique(*shingles(buf, off, width))
                w = weights.value.of(h, tf)
                s = samples(h, w, n, bands * rows).reshape(len(n), bands, rows)
                name = np.zeros((len(n), bands), U)
                for r in range(rows):
                    name = mix(name * U(0x9E3779B97F4A7C15) + s[:, :, r])
                total = np.bincount(np.repeat(np.arange(len(n)), n), weights=w, minlength=len(n))
                raw = buf.tobytes()
                copy = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
                some = n > 0
                ends = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(copy, pa.binary()), pa.array(total, pa.float64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(name[some].reshape(-1).view(np.int64)))],
                    ["id", "copy", "total", "bands"])

    return texts.mapInArrow(giving_back(run), "id long, copy binary, total double, bands array<long>")


def vectors(texts: DataFrame, ids, width: int = WIDTH) -> DataFrame:
    """``id, h`` of the documents in the bitmap ``ids`` (and a few more): sorted shingles (64-bit, repeated
    as often as they occur) as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            known = known.filter(pa.array(in_bitmap(ids.value, known.column(0).to_numpy().view(U))))
            for part in portions(known, 1):
                h, n = shingles(*utf8(part.column(1)), width)
                row = np.repeat(np.arange(len(n)), n)
                h = h[_in_rows(h, row, len(n))]
                ends = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "h"])

    return texts.mapInArrow(giving_back(run), "id long, h binary")


def with_frequencies(vecs: DataFrame, texts: DataFrame, weights, width: int = WIDTH) -> DataFrame:
    """``id, h, total`` plus ``at, df``: places (among the distinct shingles) and document frequencies of the
    shingles that are not in memory and that more than one document holds."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hs = [np.unique(np.frombuffer(x.as_buffer(), U)) for x in part.column(2)]
                at = [np.flatnonzero(~weights.value.holds(h)) for h in hs]
                owner = pa.array(np.repeat(np.arange(len(hs)), [len(a) for a in at]))
                h = np.concatenate([h[a] for h, a in zip(hs, at, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner),
                     pa.array(np.concatenate(at).astype(np.int32)), pa.array(h.view(np.int64))], ["id", "fp", "at", "h"])

    keyed = vecs.select("id", F.xxhash64("h").alias("fp"), "h")
    asked = stored(keyed.mapInArrow(giving_back(rare), "id long, fp long, at int, h long"), "asked")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(asked.select("h")))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, U)]
            for part in portions(batch, 1):
                h, _tf, _n = _unique(*shingles(*utf8(part.column(1)), width))
                h = h[in_bitmap(wanted.value, h)]
                seen.append(h[~weights.value.holds(h)])
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    df = texts.mapInArrow(giving_back(counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("df")).where("df > 1")
    found = asked.join(df.hint("merge"), "h").groupBy("id", "fp").agg(F.collect_list(F.struct("at", "df")).alias("f"))
    found = found.select(F.col("id").alias("_i"), F.col("fp").alias("_f"), F.col("f.at").alias("at"), F.col("f.df").alias("df"))
    joined = keyed.join(found, (F.col("id") == F.col("_i")) & (F.col("fp") == F.col("_f")), "left")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [float(w.sum()) for _h, w in _weighed(batch.column("h"), weights.value, batch.column("at"), batch.column("df"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64())], [*batch.schema.names, "total"])

    return joined.select("id", "h", "at", "df").mapInArrow(
        giving_back(totals), "id long, h binary, at array<int>, df array<long>, total double")


def _weighed(column: pa.Array, weights: Weights, at=None, df=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their weights of every row of ``h``; ``at, df`` as in ``with_frequencies``."""
    out = []
    for k, x in enumerate(column):
        h, tf = np.unique(np.frombuffer(x.as_buffer(), U), return_counts=True)
        w = weights.of(h, tf)
        if at is not None and at[k].is_valid:
            here = at[k].values.to_numpy()
            w[here] = tf[here] * weights.of_df(df[k].values.to_numpy())
        out.append((h, w))
    return out


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    _h, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    union = wa.sum() + wb.sum() - both
    return float(both / union) if union > 0 else 0.0


def verified(pairs: DataFrame, vecs: DataFrame, weights, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``u, v`` whose exact weighted Jaccard similarity reaches the threshold."""
    left = vecs.select(F.col("id").alias("u"), *[F.col(c).alias("u" + c) for c in ("h", "at", "df")])
    right = vecs.select(F.col("id").alias("v"), *[F.col(c).alias("v" + c) for c in ("h", "at", "df")])
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "uh", "uat", "udf", "vh", "vat", "vdf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, b = (_weighed(part.column(k), weights.value, part.column(k + 1), part.column(k + 2)) for k in (2, 5))
                keep = pa.array([weighted_jaccard(*x, *y) >= threshold for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["u", "v"])

    return both.mapInArrow(giving_back(run), "u long, v long")


def close_bucket(table: pa.Table, weights: Weights, threshold: float) -> pa.Table:
    """Links that join two classes among one bucket's two blocks (``id, component, block, bi, bj, h``)."""
    table = table.combine_chunks().sort_by("id")
    ids, classes, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    known = (table.column(c).combine_chunks() for c in ("at", "df")) if "at" in table.column_names else ()
    vecs = _weighed(table.column("h").combine_chunks(), weights, *known)
    size = np.array([len(v[0]) for v in vecs])
    names, cols = np.unique(np.concatenate([v[0] for v in vecs]), return_inverse=True)
    wts = np.concatenate([v[1] for v in vecs])
    begin = np.cumsum(size) - size
    total = np.add.reduceat(wts, begin)
    _names, group = np.unique(classes, return_inverse=True)  # class of each member, as links join them
    mine = np.zeros(len(names))
    u, v = [], []
    for i in np.flatnonzero(block == bi):
        others = (group != group[i]) & (block == bj)
        if not others.any():
            continue
        own = cols[begin[i]:begin[i] + size[i]]
        mine[own] = vecs[i][1]
        both = np.add.reduceat(np.minimum(mine[cols], wts), begin)
        mine[own] = 0.0
        near = np.flatnonzero(others & (both >= threshold * (total[i] + total - both)))
        for j in near:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                u.append(ids[i])
                v.append(ids[j])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _closing(weights, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        return close_bucket(table, weights.value, threshold)
    return run


def links(members: DataFrame, vecs: DataFrame, weights, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` that join all classes: see the module's text.  ``members``: ``bucket, id, total``."""
    members = members.drop("total").join(vecs.groupBy("id").agg(F.max("total").alias("total")), "id")
    least = members.groupBy("bucket").agg(F.min_by(F.struct("id", "total"), "id").alias("c"))
    # weights alone bound the similarity
    alike = F.least("total", "ct") >= threshold * F.greatest("total", "ct")
    pairs = (members.join(least, "bucket").where(F.col("id") != F.col("c.id"))
             .select(F.col("c.id").alias("u"), F.col("id").alias("v"), "total", F.col("c.total").alias("ct"))
             .where(alike).select("u", "v").distinct())
    edges = stored(verified(pairs, vecs, weights, threshold), "links")
    now = (members.join(components(edges).withColumnRenamed("node", "id"), "id", "left")
           .withColumn("component", F.coalesce("component", "id")))
    still = (now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
             .where(F.col("lo") < F.col("hi")).select("bucket", "blocks"))
    # buckets of the same members need closing once
    open_members = now.join(still, "bucket").select("bucket", "blocks", "id", "component")
    same = open_members.groupBy("bucket").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"),
                                              F.count(F.lit(1)).alias("n"))
    once = same.groupBy("sum", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_members = open_members.join(once, "bucket", "left_semi")
    blocked = open_members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = stored(blocked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "id", "component", "block", F.least("block", "_o").alias("bi"),
        F.greatest("block", "_o").alias("bj")), "open")
    more = (met.join(vecs.drop("total"), "id").groupBy("bucket", "bi", "bj")
            .applyInArrow(_closing(weights, threshold), "u long, v long"))
    return edges.unionByName(stored(more, "more"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id`` (smallest id of the class), ``kept`` (the document stands for its class)."""
    spark = docs.sparkSession
    ensure_shipped(spark)
    texts = _texts(docs, id_col, text_col)
    weights = spark.sparkContext.broadcast(exact_weights(texts, width))
    signed = stored(signatures(texts, weights, width, bands, rows), "signed")
    some = signed.where(F.col("id").isNotNull() & (F.size("bands") > 0))
    copies = stored(some.groupBy("copy").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"),
                                             F.first("total").alias("total")), "copies")
    buckets = copies.select(F.col("rep").alias("id"), "total", F.posexplode("bands").alias("band", "name"))
    buckets = buckets.select(F.struct("band", "name").alias("bucket"), "id", "total").distinct()
    shared = buckets.groupBy("bucket").count().where(F.col("count") > 1).select("bucket")
    members = stored(buckets.join(shared, "bucket", "left_semi"), "members")
    wanted = spark.sparkContext.broadcast(bitmap(members.select("id")))
    vecs = stored(with_frequencies(stored(vectors(texts, wanted, width), "shingles"), texts, weights, width), "vectors")
    labels = components(links(members, vecs, weights, threshold))
    classes = (copies.select("copy", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
               .select(F.col("copy").alias("c"), F.coalesce("component", "rep").alias("class_id")))
    out = signed.join(classes, (F.col("copy") == F.col("c")) & (F.size("bands") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), F.when(F.size("bands") > 0, F.col("class_id"))
                      .otherwise(F.col("id")).alias("class_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
