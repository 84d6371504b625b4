"""Phrase collocations by direct-address tiles over frequency-ranked ids.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and
pieces into words at blanks and tabs.  Everything is counted per language.

1. Words are counted; those found at least ``min_count`` times get ids by falling
   frequency, over all languages (an id stands for a word of one language).
2. Texts become sequences of ids, broken at piece ends and at rarer words (no
   phrase with a rare word can be frequent).
3. Adjacent pairs of ids are counted by tiles of 1024 x 1024 ids: as ids are ranked
   by frequency, the pairs of a round crowd into few tiles.  A crowded tile is a dense
   ``numpy.bincount`` addressed by the pair itself, the others are sorted
   coordinates.  Partial counts are summed by Spark.
4. Frequent pairs are ranked again, each place of the sequences takes the id of the
   pair that begins there, and step 3 is repeated: a pair of overlapping pairs is a
   phrase of three words, and so on up to ``longest`` words.

Ids reach the sequences in two ways: the ``head`` most frequent of a level ride in a
broadcast of a fixed size, all rarer ones are joined by a shuffle of the distinct
symbols of each stretch of a sequence.  Nothing is capped: every frequent phrase of
every level is found, counts are exact, and scores are integers of 38 digits.

Hot keys: counts are summed inside tasks before any shuffle, so a frequent word or
pair is one row a task.  Memory of a task: about 100 bytes a byte of a portion of
texts (``PORTION``, or the longest single text).

Cases: a null language is ``und``; null and empty texts have no words; repeated rows
count each time; ids of documents are not read, nor are other columns.  An empty
table, or one without any frequent phrase, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lignum.llm.common import stored
from lignum.llm.hashing import M1, M2, U, Prefix, bitmap, in_bitmap, mix, portions, utf8, word_spans
from lignum.operators.order import row_numbers
from lignum.ship import ensure_shipped

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
HEAD = 1 << 18      # ids in the broadcast of a level: 6 MB
TILE = 10           # bits: tiles of 1024 x 1024 ids
DENSE = 1 << 16     # pairs of a round in one tile from which the tile is dense
ROUND = 1 << 21     # pairs counted at once
PORTION = 2 << 20   # bytes of text handled at once
STRETCH = 1 << 8    # ids in a row of a sequence table, about

# What ends a piece, and what parts words inside it.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
WORD_GAPS = " \t"
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS.encode())] = True
_BREAKS = _ENDS.copy()
_BREAKS[list(WORD_GAPS.encode())] = True


def words(texts: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, ...]:
    """``buffer, begin, end, row, last, h1, h2`` of every word of some texts.

    ``lang`` is a hash of each row's language; ``last`` flags words that end their piece; two
    64-bit hashes stand for the word in its language.
    """
    buf, off = utf8(texts)
    buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    b, e, n = word_spans(buf, off, _BREAKS)
    row = np.repeat(np.arange(len(n)), n)
    ends = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ENDS[buf], out=ends[1:])
    last = np.ones(len(b), bool)
    last[:-1] = (ends[b[1:]] != ends[e[:-1]]) | (row[1:] != row[:-1])
    of = lang.view(U)[row]
    return buf, b, e, row, last, mix(Prefix(buf, M1).of(b, e) ^ of), mix(Prefix(buf, M2).of(b, e) + of)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of ``(lang, hash of lang, text)`` with their counts, and all words of each language as a null word."""
    names = ["lang", "k1", "k2", "word", "n"]
    for part in (p for batch in batches for p in portions(batch, 2, PORTION)):
        langs = part.column(0)
        buf, b, _e, row, _last, h1, h2 = words(part.column(2), part.column(1).to_numpy())
        if not len(b):
            continue
        order = np.argsort(h1, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        at = np.flatnonzero(new)
        first = order[at]
        # a word together with the breaks after it is a slice of the buffer
        whole = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(np.append(b, len(buf))), pa.py_buffer(buf.tobytes()))
        text = pc.ascii_rtrim(whole.take(pa.array(first)), characters=PIECE_ENDS + WORD_GAPS).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(row[first])), pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)),
             text, pa.array(np.diff(np.append(at, len(order))))], names)
        per = pc.value_counts(langs.take(pa.array(row)))
        k = len(per)
        yield pa.RecordBatch.from_arrays(
            [per.field(0), pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k, np.int64)),
             pa.nulls(k, pa.string()), per.field(1)], names)


@dataclass
class Head:
    """The most frequent symbols of a level: keys in order of a hash, and the id of each."""

    hashes: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    ids: np.ndarray
    most: int           # largest number of keys with one hash
    rest: bytes | None  # bitmap of the keys beyond the head, None if there are none

    @staticmethod
    def hash(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        return mix(k1.view(U) * U(M1) + k2.view(U))

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, rest: bytes | None) -> Head:
        h = cls.hash(k1, k2)
        order = np.argsort(h, kind="stable")
        most = int(np.unique(h, return_counts=True)[1].max()) if len(h) else 0
        return cls(h[order], k1[order], k2[order], ids[order], most, rest)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(id or -1, may be a key beyond the head)`` of each key."""
        h = self.hash(k1, k2)
        out = np.full(len(h), -1, np.int64)
        if len(self.ids):
            at = np.searchsorted(self.hashes, h)
            for j in range(self.most):
                x = np.minimum(at + j, len(self.ids) - 1)
                hit = (self.k1[x] == k1) & (self.k2[x] == k2)
                out[hit] = self.ids[x[hit]]
        open_ = (out < 0) & in_bitmap(self.rest, h) if self.rest is not None else np.zeros(len(h), bool)
        return out, open_


def stretches(seq: np.ndarray, k1: np.ndarray, k2: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a sequence table out of a sequence.

    ``seq`` holds ids, -1 for a break and -2 for a symbol whose keys ``k1, k2`` (at that place) are
    still to be looked up.  Symbols without a neighbour go.  A row holds whole runs, about
    ``STRETCH`` symbols; its open keys are listed once and referred to as -2 - index.
    """
    there = seq != -1
    near = np.zeros(len(seq), bool)
    near[1:] |= there[:-1]
    near[:-1] |= there[1:]
    keep = there & near
    after = np.zeros(len(seq), bool)
    after[1:] = keep[:-1] & ~keep[1:]
    keep_at = np.flatnonzero(keep | after)
    if not len(keep_at):
        return
    seq = np.append(np.where(keep, seq, -1)[keep_at], -1)
    keys = np.append(keep_at, 0)
    breaks = np.flatnonzero(seq == -1) + 1
    wanted = np.searchsorted(breaks, np.arange(STRETCH, len(seq) + 1, STRETCH))
    cuts = np.unique(np.concatenate(([0], breaks[np.minimum(wanted, len(breaks) - 1)], [len(seq)])))
    opened = np.flatnonzero(seq == -2)
    lists: list[list[list[int]]] = [[], []]
    for lo, hi in zip(np.searchsorted(opened, cuts[:-1]), np.searchsorted(opened, cuts[1:]), strict=True):
        if lo == hi:
            for x in lists:
                x.append([])
            continue
        at = opened[lo:hi]
        pair = np.stack([k1[keys[at]], k2[keys[at]]], 1)
        distinct, inverse = np.unique(pair, axis=0, return_inverse=True)
        seq[at] = -2 - inverse.reshape(-1)
        lists[0].append(distinct[:, 0].tolist())
        lists[1].append(distinct[:, 1].tolist())
    rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(seq, kind))
    longs = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([rows, pa.array(lists[0], longs), pa.array(lists[1], longs)], ["seq", "k1", "k2"])


def flat(column: pa.Array) -> np.ndarray:
    """All ids of the rows of a sequence table; every row ends with a break."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def adjacent(seq: np.ndarray) -> np.ndarray:
    """Places whose symbol and the next one are both ids."""
    return np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0)) if len(seq) else np.zeros(0, np.int64)


def tile_counts(left: np.ndarray, right: np.ndarray, dense: int = DENSE,
                bits: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(left, right, count)`` of the distinct pairs of a round, tile by tile."""
    mask, edge = (1 << bits) - 1, 1 << (bits + 8)  # 256 x 256 tiles have a number of 16 bits
    near = (left < edge) & (right < edge)
    tile = np.zeros(len(left), np.uint16)
    tile[near] = (left[near] >> bits) << 8 | right[near] >> bits
    crowd = np.bincount(tile[near], minlength=1 << 16) >= dense
    near &= crowd[tile]
    at = np.flatnonzero(near)
    at = at[np.argsort(tile[at], kind="stable")]
    for part in np.split(at, np.flatnonzero(np.diff(tile[at].astype(np.int64))) + 1):
        if not len(part):
            continue
        cells = np.bincount((left[part] & mask) << bits | right[part] & mask, minlength=1 << 2 * bits)
        hit = np.flatnonzero(cells)
        t = int(tile[part[0]])
        yield (t >> 8) << bits | hit >> bits, (t & 255) << bits | hit & mask, cells[hit]
    left, right = left[~near], right[~near]
    if not len(left):
        return
    if max(left.max(), right.max()) < 1 << 31:
        key, n = np.unique(left << 32 | right, return_counts=True)
        yield key >> 32, key & 0xFFFFFFFF, n
        return
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    yield left[at], right[at], np.diff(np.append(at, len(left)))


def symbols(counts: DataFrame, min_count: int, name: str) -> DataFrame:
    """Symbols (``k1, k2, n`` and more) found often enough, with an ``id`` by falling frequency."""
    return stored(row_numbers(counts.where(F.col("n") >= min_count), F.desc("n"), "k1", "k2", name="id"), name)


def head_of(table: DataFrame, head: int) -> Head:
    """The broadcast part of a level (at most ``head`` symbols), with a bitmap of the rest."""
    top = table.where(F.col("id") < head).select("k1", "k2", "id").toArrow()
    k1, k2, ids = (top.column(c).to_numpy() for c in ("k1", "k2", "id"))
    rest = table.where(F.col("id") >= head).select("k1", "k2")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = Head.hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    bits = bitmap(rest.mapInArrow(hashes, "h long")) if not rest.isEmpty() else None
    return Head.of(k1, k2, ids, bits)


def resolved(rows: DataFrame, table: DataFrame, head: Head, head_size: int, kind: str) -> DataFrame:
    """A sequence table whose open symbols have got their ids (or a break) by a join."""
    if head.rest is None:
        return rows.select("seq")
    rows = stored(rows.withColumn("row", F.expr("uuid()")), "open-sequences")
    asked = rows.where(F.size("k1") > 0).select("row", F.posexplode(F.arrays_zip("k1", "k2")).alias("at", "k"))
    rest = table.where(F.col("id") >= head_size).select("k1", "k2", "id")
    found = (asked.select("row", "at", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).join(rest, ["k1", "k2"])
             .groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("found")))
    # a stretch has few open symbols, so its answers are few
    both = rows.join(found, "row", "left").select("seq", F.col("found.at").alias("at"), F.col("found.id").alias("id"))
    arrow = pa.int32() if kind == "int" else pa.int64()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                answer = dict(zip(at or (), ids or (), strict=True))
                out.append([x if x >= -1 else answer.get(-2 - x, -1) for x in seq])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(arrow))], ["seq"])

    return both.mapInArrow(fill, f"seq array<{kind}>")


def word_sequences(docs: DataFrame, table: DataFrame, head: Head, head_size: int, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(head)
    arrow = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 2, PORTION)):
            _buf, b, _e, _row, last, h1, h2 = words(part.column(2), part.column(1).to_numpy())
            k1, k2 = h1.view(np.int64), h2.view(np.int64)
            ids, opened = shared.value.find(k1, k2)
            ids[opened] = -2
            at = np.arange(len(b)) + np.concatenate(([0], np.cumsum(last)))[:-1][:len(b)]
            size = len(b) + int(last.sum())
            seq, key1, key2 = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            seq[at], key1[at], key2[at] = ids, k1, k2
            yield from stretches(seq, key1, key2, arrow)

    rows = docs.mapInArrow(run, f"seq array<{kind}>, k1 array<long>, k2 array<long>")
    return stored(resolved(rows, table, head, head_size, kind), "words")


def pair_sequences(seqs: DataFrame, table: DataFrame, head: Head, head_size: int, kind: str) -> DataFrame:
    """Each place takes the id of the frequent pair that begins there."""
    shared = seqs.sparkSession.sparkContext.broadcast(head)
    arrow = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = flat(batch.column(0))
            at = adjacent(seq)
            ids, opened = shared.value.find(seq[at], seq[at + 1])
            ids[opened] = -2
            out, key1, key2 = np.full(len(seq), -1, np.int64), np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
            out[at], key1[at], key2[at] = ids, seq[at], seq[at + 1]
            yield from stretches(out, key1, key2, arrow)

    rows = seqs.mapInArrow(run, f"seq array<{kind}>, k1 array<long>, k2 array<long>")
    return stored(resolved(rows, table, head, head_size, kind), "pairs")


def pair_counts(seqs: DataFrame, dense: int = DENSE) -> DataFrame:
    """``k1, k2, n`` of every pair of adjacent ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            if left:
                for x, y, n in tile_counts(np.concatenate(left), np.concatenate(right), dense):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], ["k1", "k2", "n"])

        for batch in batches:
            seq = flat(batch.column(0))
            at = adjacent(seq)
            left.append(seq[at])
            right.append(seq[at + 1])
            if sum(map(len, left)) >= ROUND:
                yield from counted()
                left, right = [], []
        yield from counted()

    return seqs.mapInArrow(run, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def id_kind(table: DataFrame) -> str:
    return "int" if table.count() < 1 << 31 else "bigint"


def phrases(word_table: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """All frequent phrases of two words and more, without those that a longer one contains as often.

    ``pre[j]`` is the count of the first ``j + 1`` words and ``suf[j]`` that of the last ``j + 1``.
    """
    known = word_table.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n",
                              F.array().cast("array<long>").alias("pre"), F.array().cast("array<long>").alias("suf"))
    out = []
    for table in levels:
        left = known.select(F.col("id").alias("k1"), "lang", F.col("phrase").alias("begin"), F.col("n").alias("ln"), "pre")
        right = known.select(F.col("id").alias("k2"), F.col("last"), F.col("n").alias("rn"), "suf")
        joined = stored(table.join(left, "k1").join(right, "k2").select(
            "id", "k1", "k2", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "n", "ln", "rn",
            F.concat("pre", F.array("ln")).alias("pre"), F.concat("suf", F.array("rn")).alias("suf")), "phrases")
        # a phrase inside a longer one that is as frequent is inside one a word longer that is as frequent
        inside = joined.where("n = ln").select(F.col("k1").alias("id")).union(
            joined.where("n = rn").select(F.col("k2").alias("id"))).distinct()
        if out:
            out[-1] = out[-1].join(inside, "id", "left_anti")
        out.append(joined)
        known = joined
    return reduce(DataFrame.unionByName, [x.select("lang", "phrase", "n", "pre", "suf") for x in out])


def weakest_cut() -> Column:
    """The cut of least score (ties: the earliest) as ``score, k, l, r``: integers of 38 digits."""
    return F.expr("""array_min(transform(pre, (l, i) -> named_struct(
        'score', (cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)))
                 div (cast(l as decimal(18, 0)) * cast(element_at(suf, size(suf) - i) as decimal(18, 0))),
        'k', i, 'l', l, 'r', element_at(suf, size(suf) - i))))""")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP, head: int = HEAD, dense: int = DENSE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    ensure_shipped(docs.sparkSession)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    src = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    per = src.mapInArrow(word_counts, "lang string, k1 long, k2 long, word string, n long")
    counted = stored(per.groupBy("lang", "k1", "k2", "word").agg(F.sum("n").alias("n"))
                     .where((F.col("n") >= min_count) | F.col("word").isNull()), "word-counts")
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    table = word_table = symbols(counted.where("word IS NOT NULL"), min_count, "word-ids")
    levels: list[DataFrame] = []
    seqs = word_sequences(src, table, head_of(table, head), head, id_kind(table))
    for length in range(2, longest + 1):
        table = symbols(pair_counts(seqs, dense), min_count, f"phrase-ids-{length}")
        levels.append(table)
        if length < longest:
            seqs = pair_sequences(seqs, table, head_of(table, head), head, id_kind(table))
    scored = (phrases(word_table, levels).withColumnRenamed("n", "a").join(totals.withColumnRenamed("total", "n"), "lang")
              .withColumn("cut", weakest_cut())
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
