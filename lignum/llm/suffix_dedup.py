"""Removal of repeated byte strings by depth-limited radix sorting of suffixes.

Every byte covered by a ``threshold``-byte string (a window) that also starts
anywhere else in the corpus is removed.  Suffixes are ordered only through
``threshold`` bytes, by passes over ever longer digits, and a group that a pass
leaves with one member is dropped:

1. Of each window's ``GRAM``-byte digits the one with the least hash is its anchor.
   Equal windows have equal anchors at equal places, so suffixes need to be
   entered at anchors only (about one in ``(threshold - GRAM) / 2`` places).  The
   first pass groups anchors by their digit; a digit that occurs once is dropped.
2. The windows of one anchor lie side by side; the bytes they cover are the
   anchor's string.  Anchors with equal strings fall into one group, and only one
   member of it goes on, with the group's count.  A digit whose anchors all have
   one string is done: all its windows are repeated.
3. The remaining strings of a digit are ordered through all window bytes: equal
   windows of different strings (or of one string that occurs twice) are repeated.
   Digits with up to ``GROUP`` strings are done in one go; the windows of larger
   ones are grouped by a shuffle of their own.

What comes back per document is a list of window ranges, never text.  Strings are
told apart by 128 bits of hash.

Cases: null text is empty.  Texts shorter than a window lose nothing.  A row that
repeats another's id and text loses all its windows, like any copy.  Rows that
share an id but not the text are told apart by 16 bits of the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import stored
from lignum.llm.hashing import M1, M2, U, Prefix, bitmap, in_bitmap, portions, utf8
from lignum.ship import ensure_shipped

THRESHOLD = 200
GRAM = 32
GROUP = 4096


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = v, 1
    while have * 2 <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out


def anchors(buf: np.ndarray, off: np.ndarray, threshold: int = THRESHOLD,
            gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows by anchor: row, first window, number of windows, digit and string hash."""
    none = np.zeros(0, np.int64)
    if len(buf) < threshold:
        return none, none, none, none.view(U), none.view(U)
    p = Prefix(buf, M1)
    g = p.fixed(gram)
    # high bits order the digits, low bits are their places: the leftmost of equal ones wins
    low = sliding_min((g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U), threshold - gram + 1)
    size = np.diff(off)
    row_of = np.repeat(np.arange(len(size)), size)[:len(low)]
    at = np.flatnonzero(np.arange(len(low)) + threshold <= off[1:][row_of])
    if not len(at):
        return none, none, none, none.view(U), none.view(U)
    a = (low[at] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    s = np.flatnonzero(new)
    n = np.diff(np.append(s, len(at)))
    first = at[s]
    return row_of[first], first, n, g[a[s]], p.of(first, first + n + threshold - 1)


def _checks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bits of each row's text."""
    if not len(buf):
        return np.zeros(len(off) - 1, np.int64)
    return (Prefix(buf, M2).of(off[:-1], off[1:]) >> U(48)).astype(np.int64)


def _src(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(row_id(F.col(id_col), text).alias("id"), text.alias("text"))


def row_id(id_col: Column, text: Column) -> Column:
    """A row's id; a row without one goes by the hash of its text, so it is found again like any other."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(F.lit(4), F.coalesce(text, F.lit(""))))


def digits(src: DataFrame, threshold: int) -> DataFrame:
    """``h, u`` of every anchor, for counting; equal ones of a batch are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                _r, _s, _n, h, u = anchors(*utf8(part.column(1)), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(u.view(np.int64))], ["h", "u"])

    return src.mapInArrow(run, "h long, u long")


def located(src: DataFrame, threshold: int, shared=None) -> DataFrame:
    """``h, u, id, check, first, n`` of every anchor (whose digit is in the bitmap, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                buf, off = utf8(part.column(1))
                r, s, n, h, u = anchors(buf, off, threshold)
                if shared is not None:
                    keep = in_bitmap(shared.value, h)
                    r, s, n, h, u = r[keep], s[keep], n[keep], h[keep], u[keep]
                # place, number of windows and check in one number
                at = (s - off[:-1][r]) << 32 | n << 16 | _checks(buf, off)[r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(u.view(np.int64)), part.column(0).take(pa.array(r)),
                     pa.array(at)], ["h", "u", "id", "at"])

    return src.mapInArrow(run, "h long, u long, id long, at long")


def strings(picked: DataFrame, src: DataFrame, threshold: int) -> DataFrame:
    """``h, u, m, bytes``: the string of each picked anchor, cut out of its document."""
    per = picked.groupBy("id", F.col("at").bitwiseAND(0xFFFF).alias("check")).agg(
        F.collect_list(F.struct("h", "u", "m", "at")).alias("a"))
    joined = src.join(per, "id").select("text", "check", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                buf, off = utf8(part.column(0))
                raw = buf.tobytes()
                a = part.column(2)
                fields = a.flatten()
                h, u, m, at = (fields.field(k).to_numpy() for k in range(4))
                row = np.repeat(np.arange(part.num_rows), np.diff(a.offsets.to_numpy()))
                keep = _checks(buf, off)[row] == part.column(1).to_numpy()[row]
                h, u, m, at, row = h[keep], u[keep], m[keep], at[keep], row[keep]
                first = off[:-1][row] + (at >> 32)
                end = first + ((at >> 16) & 0xFFFF) + threshold - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(u), pa.array(m),
                     pa.array([raw[s:e] for s, e in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
                    ["h", "u", "m", "bytes"])

    return joined.mapInArrow(run, "h long, u long, m long, bytes binary")


def _windows(column: pa.Array, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String and two hashes of every window of the strings."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    n = np.diff(off) - threshold + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[:-1], n)
    return row, Prefix(buf, M1).of(place, place + threshold), Prefix(buf, M2).of(place, place + threshold)


def _ranges(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows: string, first window in it, number."""
    begin = np.searchsorted(row, row)  # first window of the same string
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    s = np.flatnonzero(new)
    return row[at[s]], at[s] - begin[at[s]], np.diff(np.append(s, len(at)))


def repeated_in_groups(cut: DataFrame, threshold: int) -> DataFrame:
    """``h, u, from, len``: repeated windows of strings whose digit has at most ``GROUP`` strings.

    Strings are streamed in the order of their digit; a group is complete when the digit changes.
    """
    dealt = cut.repartition("h").sortWithinPartitions("h", "u")

    def solve(table: pa.Table) -> pa.RecordBatch:
        h, u, m = (table.column(k).to_numpy() for k in range(3))
        row, w1, w2 = _windows(table.column(3).combine_chunks(), threshold)
        order = np.lexsort((w2, w1, h[row]))
        k = np.stack([h[row][order].view(U), w1[order], w2[order]])
        new = np.ones(len(order), bool)
        new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
        group = np.cumsum(new) - 1
        seen = np.bincount(group, weights=m[row][order])
        flags = np.zeros(len(order), bool)
        flags[order] = seen[group] > 1
        r, first, n = _ranges(flags, row)
        return pa.RecordBatch.from_arrays([pa.array(h[r]), pa.array(u[r]), pa.array(first), pa.array(n)],
                                          ["h", "u", "from", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                h = part.column(0).to_numpy()
                held.append(part)
                rows += len(h)
                if rows < 2 * GROUP or h[0] == h[-1]:
                    continue
                cut_at = int(np.searchsorted(h, h[-1]))  # where the last, maybe unfinished, digit begins
                held[-1] = part.slice(0, cut_at)
                yield solve(pa.Table.from_batches(held))
                held, rows = [part.slice(cut_at)], len(h) - cut_at
        if rows:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "h long, u long, from long, len long")


def repeated_in_large(cut: DataFrame, threshold: int) -> DataFrame:
    """The same for digits with more strings: windows meet in a shuffle of their own."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, w1, w2 = _windows(part.column(3), threshold)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(take) for k in range(3)], pa.array(place), pa.array(w1.view(np.int64)),
                     pa.array(w2.view(np.int64))], ["h", "u", "m", "from", "w1", "w2"])

    w = cut.mapInArrow(explode, "h long, u long, m long, from long, w1 long, w2 long")
    often = (w.groupBy("w1", "w2").agg(F.sum("m").alias("c")).where(F.col("c") > 1).select("w1", "w2"))
    return w.join(often, ["w1", "w2"]).select("h", "u", "from", F.lit(1).cast("long").alias("len"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: int = THRESHOLD) -> DataFrame:
    """``id, check, first, n``: runs of repeated windows in the documents' bytes."""
    spark = docs.sparkSession
    ensure_shipped(spark)
    src = _src(docs, id_col, text_col)
    # pass 1: digits that occur again, and whether all their strings are one
    shared = stored(digits(src, threshold).groupBy("h").agg(
        F.count(F.lit(1)).alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi")).where(F.col("c") > 1)
        .select("h", (F.col("lo") == F.col("hi")).alias("one")), "digits")
    bits = spark.sparkContext.broadcast(bitmap(shared.select("h")))
    found = stored(located(src, threshold, bits).join(shared, "h"), "anchors")
    # pass 2: one member of every group of equal strings goes on
    open_strings = (found.where(~F.col("one")).groupBy("h", "u")
                    .agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "at")).alias("r")))
    picked = stored(open_strings.select("h", "u", F.least("m", F.lit(2)).cast("long").alias("m"), "r.id", "r.at"),
                    "strings")
    large = stored(picked.groupBy("h").count().where(F.col("count") > GROUP).select("h"), "large")
    cut = strings(picked, src, threshold)
    some_large = large.limit(1).count() > 0
    if some_large:
        cut = stored(cut, "cut")
    # pass 3: windows
    hits = repeated_in_groups(cut.join(large, "h", "left_anti") if some_large else cut, threshold)
    if some_large:
        hits = hits.unionByName(repeated_in_large(cut.join(large, "h", "left_semi"), threshold))
    hits = stored(hits, "windows")
    place, check = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFF)
    done = found.where("one").select("id", check.alias("check"), place.alias("first"),
                                     F.shiftright("at", 16).bitwiseAND(0xFFFF).alias("n"))
    rest = (found.where(~F.col("one")).join(hits, ["h", "u"])
            .select("id", check.alias("check"), (place + F.col("from")).alias("first"), F.col("len").alias("n")))
    return done.unionByName(rest)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row."""
    runs = repeated_windows(docs, id_col, text_col, threshold)
    per = runs.groupBy(F.col("id").alias("_rid"), F.col("check").alias("_rc")).agg(
        F.collect_list(F.struct("first", "n")).alias("runs"))
    per = per.groupBy("_rid").agg(F.collect_list(F.struct("_rc", "runs")).alias("all"))
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), row_id(F.col(id_col), text).alias("_row"))
    joined = src.join(per, F.col("_row") == F.col("_rid"), "left").select("doc_id", "text", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                buf, off = utf8(part.column(1))
                checks = _checks(buf, off)
                removed, spans, kept = [], [], []
                for i, found in enumerate(part.column(2).to_pylist()):
                    text = buf[off[i]:off[i + 1]]
                    mine = [x for y in found or [] if y["_rc"] == checks[i] for x in y["runs"]]
                    depth = np.zeros(len(text) + 1, np.int64)
                    if mine:
                        first = np.array([x["first"] for x in mine])
                        np.add.at(depth, first, 1)
                        np.add.at(depth, first + np.array([x["n"] for x in mine]) + threshold - 1, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone[1:] & ~gone[:-1]).sum() + (len(gone) and gone[0])))
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
