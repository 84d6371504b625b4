"""Ordered labelled trees as node tables, and their sequence encoding.

A tree is a set of rows ``(tree_id, node_id, parent_id, type, is_terminal,
start, end)``; children are ordered by ``(start, node_id)``.  All operators
keep the node table hash-partitioned by ``tree_id`` so the per-tree windows
and joins below run without further shuffles (see ``session.DEFAULT_CONF``).

The binarised tree of the encoding is never built.  Each node gets a binary
depth ``C`` (child ``j`` of a node with ``k`` children sits ``min(j, k-1)``
levels below it in the right-branching binarisation; a single child is fused
with its parent and costs 0), and the gap height between adjacent leaves is a
suffix maximum of leaf depths under the children of their lowest common
ancestor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lignum.functions.constants import EMPTY, SEP
from lignum.ship import ensure_shipped

NODE_COLS = ["tree_id", "node_id", "parent_id", "type", "is_terminal", "start", "end"]


PART_BYTES = 1 << 23  # text of one partition: what a task sorts does not grow with the corpus


def by_tree(df: DataFrame, col: str = "tree_id", size: Column | None = None, part: int = PART_BYTES) -> DataFrame:
    """Hash-partition by tree id into ``spark.sql.shuffle.partitions`` parts, or more where ``size`` (the
    bytes of a row, added up first) comes to more than ``part`` bytes a partition.

    An explicit count keeps AQE from coalescing the shuffle: the input is
    small in bytes but every byte fans out into many node rows downstream.
    """
    return df.repartition(parts_of(df, size, part), col)


def parts_of(df: DataFrame, size: Column | None = None, part: int = PART_BYTES) -> int:
    """How many partitions ``by_tree`` makes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size is None:
        return n
    return max(n, -(-(df.agg(F.sum(size.cast("long"))).first()[0] or 0) // part))


# ---------------------------------------------------------------------------
# Node tables from nested sources
# ---------------------------------------------------------------------------

def sentence_type(last_word: Column, has_quote: Column) -> Column:
    return (F.when(has_quote, F.lit("string_literal"))
            .when(last_word.endswith("?"), F.lit("question"))
            .when(last_word.endswith("!"), F.lit("exclamation"))
            .when(last_word.endswith("."), F.lit("statement"))
            .otherwise(F.lit("fragment")))


def nest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ("lang",), with_paths: bool = False):
    """Document -> line -> sentence -> word trees with UTF-8 byte offsets.

    Lines split on ``\\n``, words on single spaces (empty words dropped), and a
    sentence ends after a word ending in ``.``, ``!`` or ``?``.  Node ids are
    preorder ranks, so a parent id is always smaller than its children's.

    Besides the node columns it returns ``depth``, sibling ordinal ``j``, parent
    fan-out ``kp`` and fan-out ``k``.  A text whose id is its own is cut in its
    row (``text_nodes``): nothing is sorted, and its nodes are dealt by tree
    once.  Documents that share an id make one tree and take the windows of
    ``_nest_windows``, as does the closure.  With ``with_paths`` it also returns
    that closure in ``root_paths`` form (root path with binary depth ``C`` and
    chain labels, leaf rank ``tok``, previous leaf's path).
    """
    if with_paths:
        return _nest_windows(docs, id_col, text_col, keep, True)
    texts = docs.select(F.col(id_col).cast("long").alias("tree_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    own, rest = by_own_id(texts, "tree_id")
    cut = text_trees(own, "tree_id", "text", keep).select("tree_id", *keep, F.explode("nodes").alias("n"))
    kind = F.get(F.array(*map(F.lit, _TYPES)), F.col("n.type"))
    nodes = cut.select("tree_id", *keep, "n.node_id", "n.parent_id", kind.alias("type"), (F.col("n.depth") == 3).alias("is_terminal"),
                       *[f"n.{c}" for c in ("start", "end", "depth", "j", "kp", "k")])
    return nodes if rest is None else nodes.unionByName(_nest_windows(rest, "tree_id", "text", keep))


def text_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang",),
               beside: DataFrame | None = None) -> DataFrame:
    """C1 with a tree in a row: its ``text`` and its ``nodes`` in preorder, dealt by tree.  Every row is a tree of its
    own, so ids are those of ``by_own_id``; types are places in ``_TYPES``.  ``beside`` (a row a ``tree_id``) meets the
    texts before they are cut: what a Python function yields counts as dealt anyhow and would be shuffled to meet it."""
    ensure_shipped(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("tree_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    d = by_tree(texts, size=F.octet_length("text"))
    d = d if beside is None else d.join(beside, "tree_id", "left")
    return d.select("*", _text_nodes("text").alias("nodes"))


def by_own_id(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Documents that share their id with no other, and the rest: repeated and null ids (None without any)."""
    from lignum.operators.order import staged
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).select(id_col)
    again = staged(again, "repeated")
    if again.isEmpty():
        return docs, None
    same = docs[id_col].eqNullSafe(again[id_col])
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


_TYPES = ("document", "line", "fragment", "statement", "exclamation", "question", "string_literal", "word")
_CUT = ("node_id", "parent_id", "type", "start", "end", "depth", "j", "kp", "k")


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin (``flag``), and the run that each place belongs to."""
    return np.flatnonzero(flag), np.cumsum(flag) - 1


class Levels:
    """The words of the texts ``buf[off[i]:off[i + 1]]`` and the sentences, lines and texts that they lie in.

    Words lie between blanks, line ends and the ends of texts.  Levels are flags over the words: where a
    text, a line and a sentence begin; a node's fan-out is the number of flags of the next level in its run.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.size = buf, off, np.diff(off)
        inside = (buf != 32) & (buf != 10)
        edge = off[(off > 0) & (off < len(buf))]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        begin[edge] = inside[edge]
        stop[edge - 1] = inside[edge - 1]
        self.b, self.e = b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.row = row = np.searchsorted(off, b, "right") - 1
        line = np.searchsorted(np.flatnonzero(buf == 10), b)   # line ends before the word, in all texts
        last = buf[e - 1]
        ended = (last == 46) | (last == 33) | (last == 63)
        self.n = n = len(b)
        self.new_t, self.new_l, self.new_s = new_t, new_l, new_s = np.ones(n, bool), np.ones(n, bool), np.ones(n, bool)
        new_t[1:] = row[1:] != row[:-1]
        new_l[1:] = new_t[1:] | (line[1:] != line[:-1])
        new_s[1:] = new_l[1:] | ended[:-1]
        (self.t0, self.t), (self.l0, self.ln), (self.s0, self.s) = (t0, t), (l0, ln), (s0, s) = _runs(new_t), _runs(new_l), _runs(new_s)
        self.l_end, self.s_end = (np.append(x[1:], n)[:len(x)] - 1 for x in (l0, s0))   # last word of each run
        self.t_k, self.l_k = np.bincount(t[l0], minlength=len(t0)), np.bincount(ln[s0], minlength=len(l0))
        self.s_k = np.bincount(s, minlength=len(s0))
        self.lj = ln[l0] - ln[t0][t[l0]] + 1
        self.sj = s[s0] - s[l0][ln[s0]] + 1
        self.wj = np.arange(n) - s0[s] + 1
        quote = np.flatnonzero(buf == 34)
        quotes = np.searchsorted(quote, e) > np.searchsorted(quote, b)
        end = last[self.s_end]
        self.kind = np.select([np.maximum.reduceat(quotes, s0) if n else quotes, end == 63, end == 33, end == 46], [6, 5, 4, 3], 2)
        self.bare = np.setdiff1d(np.arange(len(self.size)), row[t0])   # texts without words

    @property
    def tok(self) -> np.ndarray:
        """Place of each word in its text."""
        return np.arange(self.n) - self.t0[self.t]


#: What a gap or a word of a document can be labelled: a filler, then chains of the document, its lines and its sentences.
LABELS = (EMPTY, "document", "line", f"document{SEP}line",
          *(over + kind for over in ("", f"line{SEP}", f"document{SEP}line{SEP}")
            for kind in ("fragment", "statement", "exclamation", "question", "string_literal")))


def _suffix_max(x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Largest of ``x`` (not below 0) from each place to the end of its run; ``run`` numbers the runs in order."""
    if not len(x):
        return x
    lift = (run[-1] - run) * (int(x.max()) + 1)
    return np.maximum.accumulate((x + lift)[::-1])[::-1] - lift


def encoded(w: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """C7-C9 of cut texts, as ``encode_sentences`` states them: the height and label of the gap after each word (-1 after
    the last one of a text) and its unary label; labels are places in ``LABELS``."""
    ls = w.ln[w.s0]                       # line of each sentence
    sents, lj, lines = w.l_k[ls], w.lj[ls], w.t_k[w.t[w.s0]]
    cost = lambda j, of: np.where(of == 1, 0, np.minimum(j, of - 1))
    deep = cost(w.sj, sents) + w.s_k - 1
    s_deep = _suffix_max(deep, ls)
    line_deep = np.maximum.reduceat(deep + cost(lj, lines), w.s[w.l0]) if w.n else deep
    l_deep = _suffix_max(line_deep, w.t[w.l0])[ls]
    sole = lines == 1
    line_chain = np.where(sole, 3, 2)
    sent_chain = 2 + w.kind + np.where(sents == 1, np.where(sole, 10, 5), 0)
    in_line, in_doc = w.sj < sents, lj < lines
    d, c, u = np.repeat(w.s_k, w.s_k) - w.wj, np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    single = w.s_k == 1
    c[w.s0] = sent_chain
    d[w.s_end] = np.where(in_line, s_deep - (w.sj - 1), np.where(in_doc, l_deep - (lj - 1), -1))
    c[w.s_end] = np.where(in_line, np.where(w.sj == 1, line_chain, 0), np.where(in_doc, np.where(lj == 1, 1, 0), -1))
    u[w.s0[single]] = sent_chain[single]
    return d, c, u


SLICE = 1 << 18  # bytes of text that a step over texts in rows takes at a time


def text_slices(text: pa.Array, part: int = SLICE):
    """The texts of an array (null as empty) about ``part`` bytes at a time: first and last row, their bytes and offsets."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    held = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8) if len(text) else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + part, "right")) - 1)
        yield lo, hi, data[held[lo]:held[hi]], held[lo:hi + 1] - held[lo]
        lo = hi


def over_slices(docs: DataFrame, make, schema) -> DataFrame:
    """Documents (``text`` and other columns) through ``make()``, a function within a task that yields batches for the rows of a
    slice and the ``Levels`` of their texts: no word is a row, and a task holds the words of a slice."""
    ensure_shipped(docs.sparkSession)

    def run(batches):
        step = make()
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column("text")):
                yield from step(b.slice(lo, hi - lo), Levels(buf, off))

    return docs.mapInArrow(run, schema)


FIRST_LABELS = "kind string, lang string, label string, split_ord int, sample_ord long, pos int, count long"


def first_labels(docs: DataFrame) -> DataFrame:
    """Labels of documents whose ids are their own (tree_id, text, lang, split_ord): per kind ('c' of gaps, 'u' of words), language
    and label how often it occurs in a partition, and the split, document and place where it does first."""
    ensure_shipped(docs.sparkSession)

    def run(batches):
        held: dict = {}
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column("text")):
                _add_labels(held, b.slice(lo, hi - lo), Levels(buf, off))
        rows = [(*key, *first, n) for key, (first, n) in held.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                                         ["kind", "lang", "label", "split_ord", "sample_ord", "pos", "count"])

    return docs.select("tree_id", "text", "lang", F.col("split_ord").cast("int").alias("split_ord")).mapInArrow(run, FIRST_LABELS)


def _add_labels(held: dict, cols: pa.RecordBatch, w: Levels) -> None:
    """Adds the labels of a slice to ``held``: first place and number by kind, language and label."""
    _d, c, u = encoded(w)
    n, m, tok = len(w.size), len(LABELS), w.tok
    ids, split = (cols.column(x).to_numpy(zero_copy_only=False) for x in ("tree_id", "split_ord"))
    lang = cols.column("lang").dictionary_encode()
    langs = [*lang.dictionary.to_pylist(), None]
    code = pc.fill_null(lang.indices, len(langs) - 1).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, split))
    gap = c >= 0
    # a document without words is a leaf without a label
    for kind, row, label, pos in (("c", w.row[gap], c[gap], tok[gap]),
                                  ("u", np.r_[w.row, w.bare], np.r_[u, np.zeros(len(w.bare), np.int64)], np.r_[tok, np.zeros(len(w.bare), np.int64)])):
        key = row * m + label
        count = np.bincount(key, minlength=n * m).reshape(n, m)
        first = np.zeros(n * m, np.int64)
        first[key[::-1]] = pos[::-1]     # the first one is written last
        for i in np.unique(code):
            docs = order[code[order] == i]
            total, there = count[docs].sum(axis=0), count[docs] > 0
            for j in np.flatnonzero(total):
                doc = docs[np.argmax(there[:, j])]
                place = int(split[doc]), int(ids[doc]), int(first[doc * m + j])
                old = held.get((kind, langs[i], LABELS[j]))
                held[kind, langs[i], LABELS[j]] = (place, int(total[j])) if old is None else (min(place, old[0]), old[1] + int(total[j]))


def spread(docs: DataFrame, read: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` dealt by id where the files that ``read`` lists are too few for all cores to have a part."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if read.rdd.getNumPartitions() >= cores:
        return docs
    return docs.repartition(max(cores, parts_of(read, F.octet_length(text_col))), id_col)


def per_row(rows: np.ndarray, n: int) -> pa.Array:
    """Offsets of lists that hold, for each of ``n`` rows, the entries that ``rows`` (in order) gives to it."""
    return pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32))


def _cut(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of the texts ``buf[off[i]:off[i + 1]]`` in preorder, as columns; ``row`` is the text of a node."""
    return nodes_of(Levels(buf, off))


def nodes_of(w: Levels) -> dict[str, np.ndarray]:
    """The nodes of cut texts in preorder."""
    b, e, row, t, t0, ln, l0, s, s0 = w.b, w.e, w.row, w.t, w.t0, w.ln, w.l0, w.s, w.s0
    place = np.cumsum(1 + w.new_s.astype(np.int64) + w.new_l + w.new_t) - 1   # of the word, in all texts
    top = place[t0] - 3
    w_id = place - top[t]
    l_id, s_id = w_id[l0] - 2, w_id[s0] - 1
    at = [top, place[l0] - 2, place[s0] - 1, place]
    rel = w.off[row]
    cols = {"row": [row[t0], row[l0], row[s0], row], "node_id": [0, l_id, s_id, w_id], "parent_id": [-1, 0, l_id[ln[s0]], s_id[s]],
            "type": [0, 1, w.kind, 7], "start": [0, b[l0] - rel[l0], b[s0] - rel[s0], b - rel],
            "end": [w.size[row[t0]], e[w.l_end] - rel[l0], e[w.s_end] - rel[s0], e - rel], "depth": [0, 1, 2, 3],
            "j": [1, w.lj, w.sj, w.wj], "kp": [-1, w.t_k[t[l0]], w.l_k[ln[s0]], w.s_k[s]], "k": [w.t_k, w.l_k, w.s_k, 0]}
    plain = {"row": w.bare, "parent_id": -1, "end": w.size[w.bare], "j": 1, "kp": -1}   # a root without children
    return _placed(cols, at, plain, w.n + len(s0) + len(l0) + len(t0), w.bare)


def _placed(cols: dict, at: list, plain: dict, total: int, bare: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of all levels in preorder, with the roots of the texts without words between the others."""
    out = {}
    for name, levels in cols.items():
        a = np.empty(total, np.int64)
        for where, x in zip(at, levels, strict=True):
            a[where] = x
        out[name] = a
    if len(bare):
        before = np.searchsorted(out["row"], bare)
        out = {name: np.insert(a, before, plain.get(name, 0)) for name, a in out.items()}
    return out


@F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in _CUT])))
def _text_nodes(text: pa.Array) -> pa.Array:
    """The nodes of each text, cut out of about a megabyte at a time."""
    parts = []
    for lo, hi, buf, off in text_slices(text, 1 << 20):
        c = _cut(buf, off)
        num = [pa.array(c[x].astype(np.int32), mask=c[x] < 0) for x in _CUT]
        parts.append(pa.ListArray.from_arrays(per_row(c["row"], hi - lo), pa.StructArray.from_arrays(num, list(_CUT))))
    return pa.concat_arrays(parts)


def _nest_windows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], with_paths: bool = False):
    """``nest_documents`` by windows over words.

    Documents are hash-partitioned by id once, exploded to words, and every sentence / line / root node is
    emitted by the first word under it (``explode`` of an array of node structs).  The word stream stays sorted
    by (tree, line, sentence, word) through every window, so preorder ids are a running count of emitted
    nodes and parent ids the first id of each sentence / line.
    """
    # a word takes many times its bytes in the windows below
    d = by_tree(docs.select(F.col(id_col).cast("long").alias("tree_id"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep),
                size=F.octet_length("text"), part=PART_BYTES // 2)
    lines = d.select("tree_id", *keep, F.octet_length("text").cast("int").alias("tlen"),
                     F.posexplode(F.split("text", "\n", -1)).alias("li", "line"))
    before = W.partitionBy("tree_id").orderBy("li").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn(
        "lstart", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    words = lines.select("tree_id", *keep, "tlen", "li", "lstart",
                         F.posexplode(F.split("line", " ", -1)).alias("wi", "word"))
    wbefore = W.partitionBy("tree_id", "li").orderBy("wi").rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("word").rlike("[.!?]\\z").cast("int")
    words = (words
             .withColumn("woff", F.coalesce(F.sum(F.octet_length("word") + 1).over(wbefore), F.lit(0)))
             .withColumn("si", F.coalesce(F.sum(ends).over(wbefore), F.lit(0)))
             .where(F.octet_length("word") > 0)
             .withColumn("start", (F.col("lstart") + F.col("woff")).cast("int"))
             .withColumn("end", (F.col("start") + F.octet_length("word")).cast("int")))
    sent = W.partitionBy("tree_id", "li", "si").orderBy("wi")
    sent_all = sent.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    line_all = W.partitionBy("tree_id", "li")
    words = (words
             .withColumn("wj", F.row_number().over(sent).cast("int"))
             .withColumn("s_k", F.count(F.lit(1)).over(sent_all).cast("int"))
             .withColumn("s_end", F.max("end").over(sent_all))
             .withColumn("s_last", F.last("word").over(sent_all))
             .withColumn("s_q", F.bool_or(F.col("word").contains('"')).over(sent_all))
             .withColumn("l_k", (F.max("si").over(line_all) + 1).cast("int"))
             .withColumn("l_end", F.max("end").over(line_all))
             .withColumn("l_j", F.dense_rank().over(W.partitionBy("tree_id").orderBy("li")).cast("int")))
    words = words.withColumn("t_k", F.max("l_j").over(W.partitionBy("tree_id")).cast("int"))
    first_in_sent = F.col("wj") == 1
    first_in_line = first_in_sent & (F.col("si") == 0)
    first_in_doc = first_in_line & (F.col("l_j") == 1)
    # preorder: doc, line, sentence, word nodes are emitted by the first word under them
    stream = W.partitionBy("tree_id").orderBy("li", "si", "wi")
    upto = stream.rowsBetween(W.unboundedPreceding, W.currentRow)
    n_emit = (1 + first_in_sent.cast("int") + first_in_line.cast("int") + first_in_doc.cast("int"))
    words = (words.withColumn("cum", F.sum(n_emit).over(upto).cast("int"))
             .withColumn("tok", (F.row_number().over(stream) - 1).cast("int")))
    sent_first = W.partitionBy("tree_id", "li", "si").orderBy("wi").rowsBetween(W.unboundedPreceding, W.currentRow)
    line_first = W.partitionBy("tree_id", "li").orderBy("si", "wi").rowsBetween(W.unboundedPreceding, W.currentRow)
    words = (words.withColumn("sent_id", F.first(F.col("cum") - 2).over(sent_first))
             .withColumn("line_id", F.first(F.col("cum") - 3).over(line_first))
             .withColumn("word_id", F.col("cum") - 1)
             .withColumn("stype", sentence_type(F.col("s_last"), F.col("s_q"))))
    cost = lambda j, kp: F.when(kp == 1, F.lit(0)).otherwise(F.least(j, kp - 1))
    c_line = cost(F.col("l_j"), F.col("t_k"))
    c_sent = c_line + cost(F.col("si") + 1, F.col("l_k"))
    c_word = c_sent + cost(F.col("wj"), F.col("s_k"))
    ch_root = F.lit("document")
    ch_line = F.when(F.col("t_k") == 1, F.concat(ch_root, F.lit(SEP + "line"))).otherwise(F.lit("line"))
    ch_sent = F.when(F.col("l_k") == 1, F.concat(ch_line, F.lit(SEP), F.col("stype"))).otherwise(F.col("stype"))
    ch_word = F.when(F.col("s_k") == 1, F.concat(ch_sent, F.lit(SEP + "word"))).otherwise(F.lit("word"))
    el = lambda node_id, j, c, ch: F.struct(node_id.cast("int").alias("node"), j.cast("int").alias("j"),
                                            c.cast("int").alias("C"), ch.alias("chain"))
    path = [el(F.lit(0), F.lit(1), F.lit(0), ch_root),
            el(F.col("line_id"), F.col("l_j"), c_line, ch_line),
            el(F.col("sent_id"), F.col("si") + 1, c_sent, ch_sent),
            el(F.col("word_id"), F.col("wj"), c_word, ch_word)]
    if with_paths:
        words = words.withColumn("wpath", F.array(*path))
        words = words.withColumn("prev_path", F.lag("wpath").over(stream))
    node = lambda depth, nid, pid, start, end, typ, term, j, kp, k: F.struct(
        nid.cast("int").alias("node_id"), pid.cast("int").alias("parent_id"),
        F.lit(depth).alias("depth"), start.alias("start"), end.alias("end"), typ.alias("type"),
        F.lit(term).alias("is_terminal"), j.cast("int").alias("j"), kp.cast("int").alias("kp"),
        k.cast("int").alias("k"))
    emitted = F.array_compact(F.array(
        F.when(first_in_doc, node(0, F.lit(0), F.lit(None), F.lit(0), F.col("tlen"), F.lit("document"), False,
                                  F.lit(1), F.lit(None), F.col("t_k"))),
        F.when(first_in_line, node(1, F.col("line_id"), F.lit(0), F.col("start"), F.col("l_end"), F.lit("line"),
                                   False, F.col("l_j"), F.col("t_k"), F.col("l_k"))),
        F.when(first_in_sent, node(2, F.col("sent_id"), F.col("line_id"), F.col("start"), F.col("s_end"),
                                   F.col("stype"), False, F.col("si") + 1, F.col("l_k"), F.col("s_k"))),
        node(3, F.col("word_id"), F.col("sent_id"), F.col("start"), F.col("end"), F.lit("word"), True,
             F.col("wj"), F.col("s_k"), F.lit(0))))
    extra = ["wpath", "prev_path", "tok"] if with_paths else []
    nodes = words.select("tree_id", *keep, *extra, F.explode(emitted).alias("n")).select("tree_id", *keep, *extra, "n.*")
    cols = ["tree_id", *keep, "node_id", "parent_id", "type", "is_terminal", "start", "end", "depth", "j", "kp", "k"]
    # a document without words is a root without children
    bare = (d.where(~F.col("text").rlike("[^ \n]"))
            .select("tree_id", *keep, node(0, F.lit(0), F.lit(None), F.lit(0), F.octet_length("text").cast("int"),
                                           F.lit("document"), False, F.lit(1), F.lit(None), F.lit(0)).alias("n"))
            .select("tree_id", *keep, "n.*"))
    if with_paths:
        bare = (bare.withColumn("wpath", F.array(path[0])).withColumn("prev_path", F.lit(None).cast(words.schema["wpath"].dataType))
                .withColumn("tok", F.lit(0)))
    nodes = nodes.unionByName(bare)
    if not with_paths:
        return nodes.select(*cols)
    paths = nodes.select(
        *cols, F.slice("wpath", 1, F.col("depth") + 1).alias("path"),
        F.when(F.col("k") == 0, F.col("tok")).alias("tok"),
        F.when(F.col("depth") == 3, F.col("prev_path")).alias("prev_path"))
    paths = (paths.withColumn("C", F.element_at("path", -1)["C"])
             .withColumn("chain", F.element_at("path", -1)["chain"]))
    return nodes.select(*cols), paths


def document_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: tuple[str, ...] = ("lang",), with_words: bool = False) -> DataFrame:
    """One row per sentence of the trees of ``nest_documents``, with all that their encoding needs.

    Encoding needs the shape of a tree and no byte offsets, so the windows run over sentences and not
    over words.  Lines and sentences are read from the last to the first: ``nl`` lines and ``ns``
    sentences come after, and one sort serves every window below.

    ``k`` words, sentence ``sj`` of ``sents``, line ``lj`` of ``lines``, first token ``lo``, words
    ``lk`` of the line and ``tk`` of the document, and the suffix maxima of binary leaf depths:
    ``s_deep`` from this sentence to the end of its line (below the line), ``l_deep`` from this line to
    the end of the document.  A document without words has one row with ``lines = 0``: its root is its
    only leaf.  ``with_words`` adds the sentence itself (``sent``) and the first word of the next sentence
    of the document (``after``).
    """
    # a sentence ends at the blank after ., ! or ?; only the last of a line can be blank
    sentences = lambda line: F.filter(F.split(line, "(?<=[.!?]) ", -1), lambda s: s.rlike("[^ ]"))
    d = by_tree(docs.select(F.col(id_col).cast("long").alias("tree_id"), F.col(text_col).alias("text"), *keep),
                size=F.octet_length("text"))
    d = d.select("tree_id", *keep, F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), sentences), lambda s: F.size(s) > 0).alias("_lines"))
    d = d.select("tree_id", *keep, F.size("_lines").alias("lines"),
                 F.posexplode_outer(F.reverse("_lines")).alias("nl", "_sents"))
    d = d.select("tree_id", *keep, "lines", "nl", F.greatest(F.size("_sents"), F.lit(0)).alias("sents"),
                 F.posexplode_outer(F.reverse("_sents")).alias("ns", "_s"))
    bare = F.col("lines") == 0
    d = d.select("tree_id", *keep, "lines", "sents", F.coalesce("nl", F.lit(0)).alias("nl"),
                 F.coalesce("ns", F.lit(0)).alias("ns"),
                 F.when(bare, 1).otherwise(F.size(F.filter(F.split("_s", " ", -1), lambda w: w != ""))).alias("k"),
                 sentence_type(F.rtrim("_s"), F.col("_s").contains('"')).alias("stype"),
                 *([F.col("_s").alias("sent")] if with_words else []))
    d = d.withColumn("lj", F.col("lines") - F.col("nl")).withColumn("sj", F.col("sents") - F.col("ns"))
    cost = lambda j, of: F.when(of == 1, F.lit(0)).otherwise(F.least(j, of - 1))
    depth = cost(F.col("sj"), F.col("sents")) + F.col("k") - 1
    line = W.partitionBy("tree_id", "nl")
    tree = W.partitionBy("tree_id")
    d = (d.withColumn("_d", depth).withColumn("_ld", F.col("_d") + cost(F.col("lj"), F.col("lines")))
         .withColumn("s_deep", F.max("_d").over(line.orderBy("ns").rowsBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("l_deep", F.max("_ld").over(tree.orderBy("nl").rangeBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("_rest", F.sum("k").over(tree.orderBy("nl", "ns")
                                              .rowsBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("lk", F.sum("k").over(line)).withColumn("tk", F.sum("k").over(tree)))
    if with_words:  # read from the last sentence to the first, the next one comes before
        d = d.withColumn("after", F.lag(F.substring_index(F.ltrim("sent"), " ", 1)).over(tree.orderBy("nl", "ns")))
    return (d.withColumn("lo", (F.col("tk") - F.col("_rest")).cast("int"))
            .drop("_d", "_ld", "_rest", "nl", "ns"))


def _with_chains(sents: DataFrame) -> DataFrame:
    """Sentence rows with the chain labels of their line (``_lc``) and of their own (``_sc``)."""
    line_chain = F.when(F.col("lines") == 1, F.lit(f"document{SEP}line")).otherwise(F.lit("line"))
    sent_chain = F.when(F.col("sents") == 1, F.concat(F.col("_lc"), F.lit(SEP), F.col("stype"))).otherwise(F.col("stype"))
    return sents.withColumn("_lc", line_chain).withColumn("_sc", sent_chain)


def _gap_after(wj: Column) -> tuple[Column, Column]:
    """Height and label of the gap after word ``wj`` of a sentence, null after the last word of a document."""
    first = lambda j, label: F.when(j == 1, label).otherwise(F.lit(EMPTY))
    inside, in_line = wj < F.col("k"), F.col("sj") < F.col("sents")
    in_doc = F.col("lj") < F.col("lines")
    d = (F.when(inside, F.col("k") - wj).when(in_line, F.col("s_deep") - (F.col("sj") - 1))
         .when(in_doc, F.col("l_deep") - (F.col("lj") - 1)))
    c = (F.when(inside, first(wj, F.col("_sc"))).when(in_line, first(F.col("sj"), F.col("_lc")))
         .when(in_doc, first(F.col("lj"), F.lit("document"))))
    return d, c


def sentence_gaps(sents: DataFrame) -> DataFrame:
    """C8, C9 with a tree in a row: the arrays ``d`` and ``c`` of ``encode_sentences`` in order of their words (null after
    the last one), of documents whose ids are their own.  Inside a sentence they are a countdown and one label."""
    k = F.col("k")
    d, c = _gap_after(k)
    down = F.when(k > 1, F.sequence(k - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    label = F.when(k > 1, F.concat(F.array("_sc"), F.array_repeat(F.lit(EMPTY), k - 2))).otherwise(F.array().cast("array<string>"))
    w = _with_chains(sents).select("tree_id", F.struct("lo", F.concat(down, F.array(d.cast("int"))).alias("d"),
                                                       F.concat(label, F.array(c)).alias("c")).alias("_s"))
    whole = w.groupBy("tree_id").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return whole.select("tree_id", F.flatten("_s.d").alias("d"), F.flatten("_s.c").alias("c"))


def encode_sentences(sents: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """C7-C9 from sentence rows: (tree_id, tok, d, c, u), one row per word.

    ``d`` and ``c`` are the height and label of the gap after the word, null after the last one.  Inside a
    sentence the lowest common ancestor is the sentence, whose later words sit ``k - wj`` levels down;
    between sentences it is the line, between lines the document.  Sentences with their words give
    ``token`` and ``next`` too, the word and the one after it in the document (null after the last).
    """
    w = _with_chains(sents)
    extra = []
    if "sent" in sents.columns:
        w = w.withColumn("_ws", F.filter(F.split("sent", " ", -1), lambda x: x != ""))
        pairs = F.transform("_ws", lambda x, i: F.struct(x.alias("token"), F.get("_ws", i + 1).alias("next")))
        w = w.select(*[c for c in w.columns if c not in ("sent", "_ws")], F.posexplode_outer(pairs).alias("_at", "_w"))
        w = w.withColumn("wj", F.coalesce("_at", F.lit(0)) + 1)
        extra = [F.col("_w.token").alias("token"), F.coalesce("_w.next", "after").alias("next")]
    else:
        w = w.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("wj"))
    d, c = _gap_after(F.col("wj"))
    u = F.when((F.col("k") == 1) & (F.col("lines") > 0), F.col("_sc")).otherwise(F.lit(EMPTY))
    return w.select("tree_id", *keep, (F.col("lo") + F.col("wj") - 1).cast("int").alias("tok"),
                    d.cast("int").alias("d"), c.alias("c"), u.alias("u"), *extra)


def sentence_spans(sents: DataFrame) -> DataFrame:
    """C7 from sentence rows: (tree_id, label, lo, hi) of every document, line and sentence."""
    span = lambda label, n: F.struct(label.alias("label"), F.col("lo").alias("lo"),
                                     (F.col("lo") + n - 1).cast("int").alias("hi"))
    new_line = F.col("sj") == 1
    out = F.array_compact(F.array(
        F.when(new_line & (F.col("lj") == 1), span(F.lit("document"), F.col("tk"))),
        F.when(new_line, span(F.lit("line"), F.col("lk"))), span(F.col("stype"), F.col("k"))))
    return sents.where("lines > 0").select("tree_id", F.explode(out).alias("_s")).select("tree_id", "_s.*")


def word_features(words: DataFrame) -> DataFrame:
    """C10 from the rows of ``encode_sentences``: (tree_id, d, c, u, num_tokens), one aggregate and no join."""
    a = words.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("tok", "d", "c", "u"))).alias("a"))
    n = F.size("a")
    return a.select("tree_id", F.slice("a.d", F.lit(1), n - 1).alias("d"), F.slice("a.c", F.lit(1), n - 1).alias("c"),
                    F.col("a.u").alias("u"), n.alias("num_tokens"))


def nest_orders(customer: DataFrame, orders: DataFrame, lineitem: DataFrame,
                max_lines: int = 1 << 32) -> DataFrame:
    """C1 on relational input: customer -> order -> lineitem trees.

    Positions are logical (``start`` orders siblings): a customer's ``k``-th order
    (by key) sits at ``2**32 * k`` and its lines follow it, numbered by
    ``(l_linenumber, l_partkey, l_suppkey)`` within the order (line numbers
    may repeat).  Orders without lines are childless non-terminals.

    Orders meet their lines by order key first; the narrow rows are then dealt by customer once, and
    each customer and order node is emitted by the first row under it.  Besides the node columns it
    returns ``depth``, ``j``, ``kp`` and ``k``, so the closure is one sorted stream.
    """
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ol = orders.select(F.col("o_custkey").alias("tree_id"), "o_orderkey", "o_orderstatus")
    ol = ol.join(li, ol.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")
    r = by_tree(customer.select(F.col("c_custkey").alias("tree_id"))).join(by_tree(ol), "tree_id", "left")
    item = F.col("l_linenumber").isNotNull() | F.col("l_returnflag").isNotNull()
    order = W.partitionBy("tree_id", "o_orderkey")
    tree = W.partitionBy("tree_id")
    r = (r.withColumn("rn", F.row_number().over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey")))
         .withColumn("ok", F.count(F.when(item, 1)).over(order))
         .withColumn("oj", F.dense_rank().over(tree.orderBy("o_orderkey")).cast("long"))
         .withColumn("tk", F.when(F.col("o_orderkey").isNull(), 0).otherwise(F.max("oj").over(tree))))
    base = F.col("oj") * max_lines
    node = lambda depth, nid, parent, typ, term, j, kp, k: F.struct(
        nid.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), typ.alias("type"),
        F.lit(term).alias("is_terminal"), nid.cast("long").alias("start"), (nid + 1).cast("long").alias("end"),
        F.lit(depth).alias("depth"), j.cast("int").alias("j"), kp.cast("int").alias("kp"), k.cast("int").alias("k"))
    new_order = F.col("o_orderkey").isNotNull() & (F.col("rn") == 1)
    emitted = F.array_compact(F.array(
        F.when((F.col("oj") == 1) & (F.col("rn") == 1), node(
            0, F.lit(0), F.lit(None), F.lit("customer"), False, F.lit(1), F.lit(None), F.col("tk"))),
        F.when(new_order, node(1, base, F.lit(0), F.concat(F.lit("order_"), F.lower("o_orderstatus")), False,
                               F.col("oj"), F.col("tk"), F.col("ok"))),
        F.when(item, node(2, base + F.col("rn"), base, F.concat(F.lit("item_"), F.lower("l_returnflag")), True,
                          F.col("rn"), F.col("ok"), F.lit(0)))))
    return r.select("tree_id", F.explode(emitted).alias("n")).select("tree_id", "n.*")


# ---------------------------------------------------------------------------
# Structure helpers
# ---------------------------------------------------------------------------

def roots(nodes: DataFrame) -> DataFrame:
    """C2."""
    return nodes.where(F.col("parent_id").isNull())


def tokens(nodes: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Terminal tokens ordered by (start, node_id) with their byte-range text.

    The ranges of a tree meet its text once, as one sorted array; the text is encoded once, before the
    exchange, and never copied to the tokens.  Trees in rows (``text_trees``) hold their text: their tokens
    are cut in the row and stay there (arrays ``node_id``, ``start``, ``end``, ``token``, by the place that is ``tok``).
    """
    if "nodes" in nodes.columns:
        words = F.filter("nodes", lambda n: n["depth"] == 3)  # in preorder, so by (start, node_id)
        part = F.transform(words, lambda n: F.substring(F.col("_bytes"), n["start"] + 1, n["end"] - n["start"]).cast("string"))
        worded = nodes.where(F.col("text").rlike("[^ \n]"))  # before anything is cut; a tree without tokens is left out
        kept = [c for c in nodes.columns if c not in ("text", "nodes")]
        return worded.withColumn("_bytes", F.col("text").cast("binary")).select(
            *kept, *[words[x].alias(x) for x in ("node_id", "start", "end")], part.alias("token"))
    t = by_tree(texts.select(F.col(id_col).cast("long").alias("tree_id"),
                             F.encode(F.col(text_col), "UTF-8").alias("_bytes")))
    ranges = (nodes.where("is_terminal").groupBy("tree_id")
              .agg(F.sort_array(F.collect_list(F.struct("start", "node_id", "end"))).alias("_r")))
    cut = F.transform("_r", lambda r: F.struct(
        r["node_id"].alias("node_id"), r["start"].alias("start"), r["end"].alias("end"),
        F.decode(F.substring(F.col("_bytes"), r["start"] + 1, r["end"] - r["start"]), "UTF-8").alias("token")))
    return (ranges.join(t, "tree_id").select("tree_id", F.posexplode(cut).alias("tok", "_t"))
            .select("tree_id", "tok", "_t.*"))


def dense_ids(row: np.ndarray, start: np.ndarray, node_id: np.ndarray, parent_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``next_ids`` over columns, trees in order of ``row``: new ids, and the new ids of the parents (-1 for none)."""
    order = np.lexsort((node_id, start, row))
    begin = np.searchsorted(row, row)
    new = np.empty(len(row), np.int64)
    new[order] = np.arange(len(row)) - begin[order]
    by_id = np.lexsort((node_id, row))
    wide = int(max(node_id.max(initial=0), parent_id.max(initial=0))) + 2
    keys = row[by_id] * wide + node_id[by_id]
    want = row * wide + parent_id
    at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    there = (parent_id >= 0) & (keys[at] == want) if len(keys) else np.zeros(0, bool)
    return new, np.where(there, new[by_id[at]], -1) if len(keys) else new


TOP_NODES = ('tree_id long, node_id int, parent_id int, type string, is_terminal boolean, start int, `end` int, depth int, n_roots long, '
             'root_end int')


def nodes_with_tops(cols: pa.RecordBatch, w: Levels):
    """C1, C2, C18 of cut texts: their nodes with dense ids, the number of roots of their tree and where the first ends."""
    n = nodes_of(w)
    new, parent = dense_ids(n["row"], n["start"], n["node_id"], n["parent_id"])
    root = n["parent_id"] < 0
    n_roots = np.bincount(n["row"][root], minlength=len(w.size))
    root_end = np.full(len(w.size), np.iinfo(np.int32).max, np.int64)
    np.minimum.at(root_end, n["row"][root], n["end"][root])
    row = pa.array(n["row"])
    num = lambda x, mask=None: pa.array(x.astype(np.int32), mask=mask)
    yield pa.RecordBatch.from_arrays(
        [cols.column("tree_id").take(row), num(new), num(parent, parent < 0), pa.array(_TYPES, pa.string()).take(pa.array(n["type"])),
         pa.array(n["depth"] == 3), num(n["start"]), num(n["end"]), num(n["depth"]), pa.array(n_roots[n["row"]]), num(root_end[n["row"]])],
        ["tree_id", "node_id", "parent_id", "type", "is_terminal", "start", "end", "depth", "n_roots", "root_end"])


def next_ids(nodes: DataFrame) -> DataFrame:
    """Dense ids within each tree (ordered by start, old id); parents follow their nodes."""
    w = W.partitionBy("tree_id").orderBy("start", "node_id")
    new = nodes.withColumn("_new", (F.row_number().over(w) - 1).cast("int"))
    names = new.select("tree_id", F.col("node_id").alias("parent_id"), F.col("_new").alias("_parent"))
    out = new.join(names, ["tree_id", "parent_id"], "left")
    return out.select(*[F.col({"node_id": "_new", "parent_id": "_parent"}.get(c, c)).alias(c) for c in nodes.columns])


def drop_nodes(nodes: DataFrame, cond: Column) -> DataFrame:
    """Drop nodes matching ``cond`` (e.g. go newline tokens), nothing else."""
    return nodes.where(~F.coalesce(cond, F.lit(False)))


def has_error(nodes: DataFrame, error_type: str = "ERROR") -> DataFrame:
    """Per tree, whether any node has the error type."""
    return nodes.groupBy("tree_id").agg(F.bool_or(F.col("type") == error_type).alias("has_error"))


def children_stats(nodes: DataFrame) -> DataFrame:
    """Per node: sibling ordinal ``j``, parent's child count ``kp``, own child count ``k``."""
    sib = W.partitionBy("tree_id", "parent_id")
    n = (nodes.withColumn("j", F.row_number().over(sib.orderBy("start", "node_id")).cast("int"))
         .withColumn("kp", F.count(F.lit(1)).over(sib).cast("int")))
    kids = (nodes.where(F.col("parent_id").isNotNull())
            .groupBy("tree_id", F.col("parent_id").alias("node_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("k")))
    return (n.join(kids, ["tree_id", "node_id"], "left")
            .withColumn("k", F.coalesce("k", F.lit(0))))


def preorder_paths(nodes: DataFrame, max_depth: int | None = None,
                   order: tuple[str, ...] = ("start", "depth")) -> DataFrame:
    """C6 in one sort: the ancestor of a node at depth t is the last node of
    depth t seen before it in preorder.

    Needs ``depth``, ``j`` (sibling ordinal), ``kp`` (parent fan-out) and ``k``
    (fan-out); ``order`` must sort each tree in preorder.  One running window
    collects the ancestors, short array functions (bounded by depth) give the
    binary depth ``C`` and fused chain label ``chain`` of every path element.
    It also adds ``tok`` (leaf rank) and ``prev_path`` (path of the previous
    leaf), both read from the same sorted stream.
    """
    if max_depth is None:
        max_depth = nodes.agg(F.max("depth")).first()[0] or 0
    w = W.partitionBy("tree_id").orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cost = F.when(F.col("kp").isNull() | (F.col("kp") == 1), F.lit(0)) \
        .otherwise(F.least(F.col("j"), F.col("kp") - 1))
    el = F.struct(F.col("node_id").alias("node"), F.col("j"), F.col("kp"), F.col("type"),
                  cost.alias("cost"))
    n = nodes.select("*", *[F.last(F.when(F.col("depth") == t, el), True).over(upto).alias(f"_a{t}")
                            for t in range(max_depth + 1)])
    # binary depth and chain label of every ancestor as plain (codegen) expressions
    cs, chains, elems = [], [], []
    for t in range(max_depth + 1):
        a_t = F.col(f"_a{t}")
        cs.append(a_t["cost"] if t == 0 else cs[-1] + a_t["cost"])
        chains.append(a_t["type"] if t == 0 else F.when(a_t["kp"] == 1, F.concat(chains[-1], F.lit(SEP), a_t["type"]))
                      .otherwise(a_t["type"]))
        elems.append(F.struct(a_t["node"].alias("node"), a_t["j"].alias("j"),
                              cs[-1].cast("int").alias("C"), chains[-1].alias("chain")))
    n = n.withColumn("path", F.slice(F.array(*elems), 1, F.col("depth") + 1))
    n = (n.withColumn("C", F.element_at("path", -1)["C"])
         .withColumn("chain", F.element_at("path", -1)["chain"])
         .drop(*[f"_a{t}" for t in range(max_depth + 1)]))
    leaf = F.col("k") == 0
    n = (n.withColumn("tok", (F.sum(leaf.cast("int")).over(upto) - 1).cast("int"))
         .withColumn("prev_path", F.last(F.when(leaf, F.col("path")), True)
                     .over(w.rowsBetween(W.unboundedPreceding, -1))))
    return n


def root_paths(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """C6 + C8 state: the closure over ancestors by path doubling.

    Adds ``depth``, binary depth ``C``, fused chain label ``chain`` and the root path
    ``path: array<struct<node,j,C,chain>>``.  A node table with ``depth``, ``j``, ``kp`` and ``k`` takes one
    sorted stream (``preorder_paths``).  Otherwise every node starts with the path of itself alone; a
    round puts the path of the ancestor that a path ends below in front of it, so paths double and a tree
    of any depth takes the logarithm of its depth in joins.  Depths and chain labels of a piece are
    relative to its beginning and are shifted when pieces meet.  Rounds are written below
    ``spark.checkpoint.dir``; nothing is persisted.  Nodes that no root is above are left out.
    """
    if {"depth", "j", "kp", "k"} <= set(nodes.columns):
        return preorder_paths(nodes, max_depth)
    from lignum.operators.order import staged
    s = children_stats(nodes.select(*NODE_COLS))
    inner = F.col("parent_id").isNotNull()
    single = inner & (F.col("kp") == 1)
    cost = F.when(inner & ~single, F.least(F.col("j"), F.col("kp") - 1)).otherwise(F.lit(0))
    own = F.struct(F.col("node_id").alias("node"), F.col("j"), cost.cast("int").alias("C"), F.col("type").alias("chain"),
                   single.alias("fused"))
    now = staged(s.withColumn("path", F.array(own)).withColumn("_up", F.col("parent_id")), "paths")
    largest = now.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(largest).bit_length() + 1):
        waiting = now.where(F.col("_up").isNotNull())
        if waiting.isEmpty():
            break
        above = now.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("path").alias("_p"),
                           F.col("_up").alias("_next"))
        end = F.element_at("_p", -1)
        shifted = F.transform("path", lambda e: F.struct(
            e["node"].alias("node"), e["j"].alias("j"), (e["C"] + end["C"]).alias("C"),
            F.when(e["fused"], F.concat_ws(SEP, end["chain"], e["chain"])).otherwise(e["chain"]).alias("chain"),
            (e["fused"] & end["fused"]).alias("fused")))
        longer = (waiting.join(above, (F.col("tree_id") == F.col("_t")) & (F.col("_up") == F.col("_n")))
                  .withColumn("path", F.concat("_p", shifted)).withColumn("_up", F.col("_next")).select(*now.columns))
        now = staged(now.where(F.col("_up").isNull()).unionByName(longer), "paths")
    bare = F.transform("path", lambda e: F.struct(e["node"].alias("node"), e["j"].alias("j"), e["C"].alias("C"),
                                                  e["chain"].alias("chain")))
    last = F.element_at("path", -1)
    # what still waits lies in or under a cycle
    return (now.where(F.col("_up").isNull()).drop("_up").withColumn("depth", F.size("path") - 1)
            .withColumn("C", last["C"]).withColumn("chain", last["chain"]).withColumn("path", bare))


def level_sizes(paths: DataFrame) -> DataFrame:
    """C20: nodes per depth."""
    return paths.groupBy("tree_id", "depth").agg(F.count(F.lit(1)).alias("n_nodes"))


# ---------------------------------------------------------------------------
# C4: collapse string literals
# ---------------------------------------------------------------------------

def is_literal_type(t: Column) -> Column:
    return (t == "string") | t.contains("string_literal")


def literal_types(types: tuple[str, ...]) -> np.ndarray:
    """``is_literal_type`` of names."""
    return np.array([x == "string" or "string_literal" in x for x in types])


def collapsed(nodes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """C4 over the nodes of cut texts (``nodes_of``): which stay, as no node above them is a literal, and which of all nodes are
    terminal then.  A parent comes before its children, a level at a time is told by the one above."""
    literal = literal_types(_TYPES)[nodes["type"]]
    first = np.searchsorted(nodes["row"], nodes["row"])
    up = first + np.maximum(nodes["parent_id"], 0)
    under = np.zeros(len(literal), bool)
    for depth in range(1, int(nodes["depth"].max(initial=0)) + 1):
        at = np.flatnonzero(nodes["depth"] == depth)
        under[at] = literal[up[at]] | under[up[at]]
    return ~under, (nodes["depth"] == 3) | literal


def collapsed_counts(cols: pa.RecordBatch, w: Levels):
    """Numbers of nodes and terminals of each document after ``collapsed``."""
    nodes = nodes_of(w)
    stays, terminal = collapsed(nodes)
    n_nodes, n_terminals = (np.bincount(nodes["row"][x], minlength=len(w.size)) for x in (stays, stays & terminal))
    yield pa.RecordBatch.from_arrays([cols.column("tree_id"), pa.array(n_nodes), pa.array(n_terminals)], ["tree_id", "n_nodes", "n_terminals"])


def collapse_literals(nodes: DataFrame, pred=is_literal_type, paths: DataFrame | None = None) -> DataFrame:
    """C4: a non-terminal matching ``pred`` loses all descendants and becomes terminal.

    A proper ancestor is never a terminal and its type is the last part of its chain label, so the root
    path of a node alone tells whether it goes: no join.
    """
    paths = paths if paths is not None else root_paths(nodes)
    own = lambda e: pred(F.element_at(F.split(e["chain"], SEP), -1))
    kept = paths.where(~F.exists(F.slice("path", 1, F.size("path") - 1), own))
    return (kept.withColumn("is_terminal", F.col("is_terminal") | pred(F.col("type")))
            .select(*[c for c in nodes.columns if c in paths.columns]))


# ---------------------------------------------------------------------------
# Tree validity
# ---------------------------------------------------------------------------

def reached_nodes(ids, parents) -> int:
    """Rows of a node table that a root is above, by pointer doubling; a parent below 0 is none.  An id that
    comes twice counts for each of its rows, a row whose parent comes twice once for each parent row."""
    order = np.argsort(ids, kind="stable")
    ids, parents = ids[order], parents[order]
    first = np.searchsorted(ids, parents)
    times = np.searchsorted(ids, parents, side="right") - first
    root = parents == NO_PARENT
    if len(ids) < 2 or (np.diff(ids) > 0).all():
        up = np.where(root, -1, np.where(times > 0, first, -2))  # -1: reached, -2: never
        for _ in range(len(ids).bit_length() + 1):
            at = np.flatnonzero(up >= 0)
            if not len(at):
                break
            up[at] = up[up[at]]
        return int((up == -1).sum())
    # repeated ids: ways from a root, level by level
    kids = np.argsort(parents, kind="stable")
    below = parents[kids]
    level, total = np.flatnonzero(root), 0
    for _ in range(len(ids) + 1):
        if not len(level):
            break
        total += len(level)
        lo, hi = np.searchsorted(below, ids[level]), np.searchsorted(below, ids[level], side="right")
        level = kids[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())]
    return total


NO_PARENT = np.iinfo(np.int64).min


@F.pandas_udf(LongType())
def _reached_udf(ids: pd.Series, parents: pd.Series) -> pd.Series:
    return pd.Series([reached_nodes(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(ids, parents)])


def _check_links(nodes: DataFrame) -> DataFrame:
    """``tree_check`` from the parent pointers of each tree, without its paths."""
    ensure_shipped(nodes.sparkSession)
    link = F.struct(F.col("node_id").cast("long").alias("n"), F.coalesce(F.col("parent_id").cast("long"), F.lit(NO_PARENT)).alias("p"))
    per = nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"),
        F.collect_list(link).alias("_l"))
    reached = F.when(F.col("tree_id").isNull(), F.lit(0).cast("long")).otherwise(_reached_udf(F.col("_l.n"), F.col("_l.p")))
    return per.select("tree_id", "n_nodes", "n_roots", reached.alias("n_reached")).withColumn(
        "is_tree", (F.col("n_roots") == 1) & (F.col("n_reached") == F.col("n_nodes")))


def tree_check(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Exactly one root, every parent exists, and every node is reached from the root.

    Without ``paths`` the parent pointers of a tree meet in one row of numbers, and no paths are made."""
    if paths is None:
        return _check_links(nodes)
    per = nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("parent_id").isNull()).alias("n_roots"))
    reached = paths.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_reached"))
    return (per.join(reached, "tree_id", "left")
            .withColumn("n_reached", F.coalesce("n_reached", F.lit(0)))
            .withColumn("is_tree", (F.col("n_roots") == 1) & (F.col("n_reached") == F.col("n_nodes"))))


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------

def encode(nodes: DataFrame, paths: DataFrame | None = None,
           max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C8+C9: node table -> (gaps, leaves).

    gaps:   (tree_id, gap, d, c)    one row per pair of adjacent leaves
    leaves: (tree_id, tok, node_id, u, path)   (``path`` also gives the
            tree's own spans, see ``spans.tree_spans``)

    For adjacent leaves with lowest common ancestor ``n`` whose children
    ``j`` and ``j+1`` hold them: ``d = max{C(leaf) under children >= j of n}
    - C(n) - (j-1)``, ``c = chain(n)`` if ``j = 1`` else ``<empty>``.
    """
    paths = paths if paths is not None else root_paths(nodes, max_depth=max_depth)
    leaf = paths.where(F.col("k") == 0)
    if "tok" not in paths.columns:
        order = W.partitionBy("tree_id").orderBy("start", "node_id")
        leaf = leaf.withColumn("tok", (F.row_number().over(order) - 1).cast("int"))
        leaf = leaf.withColumn("prev_path", F.lag("path").over(W.partitionBy("tree_id").orderBy("tok")))
    parent_el = F.when(F.size("path") > 1, F.element_at("path", -2))
    leaves = leaf.select(
        "tree_id", "tok", "node_id", "C", "path", "prev_path",
        F.when((F.col("kp") == 1) & F.col("parent_id").isNotNull(), parent_el.getField("chain"))
        .otherwise(F.lit(EMPTY)).alias("u"))
    # D(x): deepest binary leaf depth below x, keyed by (parent, ordinal) of x
    deep = (leaves.select("tree_id", "C", F.posexplode("path").alias("pos", "e"), "path")
            .where(F.col("pos") > 0)
            .select("tree_id", "C", F.col("path")[F.col("pos") - 1]["node"].alias("lca"),
                    F.col("e.j").alias("j"))
            .groupBy("tree_id", "lca", "j").agg(F.max("C").alias("D")))
    suffix = W.partitionBy("tree_id", "lca").orderBy(F.col("j").desc()) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    child = deep.select("tree_id", "lca", "j", F.max("D").over(suffix).alias("smax"))
    g = leaves.where(F.col("prev_path").isNotNull()).select(
        "tree_id", (F.col("tok") - 1).alias("gap"), F.col("prev_path").alias("a"), F.col("path").alias("b"))
    common = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x.getField("node") == y.getField("node")),
                             lambda e: F.coalesce(e, F.lit(False))))
    g = g.withColumn("L", common)
    g = g.select("tree_id", "gap", F.element_at("a", F.col("L")).alias("n"),
                 F.element_at("a", F.col("L") + 1).getField("j").alias("j"))
    g = g.select("tree_id", "gap", F.col("n.node").alias("lca"), "j",
                 F.col("n.C").alias("nC"), F.col("n.chain").alias("nchain"))
    gaps = (g.join(child, ["tree_id", "lca", "j"])
            .select("tree_id", F.col("gap").cast("int"),
                    (F.col("smax") - F.col("nC") - (F.col("j") - 1)).cast("int").alias("d"),
                    F.when(F.col("j") == 1, F.col("nchain")).otherwise(F.lit(EMPTY)).alias("c")))
    return gaps, leaves.select("tree_id", "tok", "node_id", "u", "path")


def features(gaps: DataFrame, leaves: DataFrame) -> DataFrame:
    """Compact per-tree rows (d, c, u arrays, num_tokens)."""
    ga = gaps.groupBy("tree_id").agg(
        F.sort_array(F.collect_list(F.struct("gap", "d", "c"))).alias("g"))
    la = leaves.groupBy("tree_id").agg(
        F.sort_array(F.collect_list(F.struct("tok", "u"))).alias("l"))
    return la.join(ga, "tree_id", "left").select(
        "tree_id",
        F.coalesce(F.col("g.d"), F.array().cast("array<int>")).alias("d"),
        F.coalesce(F.col("g.c"), F.array().cast("array<string>")).alias("c"),
        F.col("l.u").alias("u"),
        F.size("l").alias("num_tokens"))


def render_gaps(tokens_df: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Inline rendering ``tok0 -c d- tok1 ...`` (one string per tree).

    Without ``gaps`` the trees lie in rows and hold the arrays ``token``, ``d`` and ``c`` (``sentence_gaps``)."""
    if gaps is None:
        def shown(t: Column, i: Column) -> Column:
            c = F.get("c", i)
            return F.when(c.isNull(), t).otherwise(F.concat(t, F.lit(" -"), c, F.lit(" "), F.get("d", i).cast("string"), F.lit("-")))
        return tokens_df.select("tree_id", F.array_join(F.transform("token", shown), " ").alias("rendered"))
    t = tokens_df.select("tree_id", "tok", "token")
    g = gaps.select("tree_id", F.col("gap").alias("tok"), "c", "d")
    piece = F.when(F.col("c").isNull(), F.col("token")).otherwise(
        F.concat(F.col("token"), F.lit(" -"), F.col("c"), F.lit(" "), F.col("d").cast("string"), F.lit("-")))
    j = t.join(g, ["tree_id", "tok"], "left").select("tree_id", "tok", piece.alias("piece"))
    return (j.groupBy("tree_id")
            .agg(F.sort_array(F.collect_list(F.struct("tok", "piece"))).alias("p"))
            .select("tree_id", F.array_join(F.col("p.piece"), " ").alias("rendered")))
