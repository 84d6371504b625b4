"""Trees out of sequences, and the edits that lead from one form of a tree to another.

Everything here takes and returns node tables ``(tree_id, node_id, parent_id, type, is_terminal, start,
end, unary)``, children ordered by ``(start, node_id)``.

- ``parse_nodes`` (C11) turns gap heights into a binary tree.  The tree over the gaps is the Cartesian tree
  of the heights, whose parent pointers come from the nearest greater neighbours of each gap.
- ``remove_fillers`` (C12) contracts ``<empty>`` nodes: what hangs on them moves to the nearest ancestor that
  stays, found by pointer jumping over the numbers of a tree.
- ``add_unary`` (C14) and ``split_fused`` (C13) insert chains of nodes; fresh ids are prefix sums over the tree.
- ``binarise`` (C8) goes the other way: single-child chains are fused by pointer jumping, and the fillers
  of a node with many children are numbered by prefix sums over its tree.

No step recurses, and none holds more than one tree's row of a window in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lignum.functions.constants import BAD_ROOT, EMPTY, SEP
from lignum.operators.order import staged
from lignum.operators.spans import bounds_of_trees, span_bounds
from lignum.operators.trees import LABELS, children_stats
from lignum.ship import ensure_shipped

PARSE_COLS = ["tree_id", "node_id", "parent_id", "type", "is_terminal", "start", "end", "unary"]


def cartesian_tree(d) -> tuple[np.ndarray, ...]:
    """The binary tree over ``len(d) + 1`` tokens in preorder: ``gap`` (-1 for a token), token range
    ``lo .. hi`` and the place of the parent (-1 for the root)."""
    d = np.asarray(d, dtype=np.float64)
    n = len(d)
    lo, hi = (x.astype(np.int64) for x in span_bounds(d))

    def parent(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The lower of two neighbouring gaps; of two alike the right one, as the first maximum is the root."""
        both = (left >= 0) & (right >= 0)
        if not n:
            return np.full(len(left), -1)
        return np.where(both, np.where(d[left] < d[right], left, right), np.maximum(left, right))

    tokens = np.arange(n + 1)
    above = np.concatenate([parent(lo - 1, np.where(hi < n, hi, -1)),
                            parent(tokens - 1, np.where(tokens < n, tokens, -1))])
    lo, hi = np.concatenate([lo, tokens]), np.concatenate([hi, tokens])
    order = np.lexsort((-hi, lo))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    gap = np.concatenate([np.arange(n), np.full(n + 1, -1)])
    above = np.where(above >= 0, place[above], -1)
    return gap[order], lo[order], hi[order], above[order]


_TREE_TYPE = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("gap", "lo", "hi", "parent")])


@F.pandas_udf(_TREE_TYPE)
def _tree_udf(d: pd.Series) -> pd.DataFrame:
    rows = [[x.astype(np.int32) for x in cartesian_tree(a)] for a in d]
    return pd.DataFrame(rows, columns=["gap", "lo", "hi", "parent"])


def parse_nodes(feat: DataFrame, tokens: Column | None = None, parts: int | None = None) -> DataFrame:
    """C11: compact rows (tree_id, d, c, u) -> node table, ids in preorder; the compact rows are dealt by tree
    into ``parts`` partitions, so that no later step has to deal their nodes.

    A gap becomes an inner node with the gap's label, over the tokens ``start .. end - 1``; a token a leaf
    whose type is its text (``tokens``, or its number) and whose ``unary`` is its label.
    """
    ensure_shipped(feat.sparkSession)
    texts = tokens if tokens is not None else F.lit(None).cast("array<string>")
    t = feat.select("tree_id", "c", "u", texts.alias("_texts"), _tree_udf(F.col("d").cast("array<double>")).alias("t"))
    if parts:
        t = t.repartition(parts, "tree_id")
    nodes = t.select("tree_id", "c", "u", "_texts", F.posexplode(
        F.arrays_zip("t.gap", "t.lo", "t.hi", "t.parent")).alias("node_id", "n"))
    leaf = F.col("n.gap") < 0
    text = F.coalesce(F.get("_texts", F.col("n.lo")), F.col("n.lo").cast("string"))
    return nodes.select(
        "tree_id", "node_id", F.when(F.col("n.parent") >= 0, F.col("n.parent")).alias("parent_id"),
        F.when(leaf, text).otherwise(F.get("c", F.greatest(F.col("n.gap"), F.lit(0)))).alias("type"),
        leaf.alias("is_terminal"), F.col("n.lo").alias("start"), (F.col("n.hi") + 1).alias("end"),
        F.when(leaf, F.get("u", F.col("n.lo"))).alias("unary"))


def follow(node: np.ndarray, up: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """The links of one tree followed to their ends: the row of each link, where it ends and its hops.

    Each round doubles the way.  A node that comes twice leads on by each of its links, so its followers
    come once for each.  None for a cycle.
    """
    row = np.arange(len(node))
    for _ in range(max(len(node), 1).bit_length() + 1):
        order = np.argsort(node, kind="stable")
        first = np.searchsorted(node[order], up)
        times = np.searchsorted(node[order], up, side="right") - first
        if not times.any():
            return row, up, hops
        each = np.maximum(times, 1)
        at = np.repeat(np.arange(len(up)), each)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        on = times[at] > 0
        nxt = order[np.where(on, first[at] + nth, 0)]
        row, node, up, hops = row[at], node[at], np.where(on, up[nxt], up[at]), hops[at] + np.where(on, hops[nxt], 0)
    return None


_WAYS = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("node", "up", "hops")])


@F.pandas_udf(_WAYS)
def _follow_udf(node: pd.Series, up: pd.Series, hops: pd.Series) -> pd.DataFrame:
    out = []
    for links in zip(node, up, hops):
        n, u, h = (np.asarray(x, np.int64) for x in links)
        ends = follow(n, u, h)
        out.append((n[ends[0]], *ends[1:]) if ends else (n[:1], [None], h[:1]))
    return pd.DataFrame(out, columns=["node", "up", "hops"])


def jump(links: DataFrame) -> DataFrame:
    """Pointer jumping over ``(tree_id, node, up, hops)``: while ``up`` is itself a ``node``, follow it.

    The links of a tree meet in one row of numbers and are followed there: no round is joined, and only
    the ends are written below ``spark.checkpoint.dir``.  Links of no tree, or without a node or an end, lead
    nowhere else.  A cycle is an error.
    """
    ensure_shipped(links.sparkSession)
    whole = F.col("tree_id").isNotNull() & F.col("node").isNotNull() & F.col("up").isNotNull()
    per = links.where(whole).groupBy("tree_id").agg(F.collect_list(F.struct(
        *[F.col(c).cast("long").alias(c) for c in ("node", "up", "hops")])).alias("_l"))
    ways = per.select("tree_id", _follow_udf("_l.node", "_l.up", "_l.hops").alias("_w"))
    ways = ways.select("tree_id", F.explode(F.arrays_zip("_w.node", "_w.up", "_w.hops")).alias("_e"))
    ends = ways.select("tree_id", *[F.col(f"_e.{c}").cast(links.schema[c].dataType).alias(c) for c in ("node", "up", "hops")])
    ends = staged(ends.withColumn("whole", F.lit(True)).unionByName(links.where(~whole).withColumn("whole", F.lit(False))), "links")
    if not ends.where("whole AND up IS NULL").isEmpty():
        raise ValueError("the parents of some nodes form a cycle")
    return ends.drop("whole")


def contract(nodes: DataFrame, gone: Column) -> DataFrame:
    """Removes the nodes that match ``gone`` (never a root); children move to the nearest ancestor that stays."""
    gone = F.coalesce(gone, F.lit(False)) & F.col("parent_id").isNotNull()
    dead = jump(nodes.where(gone).select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("up"),
                                         F.lit(1).cast("long").alias("hops")))
    up = dead.select("tree_id", F.col("node").alias("parent_id"), F.col("up").alias("_up"))
    kept = nodes.where(~gone).join(up, ["tree_id", "parent_id"], "left")
    return kept.select(*[F.coalesce("_up", "parent_id").alias(c) if c == "parent_id" else F.col(f"`{c}`")
                         for c in nodes.columns])


def remove_fillers(nodes: DataFrame) -> DataFrame:
    """``<empty>`` nodes go; a root of that type stays as ``bad_root``."""
    kept = contract(nodes, F.col("type") == EMPTY)
    return kept.withColumn("type", F.when(F.col("type") == EMPTY, F.lit(BAD_ROOT)).otherwise(F.col("type")))


class Forest:
    """Sequences of many trees, one after the other: ``lens`` gaps a tree, their heights ``d`` and labels ``c``, and the labels ``u``
    of its ``lens + 1`` tokens, labels as places in ``trees.LABELS``."""

    def __init__(self, lens: np.ndarray, d: np.ndarray, c: np.ndarray, u: np.ndarray):
        self.lens, self.d, self.c, self.u = lens, d, c, u


def parsed(f: Forest) -> dict[str, np.ndarray]:
    """``parse_nodes`` of many trees at once, a tree after the other and its nodes in preorder: ``up`` is the place of the parent in
    all of them (-1 for a root)."""
    tree = np.repeat(np.arange(len(f.lens)), f.lens)
    gap0 = np.cumsum(f.lens) - f.lens
    tok0 = gap0 + np.arange(len(f.lens))
    leaf_tree = np.repeat(np.arange(len(f.lens)), f.lens + 1)
    tok = np.arange(len(leaf_tree)) - tok0[leaf_tree]
    lo, hi = (x.astype(np.int64) for x in bounds_of_trees(f.d, f.lens))

    def above(row, left, right):
        """The lower of two neighbouring gaps; of two alike the right one, as the first maximum is the root."""
        none = left < 0, right >= f.lens[row]
        left, right = left + gap0[row], right + gap0[row]
        if not len(f.d):
            return np.full(len(row), -1)
        low = f.d[np.where(none[0], 0, left)] < f.d[np.where(none[1], 0, right)]
        return np.where(none[0] & none[1], -1, np.where(none[0], right, np.where(none[1], left, np.where(low, left, right))))

    up = np.concatenate([above(tree, lo - 1, hi), above(leaf_tree, tok - 1, tok)])
    row, lo, hi = np.concatenate([tree, leaf_tree]), np.concatenate([lo, tok]), np.concatenate([hi, tok])
    n = len(leaf_tree)
    order = np.argsort((tok0[row] + lo) * (n + 1) + n - (hi - lo))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    up = np.where(up >= 0, place[up], -1)[order]   # gaps come first
    row = row[order]
    first = np.searchsorted(row, row)
    return {"tree": row, "node_id": np.arange(len(row)) - first, "up": up, "label": np.concatenate([f.c, f.u])[order],
            "leaf": (order >= len(tree)), "lo": lo[order], "hi": hi[order]}


def _labels(extra: tuple[str, ...]) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """Parts of the labels of ``trees.LABELS`` and of ``extra``: their names, how many each label has, and their places."""
    split = [x.split(SEP) for x in (*LABELS, *extra)]
    names = tuple(dict.fromkeys(y for x in split for y in x))
    return names, np.array([len(x) for x in split]), np.array([names.index(y) for x in split for y in x])


PART_NAMES, _N_PARTS, _PARTS = _labels((BAD_ROOT,))
_BAD_ROOT = len(LABELS)
RESTORED = "tree_id long, node_id long, parent_id long, type string, is_terminal boolean, start int, `end` int"


def _fresh_ids(tree: np.ndarray, node_id: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``_fresh`` of nodes in order of tree and id."""
    top = np.flatnonzero(np.r_[tree[1:] != tree[:-1], True])
    first = np.r_[0, top[:-1] + 1]
    before = np.cumsum(need) - need
    run = np.repeat(np.arange(len(top)), np.diff(np.r_[first, len(tree)]))
    return node_id[top][run] + 1 + before - before[first][run]


def restored(f: Forest, tree_ids: pa.Array) -> pa.RecordBatch:
    """C11-C14 of many trees at once: ``restore`` of their ``parsed`` nodes."""
    n = parsed(f)
    # Fillers go, and what hangs on them moves to the nearest ancestor that stays
    inner, up = ~n["leaf"], n["up"]
    gone = inner & (n["label"] == 0) & (up >= 0)
    while True:
        at = np.flatnonzero(up >= 0)
        at = at[gone[up[at]]]
        if not len(at):
            break
        up[at] = up[up[at]]
    stay = np.flatnonzero(~gone)
    tree, node_id, leaf, label, lo, hi = (n[x][stay] for x in ("tree", "node_id", "leaf", "label", "lo", "hi"))
    parent = np.where(up[stay] >= 0, n["node_id"][up[stay]], -1)
    label = np.where(~leaf & (label == 0), _BAD_ROOT, label)
    # C14: a node for each labelled leaf
    need = leaf & (label != 0)
    fresh = _fresh_ids(tree, node_id, need.astype(np.int64))
    at = np.flatnonzero(need)
    tree, leaf, label, lo, hi = (np.concatenate([x, x[at]]) for x in (tree, leaf, label, lo, hi))
    parent = np.concatenate([np.where(need, fresh, parent), parent[at]])
    node_id = np.concatenate([node_id, fresh[at]])
    leaf[len(need):] = False
    order = np.lexsort((node_id, tree))
    tree, node_id, parent, leaf, label, lo, hi = (x[order] for x in (tree, node_id, parent, leaf, label, lo, hi))
    # Fused labels become chains
    more = np.where(leaf, 0, _N_PARTS[label] - 1)
    fresh = _fresh_ids(tree, node_id, more)
    own = np.repeat(np.arange(len(tree)), more + 1)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    part = _PARTS[(np.cumsum(_N_PARTS) - _N_PARTS)[label[own]] + nth]
    ids = np.where(nth == more[own], node_id[own], fresh[own] + nth)
    parent = np.where(nth == 0, parent[own], fresh[own] + nth - 1)
    leaf, lo, hi = leaf[own], lo[own], hi[own]
    text = pc.if_else(pa.array(leaf), pa.array(lo).cast(pa.string()), pa.array(PART_NAMES, pa.string()).take(pa.array(part)))
    return pa.RecordBatch.from_arrays(
        [tree_ids.take(pa.array(tree[own])), pa.array(ids), pa.array(parent, mask=parent < 0), text, pa.array(leaf),
         pa.array(lo.astype(np.int32)), pa.array((hi + 1).astype(np.int32))],
        ["tree_id", "node_id", "parent_id", "type", "is_terminal", "start", "end"])


def _fresh(need: Column) -> Column:
    """First fresh id of a row that needs ``need`` of them: ids go on after the largest, in order of node id."""
    tree = W.partitionBy("tree_id")
    before = F.sum(need).over(tree.orderBy("node_id").rowsBetween(W.unboundedPreceding, -1))
    return F.max("node_id").over(tree) + 1 + F.coalesce(before, F.lit(0))


def _node(node_id: Column, parent: Column, type_: Column, terminal: Column, unary: Column) -> Column:
    return F.struct(node_id.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), type_.alias("type"),
                    terminal.alias("is_terminal"), F.col("start").alias("start"), F.col("end").alias("end"),
                    unary.alias("unary"))


def add_unary(nodes: DataFrame) -> DataFrame:
    """C14: a leaf with a ``unary`` label gets a node of that type between itself and its parent."""
    labelled = F.col("is_terminal") & (F.col("unary") != EMPTY)
    need = F.when(F.coalesce(labelled, F.lit(False)), 1).otherwise(0)
    n = nodes.withColumn("_need", need).withColumn("_new", _fresh(F.col("_need")))
    none = F.lit(None).cast("string")
    more = F.when(F.col("_need") == 1, F.array(
        _node(F.col("_new"), F.col("parent_id"), F.col("unary"), F.lit(False), none),
        _node(F.col("node_id"), F.col("_new"), F.col("type"), F.lit(True), none)))
    same = F.array(_node(F.col("node_id"), F.col("parent_id"), F.col("type"), F.col("is_terminal"), none))
    return n.select("tree_id", F.explode(F.coalesce(more, same)).alias("n")).select("tree_id", "n.*")


def split_fused(nodes: DataFrame) -> DataFrame:
    """An inner node of a fused type becomes a chain, one node per part.

    The lowest node keeps the id, so the children stay where they are; those above take fresh ids.
    """
    n = (nodes.withColumn("_parts", F.when(F.col("is_terminal"), F.array("type")).otherwise(F.split("type", SEP, -1)))
         .withColumn("_more", F.size("_parts") - 1).withColumn("_new", _fresh(F.col("_more"))))
    n = n.select("*", F.posexplode("_parts").alias("_i", "_part"))
    last = F.col("_i") == F.col("_more")
    node_id = F.when(last, F.col("node_id")).otherwise(F.col("_new") + F.col("_i"))
    parent = F.when(F.col("_i") == 0, F.col("parent_id")).otherwise(F.col("_new") + F.col("_i") - 1)
    return n.select("tree_id", _node(node_id, parent, F.col("_part"), F.col("is_terminal"), F.col("unary")).alias("n")) \
        .select("tree_id", "n.*")


def restore(nodes: DataFrame) -> DataFrame:
    """C12, C14, C13 in the order that undoes ``binarise``: the tree that a prediction stands for."""
    return split_fused(add_unary(remove_fillers(nodes)))


def binarise(nodes: DataFrame) -> DataFrame:
    """The binary tree of a tree, as a node table.

    - A chain of single children becomes its top node, its types joined by ``<sep>``; if a terminal ends the
      chain, the node is that leaf and ``unary`` holds the fused type.
    - A node with ``k > 2`` children gets ``k - 2`` fillers: each holds the next child and the next filler, the
      last one the last two children.  Fillers take fresh ids in order of their parents' ids.
    """
    s = children_stats(nodes.select("tree_id", "node_id", "parent_id", "type", "is_terminal", "start", "end"))
    s = staged(s, "children")
    fused = F.col("parent_id").isNotNull() & (F.col("kp") == 1)
    links = jump(s.where(fused).select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("up"),
                                       F.lit(1).cast("long").alias("hops")))
    part = F.struct("hops", "type", "is_terminal", "k", "node")
    members = s.join(links.withColumnRenamed("node", "node_id"), ["tree_id", "node_id"]).withColumn("node", F.col("node_id"))
    chains = members.groupBy("tree_id", F.col("up").alias("node_id")).agg(F.sort_array(F.collect_list(part)).alias("_below"))
    low = F.element_at("_below", -1)
    # the last member holds the children: its number leads to the node that the chain has become
    tops = s.where(~fused).join(chains, ["tree_id", "node_id"], "left")
    to_leaf = F.coalesce(low["is_terminal"] & (low["k"] == 0), F.lit(False))
    below = F.transform("_below", lambda x: x["type"])
    label = F.when(F.col("_below").isNull(), F.col("type")).otherwise(F.concat_ws(SEP, F.col("type"), F.when(
        to_leaf, F.slice(below, F.lit(1), F.size(below) - 1)).otherwise(below)))
    renamed = chains.select("tree_id", low["node"].alias("parent_id"), F.col("node_id").alias("_top"))
    t = tops.select("tree_id", "node_id", "parent_id", "start", "end", "j", "kp", label.alias("type"),
                    (F.col("is_terminal") | to_leaf).alias("is_terminal"), to_leaf.alias("_leaf"))
    t = (t.join(renamed, ["tree_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("_top", "parent_id"))
         .withColumn("unary", F.when(F.col("_leaf"), F.col("type"))))
    tree, kids = W.partitionBy("tree_id"), W.partitionBy("tree_id", "parent_id")
    extra = F.when(F.col("parent_id").isNull(), 0).otherwise(F.greatest(F.col("kp") - 2, F.lit(0)))
    t = t.withColumn("_extra", extra).withColumn("_past", F.max("end").over(kids))
    so_far = F.sum(F.when(F.col("j") == 1, F.col("_extra")).otherwise(0)).over(
        tree.orderBy("parent_id", "j").rowsBetween(W.unboundedPreceding, W.currentRow))
    # every child knows where its parent's fillers begin, and the j-th one emits the filler it hangs on
    t = t.withColumn("_base", F.max("node_id").over(tree) + 1 + so_far - F.col("_extra"))
    filler = F.col("_base") + F.col("j") - 2
    parent = (F.when((F.col("_extra") == 0) | (F.col("j") == 1), F.col("parent_id"))
              .when(F.col("j") < F.col("kp"), filler).otherwise(filler - 1))
    none = F.lit(None).cast("string")
    child = _node(F.col("node_id"), parent, F.col("type"), F.col("is_terminal"), F.col("unary"))
    made = _node(filler, F.when(F.col("j") == 2, F.col("parent_id")).otherwise(filler - 1), F.lit(EMPTY), F.lit(False), none)
    made = made.withField("end", F.col("_past"))
    has_filler = (F.col("_extra") > 0) & (F.col("j") > 1) & (F.col("j") < F.col("kp"))
    return (t.select("tree_id", F.explode(F.when(has_filler, F.array(child, made)).otherwise(F.array(child))).alias("n"))
            .select("tree_id", "n.*"))
