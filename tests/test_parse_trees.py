"""Trees out of sequences, binary trees, contraction and path doubling against plain recursion."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tree_oracle as O
from lignum.operators import parse_trees as P
from lignum.operators import spans as S
from lignum.operators import trees as T
from test_trees import golden_nodes

SCHEMA = "tree_id long, node_id long, parent_id long, type string, is_terminal boolean, start long, end long"


def random_tree(rnd, tree, n):
    """Rows of a tree of ``n`` nodes with shuffled ids; inner nodes have one to many children."""
    ids = rnd.sample(range(5 * n), n)
    parent = [None] + [rnd.choice(range(max(0, i - 4), i)) for i in range(1, n)]
    kids = {i: [c for c in range(n) if parent[c] == i] for i in range(n)}
    start, order = {}, []

    def walk(i):
        start[i] = len(order)
        order.append(i)
        for c in kids[i]:
            walk(c)
    walk(0)
    return [(tree, ids[i], ids[parent[i]] if i else None, f"t{i % 5}", not kids[i], start[i], start[i] + 1) for i in range(n)]


@pytest.fixture(scope="module")
def forest():
    rnd = random.Random(3)
    rows = [r for t in range(40) for r in random_tree(rnd, t, rnd.randint(1, 40))]
    rows += [(90, 0, None, "only", True, 0, 1)]
    rows += [(91, i, i - 1 if i else None, f"c{i}", i == 9, i, i + 1) for i in range(10)]             # one chain
    rows += [(92, i, 0 if i else None, "flat", i > 0, i, i + 1) for i in range(30)]                    # one wide node
    return rows


def as_dict(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[0], {})[r[1]] = (r[2], r[3], r[5])
    return trees


def shape(tree, terminal, node=None):
    """Nested (type, children) of a node table."""
    kids = sorted((s, n) for n, (p, _t, s) in tree.items() if p == node) if node is not None else \
        [(s, n) for n, (p, _t, s) in tree.items() if p is None]
    if node is None:
        assert len(kids) == 1
        return shape(tree, terminal, kids[0][1])
    name = "leaf" if node in terminal else tree[node][1]
    return name, [shape(tree, terminal, n) for _s, n in kids]


def test_cartesian_tree_is_the_recursive_one():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 3, 17, 60]:
        for _ in range(8):
            d = rng.integers(0, 4, n).astype(float)
            nodes = []

            def build(lo, hi, parent, d=d, nodes=nodes):
                me = len(nodes)
                if lo == hi:
                    nodes.append((-1, lo, hi, parent))
                    return
                i = lo + int(np.argmax(d[lo:hi]))
                nodes.append((i, lo, hi, parent))
                build(lo, i, me)
                build(i + 1, hi, me)
            build(0, n, -1)
            assert [tuple(int(v) for v in x) for x in zip(*P.cartesian_tree(d), strict=True)] == nodes


def test_binary_tree_is_the_recursive_one(spark, forest):
    got = P.binarise(spark.createDataFrame(forest, SCHEMA).repartition(3)).collect()
    assert len({(r.tree_id, r.node_id) for r in got}) == len(got)
    trees = {}
    for r in got:
        trees.setdefault(r.tree_id, {})[r.node_id] = r
    for tid, tree in as_dict(forest).items():
        nodes = trees[tid]

        def nested(node_id, nodes=nodes):
            r = nodes[node_id]
            kids = sorted((x.start, x.node_id) for x in nodes.values() if x.parent_id == node_id)
            assert len(kids) in (0, 2)
            if not kids:
                assert r.is_terminal
                return ("leaf", r.unary)
            return ("bin", r.type, nested(kids[0][1]), nested(kids[1][1]))

        def plain(b):
            return ("leaf", b[1]) if b[0] == "leaf" else ("bin", b[1], plain(b[2]), plain(b[3]))
        root, = [r.node_id for r in nodes.values() if r.parent_id is None]
        assert nested(root) == plain(O.binarize(tree))


def test_encoding_the_binary_tree_equals_encoding_the_tree(spark, forest):
    nodes = spark.createDataFrame(forest, SCHEMA)
    binary = P.binarise(nodes)
    g1, l1 = T.encode(nodes)
    g2, l2 = T.encode(binary)
    assert sorted(map(tuple, g1.collect())) == sorted(map(tuple, g2.collect()))
    unary = l2.join(binary.select("tree_id", "node_id", "unary"), ["tree_id", "node_id"])
    assert (sorted((r.tree_id, r.tok, r.u) for r in l1.collect())
            == sorted((r.tree_id, r.tok, r.unary or "<empty>") for r in unary.collect()))


def test_round_trip_restores_the_tree(spark, forest):
    golden = [tuple(r) for r in golden_nodes(spark).withColumn("tree_id", F.lit(500)).collect()]
    rows = [r for r in forest if r[0] != 90] + golden   # a root that is a token has no node above it
    nodes = spark.createDataFrame(rows, SCHEMA)
    parsed = P.parse_nodes(T.features(*T.encode(nodes)))
    assert {r.tree_id: r.n for r in parsed.groupBy("tree_id").agg(F.count("*").alias("n")).collect()} == {
        r.tree_id: r.n for r in P.binarise(nodes).groupBy("tree_id").agg(F.count("*").alias("n")).collect()}
    back = P.restore(parsed).collect()
    assert len({(r.tree_id, r.node_id) for r in back}) == len(back)
    trees, ends = {}, {}
    for r in back:
        trees.setdefault(r.tree_id, {})[r.node_id] = (r.parent_id, r.type, r.start)
        if r.is_terminal:
            ends.setdefault(r.tree_id, set()).add(r.node_id)
    leaves = {}
    for r in rows:
        if r[4]:
            leaves.setdefault(r[0], set()).add(r[1])
    for tid, tree in as_dict(rows).items():
        assert shape_by_order(trees[tid], ends[tid]) == shape_by_order(tree, leaves[tid])


def shape_by_order(tree, terminal):
    """Nested types; a node's children in order of the first token below them."""
    kids = {}
    for n, (p, _t, s) in tree.items():
        kids.setdefault(p, []).append((s, n))

    def nested(n):
        return ("leaf" if n in terminal else tree[n][1], [nested(c) for _s, c in sorted(kids.get(n, []))])
    (_s, root), = kids[None]
    return nested(root)


def test_bad_root_and_fillers(spark):
    feat = spark.createDataFrame([(1, [3.0, 1.0, 2.0], ["<empty>", "a<sep>b", "<empty>"], ["x", "<empty>", "<empty>", "y<sep>z"]),
                                  (2, [], [], ["w"])], "tree_id long, d array<double>, c array<string>, u array<string>")
    spans = sorted((r.tree_id, r.label, r.lo, r.hi) for r in S.decode(feat).collect())
    full = P.restore(P.parse_nodes(feat, F.array(*[F.lit(x) for x in "pqrs"])))
    inner = full.where("NOT is_terminal").selectExpr("tree_id", "type AS label", "start AS lo", "end - 1 AS hi")
    assert sorted(map(tuple, inner.collect())) == spans
    assert sorted(r.type for r in full.where("is_terminal and tree_id = 1").collect()) == ["p", "q", "r", "s"]
    tops = full.where("parent_id IS NULL").orderBy("tree_id").collect()
    assert [r.type for r in tops] == ["bad_root", "w"]


def test_contraction_jumps_over_long_runs_and_sees_cycles(spark):
    rows = [(1, i, i - 1 if i else None, "keep" if i in (0, 200) else "drop", i == 200, i, i + 1) for i in range(201)]
    kept = P.contract(spark.createDataFrame(rows, SCHEMA), F.col("type") == "drop").collect()
    assert sorted((r.node_id, r.parent_id) for r in kept if r.node_id) == [(200, 0)] and len(kept) == 2
    loop = spark.createDataFrame([(1, 1, 2, "drop", False, 0, 1), (1, 2, 1, "drop", False, 0, 1)], SCHEMA)
    with pytest.raises(ValueError):
        P.contract(loop, F.col("type") == "drop")


def test_path_doubling_in_a_deep_tree(spark):
    depth = 2000   # a spine of 2000 levels, a leaf beside each
    rows = [(1, i, i - 1 if i else None, "s", False, i, i + 1) for i in range(depth)]
    rows += [(1, depth + i, i, "w", True, 10 * depth - i, 10 * depth + 1) for i in range(depth)]
    rows += [(2, 1, 1, "loop", False, 0, 1), (2, 2, 7, "orphan", False, 0, 1), (2, 3, None, "root", False, 0, 1)]
    out = T.root_paths(spark.createDataFrame(rows, SCHEMA))
    got = out.selectExpr("tree_id", "node_id", "depth", "C", "size(path) AS n", "path[0].node AS top", "path[depth].node AS own").collect()
    at = {(r.tree_id, r.node_id): r for r in got}
    assert set(at) == {(1, i) for i in range(2 * depth)} | {(2, 3)}
    assert all(at[1, i].depth == i and at[1, depth + i].depth == i + 1 for i in range(depth))
    assert all(r.n == r.depth + 1 and r.own == n for (t, n), r in at.items())
    assert at[1, depth - 1].C == depth - 1 and at[1, depth - 1].top == 0
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_links_are_followed_in_their_tree(spark):
    """F8: rounds of pointer jumping are neither joined nor written; links that come twice multiply as in a join."""
    rows = [(1, 5, 4, 1), (1, 4, 3, 1), (1, 3, 0, 1), (2, 5, 4, 1), (2, 4, 9, 1), (2, 4, 8, 1), (None, 5, 4, 1), (None, 4, 3, 1)]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    out = P.jump(spark.createDataFrame(rows, "tree_id long, node long, up long, hops long")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(
        [(1, 5, 0, 3), (1, 4, 0, 2), (1, 3, 0, 1), (2, 5, 9, 2), (2, 5, 8, 2), (2, 4, 9, 1), (2, 4, 8, 1),
         (None, 5, 4, 1), (None, 4, 3, 1)], key=repr)
    assert len([x for x in set(os.listdir(folder)) - before if "links" in x]) == 1
