"""Encoder against the golden tree of the fixtures and a plain recursive oracle."""

from pyspark.sql import functions as F

import tree_oracle as O
from lignum.operators import spans as S
from lignum.operators import trees as T

# (node_id, parent_id, type, is_terminal) in preorder; start = preorder position
GOLDEN = [
    (0, None, "module", False), (1, 0, "function_definition", False), (2, 1, "def", True),
    (3, 1, "identifier", True), (4, 1, "parameters", False), (5, 4, "(", True), (6, 4, "identifier", True),
    (7, 4, ",", True), (8, 4, "identifier", True), (9, 4, ")", True), (10, 1, ":", True),
    (11, 1, "block", False), (12, 11, "if_statement", False), (13, 12, "if", True),
    (14, 12, "comparison_operator", False), (15, 14, "identifier", True), (16, 14, ">", True),
    (17, 14, "identifier", True), (18, 12, ":", True), (19, 12, "block", False),
    (20, 19, "return_statement", False), (21, 20, "return", True), (22, 11, "return_statement", False),
    (23, 22, "return", True), (24, 22, "identifier", True),
]
GOLDEN_D = [9, 8, 4, 3, 2, 1, 7, 6, 4, 2, 1, 3, 1, 5, 1]
E = "<empty>"
GOLDEN_C = ["module<sep>function_definition", E, "parameters", E, E, E, E, E, "if_statement",
            "comparison_operator", E, E, E, "block", "return_statement"]
GOLDEN_SPANS = sorted([("module", 0, 15), ("function_definition", 0, 15), ("parameters", 2, 6), ("block", 8, 15),
                       ("if_statement", 8, 13), ("comparison_operator", 9, 11), ("block", 13, 13),
                       ("return_statement", 13, 13), ("return_statement", 14, 15)])


def golden_nodes(spark):
    rows = [(1, n, p, t, term, n * 10, n * 10 + 1) for n, p, t, term in GOLDEN]
    return spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, type string, "
                                       "is_terminal boolean, start long, end long")


def test_golden_encoding(spark):
    nodes = golden_nodes(spark)
    gaps, leaves = T.encode(nodes)
    f = T.features(gaps, leaves).collect()[0]
    assert list(f.d) == GOLDEN_D
    assert list(f.c) == GOLDEN_C
    u = list(f.u)
    assert u[13] == "block<sep>return_statement"
    assert all(x == E for i, x in enumerate(u) if i != 13)
    assert f.num_tokens == 16


def test_golden_decode_and_scores(spark):
    nodes = golden_nodes(spark)
    gaps, leaves = T.encode(nodes)
    feat = T.features(gaps, leaves)
    pred = S.decode(feat)
    got = sorted((r.label, r.lo, r.hi) for r in pred.collect())
    assert got == GOLDEN_SPANS
    true = S.tree_spans(T.root_paths(nodes))
    assert sorted((r.label, r.lo, r.hi) for r in true.collect()) == GOLDEN_SPANS
    sc = S.span_scores(true, pred).collect()[0]
    assert (sc.p, sc.r, sc.f1) == (1.0, 1.0, 1.0)
    renamed = pred.withColumn("label", F.when(F.col("label") == "comparison_operator", "binary_operator")
                              .otherwise(F.col("label")))
    sc = S.span_scores(true, renamed).collect()[0]
    assert abs(sc.f1 - 8 / 9) < 1e-9 and abs(sc.p - 8 / 9) < 1e-9


def test_documents_match_recursive_oracle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    nodes = T.nest_documents(docs)
    paths = T.root_paths(nodes, max_depth=3)
    gaps, leaves = T.encode(nodes, paths)
    feat = {r.tree_id: r for r in T.features(gaps, leaves).collect()}
    nd = nodes.select("tree_id", "node_id", "parent_id", "type", "start").collect()
    trees = {}
    for r in nd:
        trees.setdefault(r.tree_id, {})[r.node_id] = (r.parent_id, r.type, r.start)
    assert trees and set(trees) == set(feat)
    for tid, tree in trees.items():
        d, c, u = O.gap_sequences(O.binarize(tree))
        f = feat[tid]
        assert list(f.d) == d and list(f.c) == c and list(f.u) == u
        assert O.decode_spans(d, c, u) == O.tree_spans(tree)


def test_generic_loop_equals_preorder_route(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30")
    nodes = T.nest_documents(docs)
    g1, _ = T.encode(nodes, T.root_paths(nodes, max_depth=3))
    g2, _ = T.encode(nodes.select(*T.NODE_COLS))  # no depth columns: iterative closure
    a = sorted(tuple(r) for r in g1.collect())
    b = sorted(tuple(r) for r in g2.collect())
    assert a == b and len(a) > 0


def test_byte_offsets_non_ascii(spark):
    df = spark.createDataFrame([(7, "Él dijo ñu. Sí!\nçà va", "fr")], "doc_id long, text string, lang string")
    nodes = T.nest_documents(df)
    toks = T.tokens(nodes, df).orderBy("tok").collect()
    assert [t.token for t in toks] == ["Él", "dijo", "ñu.", "Sí!", "çà", "va"]
    types = sorted(r.type for r in nodes.where("depth = 2").collect())
    assert types == ["exclamation", "fragment", "statement"]


def test_single_token_tree(spark):
    df = spark.createDataFrame([(1, "word", "en")], "doc_id long, text string, lang string")
    nodes = T.nest_documents(df)
    gaps, leaves = T.encode(nodes, T.root_paths(nodes, max_depth=3))
    assert gaps.count() == 0
    u = leaves.collect()[0].u
    assert u == "document<sep>line<sep>fragment"
    spans = sorted((r.label, r.lo, r.hi) for r in S.decode(T.features(gaps, leaves)).collect())
    assert spans == [("document", 0, 0), ("fragment", 0, 0), ("line", 0, 0)]


def test_stream_paths_equal_window_paths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    nodes, paths = T.nest_documents(docs, with_paths=True)
    g1, l1 = T.encode(nodes, paths)
    g2, l2 = T.encode(nodes, T.root_paths(nodes.select(*T.NODE_COLS, "depth", "j", "kp", "k"), max_depth=3))
    assert sorted(tuple(r) for r in g1.collect()) == sorted(tuple(r) for r in g2.collect())
    a = sorted((r.tree_id, r.tok, r.u) for r in l1.collect())
    b = sorted((r.tree_id, r.tok, r.u) for r in l2.collect())
    assert a == b and len(a) > 0


ODD = [(1, ""), (2, "   \n "), (3, None), (4, "a"), (5, "  one.  two \n\n three! four"), (6, "x.\r\ny z.\r"),
       (7, "word"), (8, 'He said "no". Yes?\n\nGo!'), (9, "é. ñ ü"), (10, "\n\n. . ."), (11, "w " * 3000 + "end."),
       (12, "s. " * 2000), (13, "l\n" * 2000)]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ODD], "doc_id long, text string, lang string")


def test_sentence_encoder_equals_node_encoder(spark):
    docs = odd_docs(spark)
    nodes = T.nest_documents(docs)
    gaps, leaves = T.encode(nodes.select(*T.NODE_COLS))  # iterative closure over parent pointers
    sents = T.document_sentences(docs)
    words = T.encode_sentences(sents)
    want = sorted((r.tree_id, r.gap, r.d, r.c) for r in gaps.collect())
    assert want == sorted((r.tree_id, r.tok, r.d, r.c) for r in words.where("d is not null").collect())
    assert sorted((r.tree_id, r.tok, r.u) for r in leaves.collect()) == sorted((r.tree_id, r.tok, r.u) for r in words.collect())
    spans = S.tree_spans(T.root_paths(nodes, max_depth=3))
    key = lambda df: sorted((r.tree_id, r.label, r.lo, r.hi) for r in df.collect())
    assert key(spans) == key(T.sentence_spans(sents))
    assert key(spans) == key(S.decode(T.word_features(words)))


def test_documents_without_words_keep_their_root(spark):
    docs = odd_docs(spark)
    nodes, paths = T.nest_documents(docs, with_paths=True)
    for df in (nodes, paths):
        roots = {r.tree_id: r for r in df.where("parent_id is null").collect()}
        assert sorted(roots) == [i for i, _ in ODD]
        assert [(roots[i].type, roots[i].is_terminal, roots[i].k) for i in (1, 2, 3)] == [("document", False, 0)] * 3
    assert {r.tree_id for r in T.tree_check(nodes.select(*T.NODE_COLS)).where("is_tree").collect()} == {i for i, _ in ODD}


def test_deep_tree_through_checkpoints(spark):
    rows = [(1, n, n - 1 if n else None, f"t{n}", n == 20, n, n + 1) for n in range(21)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, type string, "
                                        "is_terminal boolean, start long, end long")
    paths = {r.node_id: r for r in T.root_paths(nodes).collect()}
    assert len(paths) == 21 and paths[20].depth == 20 and [e.node for e in paths[20].path] == list(range(21))


def test_one_decoder_in_the_plan(spark):
    from lignum.plans import doc_trees as D
    e = D.doc_encoding(spark, "/root/testdata/sf0.001")
    sc = S.span_scores(e.spans, S.decode(D.predicted(e.words)))
    plan = sc._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_bounds_udf(") == 1


def test_recall_lists(spark):
    rows = spark.createDataFrame([(1, "a", 2, 1, 0.5, "en"), (2, "a", 1, 1, 1.0, "en"), (3, "a", 1, 0, 0.0, "fr")],
                                 "tree_id long, label string, n_true long, hit long, recall double, lang string")
    got = {r.label_key: r for r in S.recall_lists(rows).collect()}
    assert sorted(got) == ["a--en", "a--fr"] and got["a--en"].recall == 0.75
    assert [(x.tree_id, x.recall) for x in got["a--en"].samples] == [(1, 0.5), (2, 1.0)]


def test_roots_ids_and_level_sizes(spark):
    nodes = golden_nodes(spark)
    assert [r.node_id for r in T.roots(nodes).collect()] == [0]
    shifted = nodes.withColumn("node_id", F.col("node_id") * 3 + 5)
    assert sorted(r.node_id for r in T.next_ids(shifted).collect()) == list(range(len(GOLDEN)))
    depth = {0: 0}
    for n, p, _t, _term in GOLDEN[1:]:
        depth[n] = depth[p] + 1
    want = {d: list(depth.values()).count(d) for d in depth.values()}
    assert {r.depth: r.n_nodes for r in T.level_sizes(T.root_paths(nodes)).collect()} == want
