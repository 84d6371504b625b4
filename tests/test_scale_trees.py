"""Trees and vocabularies without sorts, paths or digests over whole words."""
import os
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lignum.operators import trees as T
from lignum.operators import vocab as Vo

DATA = "/root/testdata/sf0.001"


def test_doc_tree_nodes_returns_every_node(spark):
    import __spark_entry__ as E
    got = sorted(map(tuple, E.queries()["doc_tree_nodes"](spark, DATA).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(E.oracle_sql()["doc_tree_nodes"]).fetchall(), key=repr)
    assert got == want and len(got) > 10 * len({r[0] for r in got})


def test_vocabulary_counts_samples_before_it_sorts(spark):
    rows = [("c", "en", "a", 1, 5, 3), ("c", "en", "a", 0, 9, 7), ("c", "en", "a", 0, 9, 2), ("c", "en", "b", 0, 9, 1),
            ("c", "en", "b", 0, 9, 1), ("c", None, "a", 0, None, 0)]
    occ = spark.createDataFrame(rows, "kind string, lang string, label string, split_ord int, sample_ord long, pos int")
    voc = Vo.local_vocab(occ)
    assert sorted((r.lang or "", r.label, r.local_id, r["count"]) for r in voc.collect()) == [
        ("", "a", 0, 1), ("en", "a", 1, 3), ("en", "b", 0, 2)]
    assert "partial_min(pos" in voc._jdf.queryExecution().executedPlan().toString()


def test_reached_nodes_against_walks():
    rng = random.Random(3)
    none = T.NO_PARENT
    for _ in range(200):
        n = rng.randrange(1, 12)
        ids = list(range(n)) if rng.random() < 0.7 else [rng.randrange(n) for _ in range(n)]
        parents = [none if rng.random() < 0.3 else rng.choice([x for x in range(-1, n + 2) if x < i] or [none])
                   for i in ids]  # parents have smaller ids, so no way is endless
        ways = lambda i: 1 if parents[i] == none else sum(ways(j) for j in range(n) if ids[j] == parents[i])
        assert T.reached_nodes(np.array(ids), np.array(parents)) == sum(ways(i) for i in range(n))
    assert T.reached_nodes(np.array([0, 1, 2]), np.array([none, 2, 1])) == 1


def test_tree_check_makes_no_paths(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 7), (2, 1, 1), (3, 0, None), (3, 5, 0), (3, 9, 5)]
    nodes = spark.createDataFrame([(t, i, p, "x", False, i, i + 1) for t, i, p in rows],
                                  "tree_id long, node_id long, parent_id long, type string, is_terminal boolean, start long, end long")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    got = {r.tree_id: (r.n_nodes, r.n_roots, r.n_reached, r.is_tree) for r in T.tree_check(nodes).collect()}
    assert got == {1: (3, 1, 2, False), 2: (1, 0, 0, False), 3: (3, 1, 3, True)}
    assert not [x for x in set(os.listdir(folder)) - before if "paths" in x]


def test_partitions_grow_with_the_text(spark):
    docs = spark.createDataFrame([(i, "ab cd. " * 40, "en") for i in range(50)], "doc_id long, text string, lang string")
    sized = T.by_tree(docs, "doc_id", F.octet_length("text"), 1000)
    assert sized.rdd.getNumPartitions() == 14
    assert T.by_tree(docs, "doc_id").rdd.getNumPartitions() == 8


def test_nodes_of_own_ids_need_no_window(spark):
    """a text whose id is its own is cut in its row, as the windows over its words would."""
    rng = random.Random(7)
    parts = ["a", "é", "b.", " ", "  ", "\n", "\n\n", "c!", "?", '"', "\t", "\r", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), "en" if i % 3 else None) for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \n ", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    nodes = T.nest_documents(docs)
    assert "Window" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, nodes.collect()), key=repr) == sorted(
        map(tuple, T._nest_windows(docs, "doc_id", "text", ("lang",)).collect()), key=repr)
    assert T.nest_documents(docs.limit(0)).collect() == []


def test_documents_that_share_an_id_are_one_tree(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "c. d", "x"), (None, "e", "x")],
                                 "doc_id long, text string, lang string")
    count = {r.tree_id: r["count"] for r in T.nest_documents(docs).groupBy("tree_id").count().collect()}
    assert count == {r.tree_id: r["count"] for r in T._nest_windows(docs, "doc_id", "text", ("lang",)).groupBy("tree_id").count().collect()}


def test_gaps_are_rendered_in_the_row_of_their_tree(spark, tmp_path):
    """neither words nor gaps are rows, and what is rendered equals the form with a word in a row."""
    from lignum.plans import doc_trees as D
    rng = random.Random(11)
    parts = ["a", "é", "b.", " ", "  ", "\n", "\n\n", "c!", "?", '"', "\t", "\r", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40))), "en") for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \n ", "de"), (1003, "one", "de"), (1004, "w " * 3000 + ". v\nu", "de")]
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/once/documents.parquet")
    once = D.gap_render(spark, f"{tmp_path}/once")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate") == 2   # lines and sentences, no words
    docs = D.documents(spark, f"{tmp_path}/once")
    by_rows = T.render_gaps(T.tokens(T.nest_documents(docs), docs), D.doc_encoding(spark, None, docs).gaps)
    want = sorted(map(tuple, by_rows.selectExpr("tree_id", "octet_length(rendered)", "md5(rendered)").collect()))
    assert sorted(map(tuple, once.collect())) == want and len(want) > 250
    plain = [(i, t.replace("é", "e"), lang) for i, t, lang in rows[:4]]
    twice = plain + rows[4:20] + plain + [(None, "k l", "en")]
    spark.createDataFrame(twice, schema).write.parquet(f"{tmp_path}/twice/documents.parquet")
    got = {r.tree_id: r.digest for r in D.gap_render(spark, f"{tmp_path}/twice").collect()}
    assert {t: d for t, d in got.items() if t > 3} == {t: d for t, _n, d in want if 3 < t < 20} and None not in got
