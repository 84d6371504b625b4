"""Token vectors pooled in their rows equal those that joins make."""
from pyspark.sql import functions as F

from lignum.operators import probe as P
from lignum.operators import trees as T
from lignum.plans import doc_trees as D
from lignum.plans import probe as Pr
from lignum.plans import standins as St

TEXTS = [(1, "aa bbbbbbbb. c\n d!  e", "en"), (2, "one", "en"), (3, "x y z Ġ w.", "fr"), (4, "", "fr"), (5, None, "de"),
         (6, "r s.", "de"), (6, "t u v.", "de"), (None, "k l", "en")]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")


def test_words_and_their_neighbours(spark):
    w = T.encode_sentences(T.document_sentences(docs(spark).where("doc_id < 6"), with_words=True)).where("token IS NOT NULL")
    got = sorted((r.tree_id, r.tok, r.token, r.next) for r in w.collect())
    want = []
    for i, text, _ in TEXTS[:5]:
        words = (text or "").split()
        want += [(i, k, x, words[k + 1] if k + 1 < len(words) else None) for k, x in enumerate(words)]
    assert got == sorted(want, key=lambda r: r[:2])
    assert sorted((r.tree_id, r.tok, r.token, r.next) for r in Pr.word_pairs(docs(spark).where("doc_id < 6")).collect()) == got
    assert all((r.d is None) == (r.next is None) for r in w.collect())


def test_pooled_rows_equal_joined_rows(spark):
    nan = float("nan")
    vecs = [(0, [1.0, 2.0]), (1, None), (2, [None, 4.0]), (2, [3.0, 0.1]), (4, [nan, 1e9]), (None, [5.0, 5.0]), (5, [7.0, 1.0])]
    emb = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    toks = Pr.word_rows(docs(spark).where("doc_id < 6"))
    subs = P.map_pieces(St.split_pieces(toks, "bpe", 4), "bpe")
    joined = {(r.tree_id, r.tok): r.vec for r in P.scatter_mean(St.piece_vectors(subs, emb, 7), toks, 2).collect()}
    pool = P.pooled(P.piece_table(emb, 7, 2))
    rows = toks.select("tree_id", "tok", pool(Pr.ids_of(F.col("token"), F.col("tok"), 7)).alias("vec")).collect()
    assert repr(sorted(((r.tree_id, r.tok), r.vec) for r in rows)) == repr(sorted(joined.items()))
    assert P.piece_table(emb, 7, 2, most=13) is None


def test_documents_by_their_own_id(spark):
    own, rest = D.by_own_id(docs(spark))
    assert sorted(r.doc_id for r in own.collect()) == [1, 2, 3, 4, 5]
    assert sorted((r.doc_id or 0) for r in rest.collect()) == [0, 6, 6]
    assert D.by_own_id(own)[1] is None


def test_gap_vectors_are_neither_sorted_nor_joined(spark):
    import __spark_entry__ as E
    plan = E.queries()["project_gaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    plan = E.queries()["masked_argmax"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_fit_pools_the_pieces_of_its_samples(spark):
    import numpy as np
    from lignum.operators import fit as Fi
    table = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.0, 2.0]), (2, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    held = P.piece_table(table, 3, 2)
    rng = np.random.RandomState(1)
    rows = []
    for i in range(9):
        ids = [[int(x) for x in rng.randint(0, 3, rng.randint(0, 3))] for _ in range(3)]
        x = held.value.mean(np.array(sum(ids, []), np.int64), np.array([len(y) for y in ids]))[0].tolist()
        rows.append((i, "en", "valid" if i % 3 == 0 else "train", x, ids, [1.0, 2.0], [0, 1], [0, 1, 0]))
    df = spark.createDataFrame(rows, "tree_id long, lang string, split string, x array<array<double>>, ids array<array<int>>, "
                                     "d array<double>, c array<int>, u array<int>")
    lean = df.withColumn("x", F.when(F.col("tree_id") == 4, F.col("x")))
    cands = ({"en": [0, 1]}, {"en": [0, 1]})
    for fit, more in ((Fi.fit_probe, {}), (Fi.fit_minibatch, {"batch_size": 4, "tasks": 2})):
        want = fit(df, 2, 2, 2, 2, *cands, epochs=2, **more)[1]
        assert np.allclose(want, fit(lean, 2, 2, 2, 2, *cands, epochs=2, pieces=held, **more)[1])


def test_training_samples_hold_no_vectors(spark):
    s, *_, held = Pr.training_samples(spark, "/root/testdata/sf0.001")
    got = s.agg(F.count("x").alias("x"), F.count("ids").alias("ids")).first()
    assert (got.x, held is not None) == (0, True) and got.ids > 100


def test_blocks_of_labels_shuffle_no_row(spark):
    """blocks of labels pass the rows where they lie; only rows that may share their keys are merged."""
    rows = [(1, "a", [1.0, 0.0], 0), (2, "a", [0.0, 1.0], 3), (3, "b", [1.0, 1.0], 7), (4, None, [1.0, 0.0], 1), (5, "z", [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>, t int").repartition(2)
    labels = spark.createDataFrame([("a", i, [0.1 * i, 1.0 - i]) for i in range(5)] + [("b", i, [float(i), 0.5]) for i in range(6, 9)] +
                                   [(None, 1, [9.0, 9.0])], "group string, id int, vec array<double>")
    run = lambda lab, **how: P.argmax_scores(df, "v", lab, ["k"], "g", out="p", true_col="t", **how)
    see = lambda r: sorted((x.k, x.g or "", x.v, x.p, None if x.p_ce is None else round(x.p_ce, 9)) for x in r.collect())
    got = run(labels, inline=0, block=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "FlatMapCoGroups" not in plan and plan.count("Join") == 1
    assert see(got) == see(run(labels)) == see(run(labels, inline=0, block=2, repeated=True)) and got.columns == run(labels).columns
    none = run(labels.where("id < 0"), inline=-1)
    assert [(k, p, ce) for k, _g, _v, p, ce in see(none)] == [(k, None, None) for k in range(1, 6)]


def test_rows_that_share_their_key_share_the_best_label(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (1, "a", [-3.0]), (2, "a", [1.0]), (None, "a", [1.0])], "k long, g string, v array<double>")
    labels = spark.createDataFrame([("a", i, [float(i)]) for i in (-2, 1, 5)], "group string, id int, vec array<double>")
    run = lambda **how: sorted(((r.k or 0), r.p or 0) for r in P.argmax_scores(df, "v", labels, ["k"], "g", out="p", inline=0, block=1, **how).collect())
    assert run() == [(0, 5), (1, -2), (1, 5), (2, 5)]
    assert run(repeated=True) == [(0, 0), (1, -2), (1, -2), (2, 5)]
