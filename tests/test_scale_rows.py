"""Documents in rows: words, pieces, vectors, labels and spans equal those that rows of words make."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lignum.functions.constants import EMPTY
from lignum.operators import fit as Fi
from lignum.operators import losses as L
from lignum.operators import probe as P
from lignum.operators import spans as S
from lignum.operators import trees as T
from lignum.plans import doc_trees as D
from lignum.plans import probe as Pr
from lignum.plans import standins as St

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
PARTS = ["a", "é", "漢字x", "😀", "Ġ", "b.", " ", "  ", "\n", "\n\n", "c!", "?", '"', "\t", "\r", "word", "жжжжж"]


def texts(seed, n=300, longest=30):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(longest))), ("en", "fr", "xx")[i % 3]) for i in range(n)]
    return rows + [(n, None, "en"), (n + 1, "", "fr"), (n + 2, " \n ", "de"), (n + 3, "one", "de"), (n + 4, "w " * 3000 + ". v\nu", "de")]


def written(spark, folder, rows, vectors=None):
    """A folder of tables with these documents."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    rng = np.random.RandomState(0)
    vectors = vectors or [(i, i % 3, [float(x) for x in rng.randn(4).round(3)]) for i in range(11)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def by_words(monkeypatch, module=D):
    """Sends all documents through the rows of words that repeated ids take."""
    monkeypatch.setattr(module, "by_own_id", lambda docs, id_col="doc_id": (docs.where("false"), docs))


def test_encoding_in_rows_equals_rows_of_words(spark):
    rows = texts(3)
    enc = T.encode_sentences(T.document_sentences(spark.createDataFrame(rows, SCHEMA))).collect()
    want = {(r.tree_id, r.tok): (r.d, r.c, r.u) for r in enc}
    got = {}
    for lo, _hi, buf, off in T.text_slices(pa.array([r[1] for r in rows]), 2000):
        w = T.Levels(buf, off)
        for row, tok, d, c, u in zip(w.row, w.tok, *T.encoded(w), strict=True):
            got[rows[lo + row][0], tok] = (None if d < 0 else d, None if c < 0 else T.LABELS[c], T.LABELS[u])
        got |= {(rows[lo + row][0], 0): (None, None, EMPTY) for row in w.bare}
    assert got == want


def test_piece_ids_equal_the_md5_of_each_piece():
    rows = [r[1] or "" for r in texts(5, 600)]
    St.PieceIds.SLOTS, old = 4, St.PieceIds.SLOTS   # many pieces for each entry
    try:
        ids_of = St.PieceIds(97)
        for lo, hi, buf, off in T.text_slices(pa.array(rows), 3000):
            w = T.Levels(buf, off)
            ids, n = ids_of.of(buf, w.b, w.e, w.tok)
            got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if w.n else []
            want = []
            for text in rows[lo:hi]:
                for i, word in enumerate(x for x in re.split("[ \n]+", text) if x):
                    pieces = re.findall("(?s).{1,4}", " " * (i > 0) + word)
                    want.append([int(hashlib.md5(p.encode()).hexdigest()[:15], 16) % 97 for p in pieces if p not in (" ", "Ġ")])
            assert got == want
    finally:
        St.PieceIds.SLOTS = old


def test_best_labels_in_rows_equal_rows_of_words(spark, tmp_path, monkeypatch):
    """No word, vector or span is a row, and repeated ids still count."""
    import __spark_entry__ as E
    sf = written(spark, tmp_path, texts(7, 50) + [(1, "again. b", "en"), (None, "k l", "en")])
    run = lambda name: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in E.queries()[name](spark, sf).collect())
    got, f1 = run("masked_argmax"), run("probe_f1_by_lang")
    by_words(monkeypatch)
    assert got == run("masked_argmax") and sum(r[3] for r in got) > 1000
    assert f1 == run("probe_f1_by_lang") and len(f1) == 4


def test_blocks_of_labels_pass_documents_where_they_lie(spark, tmp_path):
    """a chunk of documents meets several blocks of labels, and its words are cut and pooled once."""
    sf = written(spark, tmp_path, texts(17, 60))
    run = lambda **how: sorted(map(tuple, Pr._argmax_counts(spark, sf, **how).collect()))
    assert run() == run(block=2, inline=0)
    plan = Pr._argmax_counts(spark, sf, block=2, inline=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["masked_argmax", "project_gaps", "scatter_mean", "probe_losses", "doc_tree_nodes", "collapse_literals",
                                  "restored_tree_nodes", "vocab_local"])
def test_no_word_is_a_row(spark, name):
    """nothing is exploded, and no text, word, node or gap is sorted or joined."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert name == "vocab_local" or "Window" not in plan
    assert plan.count("Join") == (name == "masked_argmax")  # of the names of the labels


def test_spans_in_rows_make_no_rows_of_spans(spark):
    """Scores come from numbers that a slice of trees counts."""
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    sc, recalls = Pr.probe_scores(spark, DATA)
    assert "Join" not in sc._jdf.queryExecution().optimizedPlan().toString()
    assert recalls._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1   # the labels of a tree
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_trees_in_rows_equal_their_windows_and_joins(spark, tmp_path, monkeypatch):
    """trees that are cut, numbered, collapsed and restored by arrays."""
    rows = texts(11, 120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda f: sorted(map(tuple, f(spark, str(tmp_path)).collect()), key=repr)
    queries = D.doc_tree_nodes, D.collapse_literals, D.restored_tree_nodes
    got = [run(f) for f in queries]
    by_words(monkeypatch)
    by_words(monkeypatch, T)
    assert got == [run(f) for f in queries]


def test_dense_ids_follow_the_start():
    row, node, parent, start = np.array([0, 0, 0, 1, 1]), np.array([9, 4, 7, 3, 1]), np.array([-1, 9, 9, 1, -1]), np.array([0, 5, 2, 4, 0])
    new, up = T.dense_ids(row, start, node, parent)
    assert new.tolist() == [0, 2, 1, 1, 0] and up.tolist() == [-1, 0, 0, 0, -1]


def forest(seed, ties=1):
    rng = np.random.default_rng(seed)
    lens = np.r_[rng.integers(0, 30, 80), 200, 1, 0, 2]
    return rng.integers(0, 6, lens.sum()).astype(float), np.round(rng.normal(size=lens.sum()) * 2, ties), lens


def test_pairs_and_bounds_of_many_trees_equal_those_of_each():
    """Trees are counted and decoded many at a time."""
    t, p, lens = forest(0)
    p[3] = np.nan
    n_pairs, active, hinge, hinge_exp = L.pairs_of_trees(t, p, lens)
    lo, hi = S.bounds_of_trees(t, lens)
    for r, part in enumerate(np.split(np.arange(len(t)), np.cumsum(lens)[:-1])):
        n, act, h, e = L.pair_parts(t[part], p[part])
        assert n == n_pairs[r] and (act == active[part]).all()
        assert np.isclose(h, hinge[r], equal_nan=True) and np.isclose(e, hinge_exp[r], equal_nan=True)
        one = S.span_bounds(t[part])
        assert (one[0] == lo[part]).all() and (one[1] == hi[part]).all()


def test_vectors_of_many_pieces_are_mapped(spark, tmp_path, monkeypatch):
    """beyond ``TABLE`` numbers the vectors are in files, and words still meet them in their rows."""
    nan = float("nan")
    plain = [(i, i % 2, [float(i), 0.5, -1.0]) for i in range(9)]
    odd = [(0, 0, [1.0, 2.0, 3.0]), (1, 1, [None, 4.0, 1.0]), (2, 1, [3.0, 0.1, nan]), (2, 0, [1.0, 1.0, 1.0]), (5, 0, [7.0, 1.0, 2.0])]
    for k, rows in enumerate((plain, odd)):
        emb = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        a, b = P.piece_table(emb, 9, 3).value, P.mapped_table(emb, 9, 3).value
        ids, lens = np.array([0, 1, 2, 2, 5, 8, 0], np.int64), np.array([2, 0, 1, 2, 1, 1])
        assert repr(a.mean(ids, lens)) == repr(b.mean(ids, lens)) and (a.counts is None) == (b.counts is None) == (k == 0)
    sf = written(spark, tmp_path, texts(13, 40))
    run = lambda: [sorted(map(tuple, f(spark, sf).collect())) for f in (Pr.project_gaps, Pr.scatter_mean)]
    want = run()
    monkeypatch.setattr(P, "TABLE", 1)
    for f in (Pr.project_gaps, Pr.scatter_mean):
        assert "Join" not in f(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert run() == want and len(want[0]) > 20


def test_gradients_of_many_trees_add_up():
    """a batch of trees gives the sum of the gradients of each, whether pairs are far apart or not."""
    rng = np.random.default_rng(2)
    for scale in (0.05, 3.0):
        prm = {"P": rng.normal(size=(5, 3)) * scale, "Vc": rng.normal(size=(3, 6)), "Vu": rng.normal(size=(3, 4))}
        lens = np.array([1, 4, 9, 2, 30])
        table = P.VectorTable(np.r_[np.ones(7, bool), False], np.r_[rng.normal(size=(7, 5)), np.zeros((1, 5))], None)
        n_ids = rng.integers(0, 4, lens.sum())
        ids = rng.integers(0, 8, n_ids.sum())
        x = table.mean(ids, n_ids)[0]
        d, lang = rng.integers(1, 5, (lens - 1).sum()).astype(float), np.array([0, 1, 0, 1, 0])
        cand_c, cand_u = [np.array([0, 2, 4]), np.array([1, 3, 5])], [np.array([0, 1]), np.array([2, 3])]
        c = np.concatenate([rng.choice(cand_c[i], n - 1) for i, n in zip(lang, lens)])
        u = np.concatenate([rng.choice(cand_u[i], n) for i, n in zip(lang, lens)])
        weight = np.array([1.0, 1.0, 0.0, 1.0, 1.0])
        total = lambda v: np.full(len(lens), float(v))
        held = type("Held", (), {"value": table})
        to = Fi.Projector(prm["P"], held)
        h, given = to.of(None, ids, n_ids)
        loss, gh, gVc, gVu = Fi.forest_gradients(h, lens, d, c, u, (lang, cand_c, cand_u), prm, total(7), total(5), total(6), weight)
        to.back(given, gh)
        want = [np.zeros((5, 3)), np.zeros((3, 6)), np.zeros((3, 4))]
        for r, (tok, gap) in enumerate(zip(np.split(np.arange(lens.sum()), np.cumsum(lens)[:-1]),
                                           np.split(np.arange((lens - 1).sum()), np.cumsum(lens - 1)[:-1]), strict=True)):
            one, *grads = Fi.tree_gradients(x[tok], d[gap], c[gap], u[tok], cand_c[lang[r]], cand_u[lang[r]], prm, 7, 5, 6)
            assert np.allclose(one, loss[r])
            for whole, g in zip(want, grads, strict=True):
                whole += weight[r] * g
        assert all(np.allclose(a, b) for a, b in zip(want, (to.gradient(), gVc, gVu), strict=True))
        t, p, each = forest(5)
        greater, smaller, n, hinge = Fi.active_of_trees(t, p * scale, each)
        for r, part in enumerate(np.split(np.arange(len(t)), np.cumsum(each)[:-1])):
            a, b = t[part], p[part] * scale
            act = (a[:, None] > a) & (b > b[:, None] - 1)
            assert (act.sum(axis=1) == greater[part]).all() and (act.sum(axis=0) == smaller[part]).all()
            assert n[r] == (a[:, None] > a).sum() and np.isclose(hinge[r], ((1 - b[:, None] + b) * act).sum())


def test_samples_and_their_gradients_hold_no_lists(spark):
    """the ids of a sample's pieces are laid end to end."""
    s = Pr.training_samples(spark, DATA)[0]
    assert s.schema["ids"].dataType.simpleString() == "array<int>"
    assert s.where("size(ids) <> aggregate(lens, 0, (a, x) -> a + x) OR size(lens) <> size(u) OR size(d) <> size(u) - 1").count() == 0
