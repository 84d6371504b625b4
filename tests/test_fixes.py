"""Cases that once gave wrong answers: many pairs, all-zero groups, nested opening tags, CRLF lists, stored tables."""

import pytest

from lignum.operators import clean, curate, results, vectors, vocab
from lignum.sources import files


def test_wilcoxon_many_pairs_and_zero_groups(spark):
    rows = [("a", k, float(k + 1), 0.0) for k in range(17)] + [("b", k, 1.0, 1.0) for k in range(5)]
    rows += [("c", k, float((-1) ** k * (k + 1)), 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    got = {r.g: r for r in results.wilcoxon(df, "k", "x", "y", ["g"]).collect()}
    assert got["a"].n == 17 and got["a"].p_value == pytest.approx(2 / 2 ** 17)
    assert got["b"].n == 0 and got["b"].p_value == 1.0
    assert got["c"].n == 300 and 0.5 < got["c"].p_value <= 1.0


def test_wilcoxon_equals_enumeration(spark):
    diff = [3.0, -1.0, 2.0, 2.0, -4.0, 5.0, 1.0, -2.0]
    df = spark.createDataFrame([(k, d, 0.0) for k, d in enumerate(diff)], "k int, x double, y double")
    got = results.wilcoxon(df, "k", "x", "y").first()
    size = sorted(map(abs, diff))
    rank = {v: sum(i + 1 for i, s in enumerate(size) if s == v) / size.count(v) for v in size}
    ranks = [rank[abs(d)] for d in diff]
    stat = min(sum(r for r, d in zip(ranks, diff, strict=True) if d > 0),
               sum(r for r, d in zip(ranks, diff, strict=True) if d < 0))
    below = sum(sum(r for i, r in enumerate(ranks) if m >> i & 1) <= stat + 1e-9 for m in range(256))
    assert got.statistic == stat and got.p_value == pytest.approx(min(1.0, 2 * below / 256))


def test_pattern_ranges_nested_open(spark):
    df = spark.createDataFrame([(1, "x<!-- a <!-- b -->y"), (2, "é<!--1-->z<!--2-->"), (3, "<!-- open"), (4, None)],
                               "page_id long, html string")
    got = sorted((r.page_id, r.start, r.end) for r in clean.pattern_ranges(df, "<!--", "-->").collect())
    assert got == [(1, 1, 18), (2, 2, 10), (2, 11, 19)]


def test_allowlist_strips_crlf(spark, tmp_path):
    (tmp_path / "list.txt").write_bytes(b" http://a/1\r\n\thttp://a/2 \r\n")
    assert [r.url for r in files.read_allowlist(spark, str(tmp_path / "list.txt")).collect()] == ["http://a/1", "http://a/2"]


def test_load_or_compute_computes_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)
    for _ in range(2):
        assert files.load_or_compute(spark, str(tmp_path / "t"), make).count() == 5
    assert len(calls) == 1


def test_code_files_by_extension(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    got = [(r.lang, r.code) for r in files.read_code_files(spark, str(tmp_path), {"py": "python"}).collect()]
    assert got == [("python", "x = 1\n")]


def test_nest_orders_large_keys(spark):
    from lignum.operators import trees
    customer = spark.createDataFrame([(1,)], "c_custkey long")
    orders = spark.createDataFrame([(4_000_000_000, 1, "F"), (3_000_000_000, 1, "O")],
                                   "o_orderkey long, o_custkey long, o_orderstatus string")
    lines = spark.createDataFrame([(4_000_000_000, 1, 1, 1, "N"), (3_000_000_000, 2, 1, 1, "R"), (3_000_000_000, 1, 1, 1, "A")],
                                  "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    rows = trees.nest_orders(customer, orders, lines).orderBy("start").collect()
    assert [r.type for r in rows] == ["customer", "order_o", "item_a", "item_r", "order_f", "item_n"]
    where = {r.node_id: r.type for r in rows}
    assert [where.get(r.parent_id) for r in rows] == [None, "customer", "order_o", "order_o", "customer", "order_f"]


def test_vocabulary_strict_lookup_and_unnamed_language(spark):
    occ = spark.createDataFrame([("c", "en", "x", 0, 1, 0), ("c", "en", "y", 0, 1, 1), ("c", "zz", "x", 0, 2, 0),
                                 ("c", "aa", "x", 0, 3, 0)],
                                "kind string, lang string, label string, split_ord int, sample_ord long, pos int")
    voc = vocab.global_vocab(vocab.local_vocab(occ), ["de", "en"])
    assert {r.label_key: r.global_id for r in voc.collect()} == {"x--en": 0, "y--en": 1, "x--aa": 2, "x--zz": 3}
    known = spark.createDataFrame([("en", "y")], "lang string, label string")
    assert [r.label_id for r in vocab.encode_labels(known, voc, "c").collect()] == [1]
    unknown = spark.createDataFrame([("de", "y")], "lang string, label string")
    with pytest.raises(Exception, match="label missing"):
        vocab.encode_labels(unknown, voc, "c").collect()
    with pytest.raises(Exception, match="several languages"):
        vocab.encode_labels(spark.createDataFrame([("x",)], "label string"), voc, "c", lang_col=None).collect()


def test_hash_split_shares(spark):
    n = {r.s: r["count"] for r in spark.range(20000).select(curate.hash_split("id").alias("s")).groupBy("s").count().collect()}
    assert abs(n["test"] - 4000) < 300 and abs(n["valid"] - 2000) < 300 and sum(n.values()) == 20000


def test_knn_many_queries_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 300)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    rows = spark.createDataFrame([(k, [float(k % 10), 0.0]) for k in range(20)] + [(99, None)], "vec_id long, vec array<double>")
    queries = spark.range(10500).select(F.col("id").alias("query"), F.array(F.col("id") % 10 + 0.25, F.lit(0.0)).alias("vec"))
    got = vectors.knn(rows, queries, 3)
    assert got.count() == 31500
    best = {(r.query, r.rank): r.vec_id for r in got.where("query IN (3, 10009)").collect()}
    assert best == {(3, 1): 3, (3, 2): 13, (3, 3): 4, (10009, 1): 9, (10009, 2): 19, (10009, 3): 8}


def test_label_family_every_branch_and_order(spark):
    from pyspark.sql import functions as F
    cases = [("argument_list", "argument"), ("call_argument", "argument"), ("call_expression", "call"),
             ("return_call", "call"), ("return_statement", "return"), ("method_invocation", "method_invocation"),
             ("return_block", "return"), ("block", "block"), ("binary_expression", "binary"),
             ("block_binary", "block"), ("member_expression", "member_expression"),
             ("member_expression<sep>x", "unplotted"), ("identifier", "unplotted")]
    df = spark.createDataFrame(cases, "label string, want string")
    assert df.where(results.label_family(F.col("label")) != F.col("want")).count() == 0


def test_results_read_from_run_directories(spark, tmp_path):
    for name, f1 in (("codebert_java_5_128", 0.5), ("bert_go_1_128", 0.25), ("codebert_multilingual_5_128", 0.9)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text('{"f1": %s}\n' % f1)
    got = results.recode(files.read_results(spark, str(tmp_path), "f1 double"), "model")
    assert sorted((r.model, r.lang, r.layer, r.rank, r.f1) for r in got.collect()) == [
        ("BERT", "go", 1, 128, 0.25), ("CodeBERT", "java", 5, 128, 0.5)]


def test_saved_vocabulary_is_reused(spark, tmp_path):
    path = str(tmp_path / "vocab")
    files.save_table(spark.range(3), path)
    files.save_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    files.save_table(spark.range(2), path, mode="append")
    assert spark.read.parquet(path).count() == 5


def test_json_array_and_text_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"func": "int f() {}", "x": 1}, {"func": null}, {"x": 2}]')
    got = [r.original_string for r in files.read_json_array(spark, str(tmp_path / "a.json")).collect()]
    assert got == ["int f() {}", None, None]
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    lines = lambda keep: sorted(r.original_string for r in files.read_text_lines(spark, [str(tmp_path / "b.txt")], keep).collect())
    assert lines(True) == ["\n", "one\n", "two\n"] and lines(False) == ["", "one", "two"]
