"""The composed filter: parse failures, error nodes, shape and length, on odd rows."""

from pyspark.sql import functions as F

from lignum.operators import curate as U
from lignum.plans import standins as St
from lignum.ship import ensure_shipped


def test_rows_that_fail_are_kept_with_their_reason(spark):
    ensure_shipped(spark)
    rows = [(1, "<html><p>one two<p>three</html>"), (2, "<html><p>x"), (3, "<p></b></p>"), (4, "plain"), (5, None), (6, ""),
            (7, "<p><b>x<b>y</p>"), (8, "<p></p><p></p>"), (9, "<p>" + "word " * 600 + "</p>"),
            (10, '<p><script>var t="</p></b>";</script><!-- <b> --><br></p>')]
    df = spark.createDataFrame(rows, "page_id long, html string")
    words = St.markup_words(F.col("html"))
    counts = [F.coalesce(St.subtoken_counts(words, w, k), F.lit(0)) for w, k in ((4, "bpe"), (3, "wordpiece"))]
    got = {r.page_id: r for r in U.curated(df, U.guarded(St.parse_markup)(St.markup_tags(F.col("html"))), counts).collect()}
    assert {i: r.reason for i, r in got.items()} == {
        1: None, 2: "parse: unclosed html", 3: "parse: unexpected b", 4: "parse: no elements", 5: "parse: null input",
        6: "parse: no elements", 7: "error node", 8: "not a tree", 9: "too long", 10: None}
    assert all(r.keep == (r.reason is None) for r in got.values())
    assert [(n.node_id, n.parent_id, n.type, n.start, n.end) for n in got[1].nodes] == [
        (0, None, "html", 0, 4), (1, 0, "p", 1, 3), (2, 1, "p", 2, 3)]


def test_truncating_split(spark):
    df = spark.range(57).withColumnRenamed("id", "doc_id").repartition(3)
    got = U.truncate_split(df, "doc_id", (0.8, 0.1)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 45, "valid": 5, "test": 7}
