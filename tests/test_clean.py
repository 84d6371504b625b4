"""Comment stripping fixtures (derived cases of the fixtures file)."""

from pyspark.sql import functions as F

from lignum.operators import clean as C


def run(spark, text, fn):
    return spark.createDataFrame([(text,)], "s string").select(fn(F.col("s")).alias("o")).first().o


def test_java_js(spark):
    src = 'a="//x"; // c1\nb; // c2\r\n/* m\n l */z'
    assert run(spark, src, C.strip_java_js) == 'a="//x"; \nb; // c2\r\nz'


def test_php_c(spark):
    src = '#include <a>\nint f(){ // c1\n  char*s="// no"; /* m\n l */ return 1; // c1\n}'
    assert run(spark, src, C.strip_php_c) == 'int f(){ \n  char*s="// no";  return 1; \n}'
    assert run(spark, "// \n// foo\nx //\n", C.strip_php_c) == "\nfoo\nx \n"
    assert run(spark, "a  # k\nb\r\n// q\r\nz", C.strip_php_c) == "ab\r\n\nz"


def test_envelope(spark):
    df = spark.createDataFrame([("int x;", "java"), ("echo 1;", "php"), ("<?php x ?>", "php")], "s string, l string")
    out = [r.o for r in df.select(C.envelope(F.col("s"), F.col("l")).alias("o")).collect()]
    assert out == ["public class Main {\nint x;\n}", "<?php\necho 1;\n?>", "<?php x ?>"]


def test_cut_ranges(spark):
    t = spark.createDataFrame([(1, "aé<!--x-->b<!--yy-->c"), (2, "plain")], "page_id long, html string")
    r = C.pattern_ranges(t, "<!--", "-->")
    out = {x.page_id: x.html for x in C.cut_ranges(t, r, "page_id", "html").collect()}
    assert out == {1: "aébc", 2: "plain"}
    ov = spark.createDataFrame([(1, 0, 3), (1, 2, 5)], "page_id long, start int, end int")
    t2 = spark.createDataFrame([(1, "0123456789")], "page_id long, html string")
    assert C.cut_ranges(t2, ov, "page_id", "html").first().html == "56789"
