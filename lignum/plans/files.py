"""Registered queries of the file scans and sinks (A1-A5, A7-A12): written below the checkpoint folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.constants import DATASET_SEED
from lignum.operators import curate as U
from lignum.operators import results as R
from lignum.plans import results as Re
from lignum.plans import vocab_vectors as VV
from lignum.plans.registry import finish, query
from lignum.session import ensure_checkpoint_dir
from lignum.sources import files as Fs
from lignum.sources.tables import table

_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lignum-{name}-{uuid.uuid4().hex}"


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in the columns of a corpus shard."""
    words = F.filter(F.split(F.col("text"), "[ \n]+", -1), lambda x: x != "")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("original_string"),
                                                words.alias("code_tokens"), "lang", "doc_id")


@query("jsonl_shards", sql=f"""
SELECT doc_id::VARCHAR AS url, strlen(text)::BIGINT AS n_bytes, md5(text) AS digest, len({_WORDS}) AS n_tokens FROM documents""")
def jsonl_shards(spark, sf):
    """Gzip JSONL shards, each line once, by recursive scan."""
    path = scratch(spark, "shards")
    docs = snippets(spark, sf)
    for name, part in (("a", docs.where("doc_id % 2 = 0")), ("b/c", docs.where("doc_id % 2 <> 0"))):
        part.select("url", "original_string", "code_tokens").write.option("compression", "gzip").json(f"{path}/{name}")
    back = Fs.read_jsonl_shards(spark, path)
    last = U.dedupe_last(back, "url", F.struct("_file", "_line"))
    return finish(last.select("url", F.octet_length("original_string").alias("n_bytes"), F.md5("original_string").alias("digest"),
                              F.size("code_tokens").alias("n_tokens")))


@query("json_array_files", sql="SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1")
def json_array_files(spark, sf):
    """A2: files of one JSON array each."""
    path = scratch(spark, "arrays")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    files = docs.count() // 500 + 1   # about 500 snippets a file
    arrays = docs.groupBy(F.pmod("doc_id", F.lit(files)).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(F.col("text").alias("func")))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return finish(Fs.read_json_array(spark, path).groupBy(F.md5("original_string").alias("digest")).agg(F.count(F.lit(1)).alias("n")))


@query("text_lines", sql=r"""
SELECT md5(line || chr(10)) AS digest, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents)
GROUP BY 1""")
def text_lines(spark, sf):
    """A3: every line of text files is a snippet, its newline kept."""
    path = scratch(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = Fs.read_text_lines(spark, [path])
    return finish(lines.groupBy(F.md5("original_string").alias("digest")).agg(F.count(F.lit(1)).alias("n")))


@query("allowlist_file", sql="""
SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1""")
def allowlist_file(spark, sf):
    """A list of ids read from text, white space stripped, joined with the corpus."""
    path = scratch(spark, "allow")
    good = table(spark, sf, "labels").where("quality = 1")
    good.select(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit("\t\r")).alias("value")).write.option(
        "lineSep", "\n").text(path)
    allow = Fs.read_allowlist(spark, path).where("url <> ''").select("url")
    return finish(U.allowlist_join(allow, snippets(spark, sf), "url").select("doc_id", "lang"))


@query("split_files", sql=f"""
WITH hs AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || ':{DATASET_SEED}'), 1, 6))::BIGINT / 16777216.0 AS h FROM documents)
SELECT doc_id::VARCHAR AS url, lang, len({_WORDS}) AS n_tokens, md5(text) AS digest FROM hs WHERE h >= 0.3 AND lang IN ('en', 'fr')""")
def split_files(spark, sf):
    """Splits written by language and split, a second write left alone, two languages' train split read."""
    path = scratch(spark, "splits")
    rows = snippets(spark, sf).withColumn("split", U.hash_split(F.col("doc_id"))).drop("doc_id")
    Fs.write_splits(rows, path)
    Fs.write_splits(rows.limit(1), path)
    back = Fs.read_splits(spark, path, Fs.SNIPPET_SCHEMA, langs=["en", "fr"], split="train")
    return finish(back.select("url", "lang", F.size("code_tokens").alias("n_tokens"), F.md5("original_string").alias("digest")))


@query("vocabulary_file", sql="WITH " + VV.OCC_SQL + """
SELECT kind, lang, count(*) AS n, sum(global_id)::BIGINT AS ids FROM gv GROUP BY kind, lang""")
def vocabulary_file(spark, sf):
    """A vocabulary is written once and read when it is there."""
    path = scratch(spark, "vocabulary")
    voc = VV.vocab(spark, sf)
    Fs.save_table(voc, path)
    Fs.save_table(voc.limit(1), path)
    return finish(spark.read.parquet(path).groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("global_id").alias("ids")))


@query("metrics_sink", sql="WITH " + Re.RAW_RUNS_CTE + """
SELECT model, count(*) AS n_runs, round(avg(f1), 6) AS f1 FROM raw_runs GROUP BY model""")
def metrics_sink(spark, sf):
    """Metrics appended run by run (here: a language at a time)."""
    path = scratch(spark, "metrics")
    runs = Re.raw_runs(spark, sf).persist()
    for lang in ("python", "java"):
        Fs.save_table(runs.where(F.col("lang") == lang), path, mode="append")
    Fs.save_table(runs.where(~F.col("lang").isin("python", "java")), path, mode="append")
    runs.unpersist()
    return finish(spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("f1").alias("f1")))


@query("run_directories", sql="WITH " + Re.RAW_RUNS_CTE + """
SELECT model, lang, layer::BIGINT AS layer, rank::BIGINT AS rank, round(f1, 6) AS f1 FROM raw_runs WHERE lang <> 'go'""")
def run_directories(spark, sf):
    """Metrics read from the directories of their runs, marked ones skipped."""
    path = scratch(spark, "runs")
    runs = Re.raw_runs(spark, sf)
    marked = F.when(F.col("lang") == "go", "multilingual").otherwise(F.col("model"))
    name = F.concat_ws("_", marked, "lang", F.col("layer").cast("string"), F.col("rank").cast("string"))
    runs.select(name.alias("run"), "f1").repartition(8, "run").write.partitionBy("run").json(path)
    back = Fs.read_results(spark, path, "f1 double")
    return finish(back.select("model", "lang", "layer", "rank", "f1"))


@query("materialised", sql="SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def materialised(spark, sf):
    """A table is computed once and read afterwards."""
    path = scratch(spark, "materialised")
    per = lambda: table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    Fs.load_or_compute(spark, path, per)

    def never() -> DataFrame:
        raise AssertionError("computed a second time")
    return finish(Fs.load_or_compute(spark, path, never))
