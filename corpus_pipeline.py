"""Documents to packed training sequences: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm import line_dedup, minhash, mixing, packing, quality
from lignum.llm.common import stored, working_names

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; a document left without text goes too."""
    cut = line_dedup.dedup_lines(docs).where(F.col("kept_text") != "")
    return (cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
            .select(*docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays (null ids come last).

    Rows are numbered first, so null and repeated ids are rows like any other."""
    key, = working_names(docs, "_row")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows", "zstd")
    classes = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    light = rows.select(F.col(key).alias("row"), F.col("doc_id").isNull().alias("last"), "doc_id",
                        F.xxhash64("text").alias("digest"))
    first = F.min(F.struct("last", F.col("light.doc_id").alias("id"), "digest", "row"))
    kept = (light.alias("light").join(classes.select(F.col("doc_id").alias("_r"), "class_id"), F.col("row") == F.col("_r"))
            .groupBy("class_id").agg(first.alias("first")).select(F.col("first.row").alias(key)))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document becomes a row for each pass that takes words of it, with these words; one not taken goes."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: their documents, pieces and lengths in order, and their token ids."""
    import public_tokenizers
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Packing needs a tokenizer, which SQL cannot express; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences: their documents in order and their token ids."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
