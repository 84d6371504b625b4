"""File scans and sinks of the pipeline.

All readers take an explicit schema (no inference pass over the data) and
leave column pruning / partition pruning to Catalyst; writers are
idempotent where the pipeline relies on it (``mode('ignore')``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("original_string", T.StringType()),
    T.StructField("code_tokens", T.ArrayType(T.StringType())),
])


def read_jsonl_shards(spark: SparkSession, root: str, schema: T.StructType = SNIPPET_SCHEMA,
                      glob: str = "*.gz") -> DataFrame:
    """A1: recursive scan of (gzip) JSONL shards; one task per file, gzip decoded natively.

    Adds ``_file`` and ``_line`` (line order within the file) for last-write-wins dedupe.
    """
    df = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .json(root))
    return df.withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())


def read_json_array(spark: SparkSession, path: str, field: str = "func") -> DataFrame:
    """A2: one big JSON array file; project ``field`` as ``original_string``."""
    schema = T.StructType([T.StructField(field, T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.col(field).alias("original_string"))


def read_text_lines(spark: SparkSession, paths: list[str], keep_newline: bool = True) -> DataFrame:
    """A3: every line of the files is one snippet (newline re-appended like ``readlines``)."""
    df = spark.read.text(paths)
    return df.select((F.concat(F.col("value"), F.lit("\n")) if keep_newline else F.col("value"))
                     .alias("original_string"))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """A4: one url per line, stripped; keeps the line position for list order."""
    return (spark.read.text(path)
            .select(F.btrim("value", F.lit(" \t\n\x0b\x0c\r")).alias("url"), F.monotonically_increasing_id().alias("line_no")))


def write_splits(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Partitioned by language and split; existing output is left alone."""
    df.write.mode("ignore").partitionBy("lang", "split").format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                langs: list[str] | None = None, split: str | None = None) -> DataFrame:
    """A5: read the partitioned splits; filters on lang / split prune directories."""
    full = T.StructType(schema.fields + [T.StructField("lang", T.StringType()),
                                         T.StructField("split", T.StringType())])
    df = spark.read.schema(full).format(fmt).load(path)
    if langs is not None:
        df = df.where(F.col("lang").isin(langs))
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def read_code_files(spark: SparkSession, root: str, exts: dict[str, str]) -> DataFrame:
    """Whole source files; language from the file extension."""
    # the glob keeps other files from being read at all
    only = "*.{" + ",".join(sorted(exts)) + "}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", only).text(root, wholetext=True) \
        .withColumn("path", F.input_file_name())
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    m = F.create_map(*[x for k, v in exts.items() for x in (F.lit(k), F.lit(v))])
    return df.select("path", m[ext].alias("lang"), F.col("value").alias("code")).where(F.col("lang").isNotNull())


def save_table(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Vocabularies (reuse when present) and metrics (append) as parquet."""
    df.write.mode(mode).parquet(path)


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read a materialised table, or compute it, write it, and read it back."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, "_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_results(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """A10: one metrics file per run directory ``<model>_<lang>_<layer>_<rank>``."""
    from lignum.operators.results import parse_run_dirs
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(root) \
        .withColumn("path", F.input_file_name())
    return parse_run_dirs(df, "path")
