"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lignum.session import ensure_checkpoint_dir

# White space of every contract here: space and U+0009 to U+000D.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDS = 5


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: what is read later depends on files in the shared
    folder only, so a lost executor costs nothing but its running tasks.  Tables that
    hold whole texts or token ids take the slower and denser ``zstd``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lignum-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of a Python worker to the system; the allocator keeps it otherwise, also while idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, whose worker returns its freed memory before it waits for another task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def text_of(col: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Key of a row: its id and the hash of its text (rows alike in both share one result)."""
    return [id_col.alias("_id"), F.xxhash64(text).alias("_fp")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of two row keys."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_fp"] == b["_fp"])


def held_out(id_col: Column) -> Column:
    """Rows of the held-out fold: crc32 of the id as text is divisible by five (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def working_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (in any case of its letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
