"""Reusable column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(key: Column, hex_digits: int = 6) -> Column:
    """Deterministic integer in [0, 16**hex_digits) from the md5 of a string key.

    The same value is ``('0x' || substr(md5(key), 1, 6))::BIGINT`` in DuckDB.
    """
    return F.conv(F.substring(F.md5(key), 1, hex_digits), 16, 10).cast("long")


def seeded_order_key(key: Column, seed: int) -> Column:
    """Order key for a seeded shuffle: md5 of ``key || ':' || seed`` (hex string)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
