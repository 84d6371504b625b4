"""Source cleaning (B2-B6): comment stripping and byte-range cutting.

Everything is a JVM-side regex or string expression over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the comment patterns -------------------------------------
# java / javascript / go: group 1 = quoted string (kept), group 2 = comment.
# ``(?d)`` makes ``$`` a Unix-lines anchor, as in Python where ``$`` does not
# match before a ``\r``.
JAVA_JS_PATTERN = r"(?dsm)(\".*?\"|'.*?')|(/\*.*?\*/|//[^\r\n]*$)"
# php / c: group 2 = comment text; every occurrence of that text is deleted
PHP_C_PATTERN = r'(?dm)("[^\n]*"(?!\\))|(//[^\n]*$|/(?!\\)\*[\s\S]*?\*(?!\\)/)'
HASH_LINE_PATTERN = r"(?dm) *#.*\n?"
JAVA_PREFIX = "public class Main {\n"
JAVA_SUFFIX = "\n}"
PHP_OPEN = "<?php"
PHP_CLOSE = "?>"
# --- end of fixed values ----------------------------------------------------


def strip_java_js(code: Column) -> Column:
    """B2: remove ``/* */`` and ``//`` comments, keep quoted strings."""
    return F.regexp_replace(code, JAVA_JS_PATTERN, "$1")


def strip_php_c(code: Column) -> Column:
    """Delete every occurrence of each matched comment's text, then ``#`` lines.

    Deleting by text (not by position) is the intended behaviour: an empty
    ``//`` comment removes every ``//`` in the text.
    """
    found = F.regexp_extract_all(code, F.lit(PHP_C_PATTERN), 2)
    removed = F.aggregate(found, code, lambda acc, x: F.replace(acc, x, F.lit("")))
    return F.regexp_replace(removed, HASH_LINE_PATTERN, "")


def envelope(code: Column, lang: Column) -> Column:
    """Language envelope applied before parsing (java class, php tags)."""
    php = F.concat(F.when(code.startswith(PHP_OPEN), F.lit("")).otherwise(F.lit(PHP_OPEN + "\n")), code,
                   F.when(code.endswith(PHP_CLOSE), F.lit("")).otherwise(F.lit("\n" + PHP_CLOSE)))
    return (F.when(lang == "java", F.concat(F.lit(JAVA_PREFIX), code, F.lit(JAVA_SUFFIX)))
            .when(lang == "php", php).otherwise(code))


def clean_code(code: Column, lang: Column) -> Column:
    """Per-language dispatch of envelope + comment stripping."""
    c = envelope(code, lang)
    return (F.when(lang.isin("java", "javascript", "go"), strip_java_js(c))
            .when(lang.isin("php", "c"), strip_php_c(c))
            .otherwise(c))


def without_ranges(text: Column, ranges: Column) -> Column:
    """B5 on one row: the text without the byte ranges ``[start, end)`` (an array, in any order, overlaps allowed).

    One scan over the sorted ranges notes where each kept piece lies; the bytes are cut once.  Ranges must fall
    on character boundaries.
    """
    raw = F.encode(text, "UTF-8")
    piece = "struct<start:int,end:int>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece}>").alias("kept"))

    def step(acc, r):
        cut = F.when(r["start"] > acc["at"], F.array(F.struct(acc["at"].alias("start"), r["start"].cast("int").alias("end"))))
        return F.struct(F.greatest(acc["at"], r["end"].cast("int")).alias("at"),
                        F.concat(acc["kept"], F.coalesce(cut, F.array().cast(f"array<{piece}>"))).alias("kept"))
    walked = F.aggregate(F.array_sort(ranges), begin, step, lambda acc: F.concat(
        acc["kept"], F.array(F.struct(acc["at"].alias("start"), F.lit(2 ** 31 - 1).alias("end")))))
    pieces = F.transform(walked, lambda k: F.decode(F.substring(raw, k["start"] + 1, k["end"] - k["start"]), "UTF-8"))
    return F.when(ranges.isNull() | (F.size(ranges) == 0), text).otherwise(F.array_join(pieces, ""))


def cut_ranges(texts: DataFrame, ranges: DataFrame, id_col: str = "tree_id",
               text_col: str = "text") -> DataFrame:
    """Remove byte ranges ``[start, end)`` (possibly overlapping) of a ranges table from texts.

    The ranges of a text become one array and meet the text once, so bytes are shuffled at most once.
    """
    r = ranges.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    out = texts.join(r, F.col(id_col) == F.col("_id"), "left")
    return out.withColumn(text_col, without_ranges(F.col(text_col), F.col("_ranges"))).drop("_id", "_ranges")


def block_ranges(text: Column, open_tag: str, close_tag: str) -> Column:
    """Byte ranges of ``open ... close`` blocks (non-nested) of a text, as an array of (start, end).

    Blocks are what the non-greedy pattern ``open.*?close`` matches from left to
    right, so a second opening tag before the close is part of the block.  Offsets
    are running sums of UTF-8 lengths over the pieces between matches.
    """
    pattern = f"(?s){_quote(open_tag)}.*?{_quote(close_tag)}"
    gaps, blocks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        begin = (acc["at"] + F.octet_length(x["gap"])).cast("int")
        end = (begin + F.octet_length(x["block"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
                        .alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(blocks)), blocks, lambda g, b: F.struct(g.alias("gap"), b.alias("block")))
    return F.aggregate(pairs, start, step)["out"]


def pattern_ranges(texts: DataFrame, open_tag: str, close_tag: str, id_col: str = "page_id",
                   text_col: str = "html") -> DataFrame:
    """``block_ranges`` of a table of texts, as a ranges table."""
    return (texts.select(F.col(id_col), F.explode(block_ranges(F.col(text_col), open_tag, close_tag)).alias("r"))
            .select(id_col, F.col("r.start").alias("start"), F.col("r.end").alias("end")))


def _quote(s: str) -> str:
    import re
    return re.escape(s)
