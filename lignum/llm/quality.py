"""Quality rules by distribution divergence (native DataFrame operations only).

Each document's histogram of character classes and of common words is compared
with the reference of its language by the Jensen-Shannon distance (base 2, 0 to
1).  The references are counted over all documents of the language:

- character classes: shares of the classes in ``CLASSES`` and of all other characters;
- common words: the lower-cased words that make up at least ``1 / share`` of the
  language's words (so at most ``share`` of them), and one bucket for the rest.

The common words are found exactly without shuffling every distinct word: words
are first counted in ``BUCKETS`` hash buckets, and only words of buckets that
reach the share are counted one by one.

A document is judged by a histogram only from ``min_chars`` characters or
``min_words`` words on, and only if its language holds ``min_ref`` words.

Cases: null text has no words and fails the base rules.  A null language is a
language of its own.  Rows alike in id and text share one result; an empty table
gives an empty result; other columns pass through under any name, columns named like
a result are replaced.  Tables with rows per language are stored and joined as their
size allows, none is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lignum.llm.common import GAP, WHITESPACE, row_key, stored, text_of, working_names

# Character classes, counted one after the other on what the ones before left.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("space", "[\\x20\\x09-\\x0D]+"),
           ("point", "[.,;:!?'\"()\\-]+"), ("symbol", "[\\x21-\\x7E]+"), ("wide", "[^\\x00-\\x7F]+"))
SYMBOLS = "#*$%&|<>"
BUCKETS = 4096
SHARE = 500
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.46
MIN_CHARS = 200
MIN_WORDS = 50
MIN_REF = 2000
WINDOW = 5

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance",
           "word_distance", "base_failed", "kept")


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def _long(col: Column) -> Column:
    return col.cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_t`` (text), ``_w`` (words) and the base counts."""
    df = docs.withColumn("_t", text_of(F.col(text_col))).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")
    n = F.size("_w")
    df = df.withColumns({"_lines": lines, "_hash": F.transform("_w", lambda x: F.xxhash64(x))})
    df = df.withColumn("_grams", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))))
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    # positions of windows that occur again: sort (hash, position) and look at the neighbours
    df = df.withColumn("_pairs", F.when(again, F.sort_array(
        F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("_pairs", lambda x, j: (F.get("_pairs", j - 1)["h"] == x["h"]).eqNullSafe(True)
                    | (F.get("_pairs", j + 1)["h"] == x["h"]).eqNullSafe(True))
    df = df.withColumn("_at", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda x, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumns({
        "n_words": _long(n),
        "word_chars": _long(F.length(F.regexp_replace("_t", GAP, ""))),
        "n_symbols": _long(F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", ""))),
        "n_dup_lines": _long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": _long(F.coalesce(covered, F.lit(0)))})
    return df.drop("_lines", "_hash", "_grams", "_pairs", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _classes(df: DataFrame) -> DataFrame:
    """``df`` plus ``_c0`` to ``_cN``: one regular expression runs per column, on what the last one left."""
    df = df.withColumn("_r0", F.col("_t"))
    for k, (_name, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", pattern, ""))
    n = len(CLASSES)
    lens = [F.length(f"_r{k}") for k in range(n + 1)]
    counts = [_long(lens[k] - lens[k + 1]) for k in range(n)] + [_long(lens[n])]
    return df.select(*[c for c in df.columns if not c.startswith("_r")],
                     F.array(*counts).alias("_classes"))


def js_distance(terms: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), terms))


def _js_term(p: Column, q: Column) -> Column:
    """One bucket's part of the divergence, in bits."""
    m = (p + q) / 2

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (half(p) + half(q)) / 2


def word_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Words that may be common, counted per document, and the full buckets with each language's total.

    A word that makes up ``1 / share`` of a language lies in a bucket that does, so
    counting only the words of full buckets loses no common word.
    """
    text = text_of(F.col(text_col))
    w = docs.select(*row_key(F.col(id_col), text), F.col(lang_col).alias("_lang"),
                    F.explode(words(F.lower(text))).alias("_word"))
    w = w.withColumn("_b", F.pmod(F.hash("_word"), F.lit(BUCKETS)))
    # one row per language and bucket
    buckets = stored(w.groupBy("_lang", "_b").agg(F.count(F.lit(1)).alias("n")), "buckets")
    total = buckets.groupBy(F.col("_lang").alias("_bl")).agg(F.sum("n").alias("_total"))
    full = (buckets.join(total, F.col("_lang").eqNullSafe(F.col("_bl")))
            .where(F.col("n") * share >= F.col("_total")).select("_bl", F.col("_b").alias("_bb"), "_total"))
    full = stored(full, "full")  # at most `share` buckets of a language are full
    counted = (w.join(full, F.col("_lang").eqNullSafe(F.col("_bl")) & (F.col("_b") == F.col("_bb")))
               .groupBy("_id", "_fp", "_lang", "_word").agg(F.count(F.lit(1)).alias("n")))
    return stored(counted, "words"), total


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          share: int = SHARE, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
          min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_ref: int = MIN_REF) -> DataFrame:
    """``docs`` (without its text) plus the base counts, ``class_distance``, ``word_distance`` (null
    below the guards), ``base_failed`` and ``kept``."""
    return verdicts(docs, id_col, text_col, lang_col, share, max_class, max_word, min_chars, min_words,
                    min_ref).select("_own.*", *RESULTS)


def verdicts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, share: int = SHARE,
             max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS,
             min_words: int = MIN_WORDS, min_ref: int = MIN_REF) -> DataFrame:
    """The results of ``judge`` with the row's key ``_id, _fp, _lang`` and its other columns as ``_own``."""
    names = [c for c in docs.columns if c not in (*RESULTS, text_col)]
    text = text_of(F.col(text_col))

    # counts of each document, in one pass over the texts
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"), *row_key(F.col(id_col), text),
                      F.col(lang_col).alias("_lang"), text.alias("_t"))
    feats = _classes(features(key, "_t")).drop("_w", "_t")
    feats = stored(feats, "features")
    n_cls = len(CLASSES) + 1
    sums = feats.groupBy(F.col("_lang").alias("_rl")).agg(
        *[F.sum(F.get("_classes", F.lit(k))).alias(f"c{k}") for k in range(n_cls)])
    all_chars = sum((F.col(f"c{k}") for k in range(1, n_cls)), F.col("c0"))
    ref = sums.select("_rl", F.array(*[
        F.col(f"c{k}") / F.greatest(all_chars, F.lit(1)) for k in range(n_cls)]).alias("_q"))
    ref = stored(ref, "references")  # one row per language

    # shares of the common words, per language and per document
    counted, total = word_counts(docs, id_col, text_col, lang_col, share)
    common = (counted.groupBy(F.col("_lang").alias("_cl"), F.col("_word").alias("_cw")).agg(F.sum("n").alias("_cn"))
              .join(total, F.col("_cl").eqNullSafe(F.col("_bl")))
              .where(F.col("_cn") * share >= F.col("_total"))
              .select("_cl", "_cw", (F.col("_cn") / F.col("_total")).alias("q"), "_total"))
    common = stored(common, "common")
    hits = (counted.join(common.select("_cl", "_cw", "q"), F.col("_lang").eqNullSafe(F.col("_cl")) & (F.col("_word") == F.col("_cw")))
            .groupBy(F.col("_id").alias("_hi"), F.col("_fp").alias("_hf"), F.col("_lang").alias("_hl"))
            .agg(F.collect_list(F.struct("n", "q")).alias("_hits")))
    whole = common.groupBy(F.col("_cl").alias("_wl")).agg(F.sum("q").alias("_mass"), F.first("_total").alias("_total"))

    # rows alike in id, text and language were counted together
    alike = Window.partitionBy("_id", "_fp", "_lang")
    df = feats.withColumn("_m", F.count(F.lit(1)).over(alike))
    df = df.join(ref, F.col("_lang").eqNullSafe(F.col("_rl")), "left")
    df = df.join(whole, F.col("_lang").eqNullSafe(F.col("_wl")), "left")
    df = df.join(hits, F.col("_id").eqNullSafe(F.col("_hi")) & (F.col("_fp") == F.col("_hf"))
                 & F.col("_lang").eqNullSafe(F.col("_hl")), "left")

    df = df.withColumns({
        "_nc": F.aggregate("_classes", F.lit(0).cast("long"), lambda a, b: a + b),
        "_nw": (F.greatest(F.col("n_words"), F.lit(1)) * F.col("_m")).cast("double"),
        "_h": F.coalesce(F.col("_hits"), F.array().cast("array<struct<n:bigint,q:double>>"))})
    cls = F.aggregate(F.zip_with("_classes", "_q", lambda n, q: _js_term(n / F.greatest(F.col("_nc"), F.lit(1)), q)),
                      F.lit(0.0), lambda a, b: a + b)
    df = df.withColumns({
        "_on": F.aggregate("_h", F.lit(0.0), lambda a, x: a + _js_term(x["n"] / F.col("_nw"), x["q"])),
        "_ps": F.aggregate("_h", F.lit(0.0), lambda a, x: a + x["n"] / F.col("_nw")),
        "_qs": F.aggregate("_h", F.lit(0.0), lambda a, x: a + x["q"])})
    # a common word that the document lacks adds half its share; all other words are one bucket
    word = (F.col("_on") + F.greatest(F.lit(0.0), F.col("_mass") - F.col("_qs")) / 2
            + _js_term(F.greatest(F.lit(0.0), 1 - F.col("_ps")), F.greatest(F.lit(0.0), 1 - F.col("_mass"))))
    enough = F.coalesce(F.col("_total") >= min_ref, F.lit(False))
    df = df.withColumns({
        "class_distance": F.when(enough & (F.col("_nc") >= min_chars), js_distance(cls)),
        "word_distance": F.when(enough & (F.col("n_words") >= min_words), js_distance(word)),
        "base_failed": base_failed()})
    far = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).select("_own", "_id", "_fp", "_lang", *RESULTS)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    verdict = verdicts(docs.select(*dict.fromkeys((id_col, text_col, lang_col))), id_col, text_col, lang_col, **limits)
    kid, kfp, kl = working_names(docs, "_kid", "_kfp", "_kl")
    kept = verdict.where("kept").select(F.col("_id").alias(kid), F.col("_fp").alias(kfp), F.col("_lang").alias(kl))
    on = (F.col(id_col).eqNullSafe(F.col(kid)) & (F.xxhash64(text_of(F.col(text_col))) == F.col(kfp))
          & F.col(lang_col).eqNullSafe(F.col(kl)))
    return docs.join(kept, on, "left_semi")
