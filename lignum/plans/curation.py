"""Registered cleaning and curation queries (A*, B2-B11, J1, J2, S1-S5, G13, M6-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.constants import MODEL_TYPE_MAPPING
from lignum.operators import clean as C
from lignum.operators import curate as U
from lignum.plans import standins as St
from lignum.plans.registry import finish, query
from lignum.ship import ensure_shipped
from lignum.sources.tables import table

# stand-in tokenizers: characters per piece
TOKENIZERS = {"roberta": 4, "bert": 3}


def word_list(text):
    return F.filter(F.split(text, "[ \n]+", -1), lambda x: x != "")


def words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(word_list(F.col("text"))).alias("pos", "token"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return words(table(spark, sf, "documents").select("doc_id", "text"))


def subtokens(words):
    """A row's sub-tokens under each stand-in tokenizer."""
    return [St.subtoken_counts(words, width, MODEL_TYPE_MAPPING.get(tok, "")) for tok, width in TOKENIZERS.items()]


_JAVA_JS_SQL = C.JAVA_JS_PATTERN.replace("(?dsm)", "(?sm)").replace("'", "''")


@query("strip_line_comments", sql=rf"""
SELECT page_id, strlen(html)::BIGINT AS n_before, strlen(c)::BIGINT AS n_after, md5(c) AS digest FROM (
  SELECT page_id, html, regexp_replace(html, '{_JAVA_JS_SQL}', '\1', 'g') AS c FROM pages)""")
def strip_line_comments(spark, sf):
    """Javascript-style comment stripping over whole pages."""
    p = table(spark, sf, "pages").select("page_id", "html")
    c = C.clean_code(F.col("html"), F.lit("javascript"))
    return finish(p.select("page_id", F.octet_length("html").alias("n_before"),
                           F.octet_length(c).alias("n_after"), F.md5(c).alias("digest")))


# the patterns without what RE2 lacks: a look at the next character, which differs from the pattern only where a
# quoted string is followed by a backslash (no document has one), and the Unix-lines flag
_PHP_C_SQL = C.PHP_C_PATTERN.replace(r"(?!\\)", "").replace("(?dm)", "(?m)")
_HASH_SQL = C.HASH_LINE_PATTERN.replace("(?dm)", "(?m)")


@query("strip_hash_comments", sql=rf"""
SELECT doc_id, strlen(text)::BIGINT AS n_before, strlen(c)::BIGINT AS n_after, md5(c) AS digest FROM (
  SELECT doc_id, text, regexp_replace(list_reduce(list_prepend(text, regexp_extract_all(text, '{_PHP_C_SQL}', 2)),
                                      lambda acc, x: replace(acc, coalesce(x, ''), '')), '{_HASH_SQL}', '', 'g') AS c FROM documents)""")
def strip_hash_comments(spark, sf):
    """Php / c comment stripping over whole documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = C.strip_php_c(F.col("text"))
    return finish(d.select("doc_id", F.octet_length("text").alias("n_before"),
                           F.octet_length(c).alias("n_after"), F.md5(c).alias("digest")))


@query("cut_ranges", sql=r"""
SELECT page_id, strlen(c)::BIGINT AS n_after, md5(c) AS digest
FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS c FROM pages)""")
def cut_ranges(spark, sf):
    """Cut the byte ranges of HTML comments out of every page."""
    p = table(spark, sf, "pages").select("page_id", "html")
    out = p.withColumn("html", C.without_ranges(F.col("html"), C.block_ranges(F.col("html"), "<!--", "-->")))
    return finish(out.select("page_id", F.octet_length("html").alias("n_after"), F.md5("html").alias("digest")))


@query("dedupe_last", sql="""
SELECT max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars
FROM documents GROUP BY md5(text)""")
def dedupe_last(spark, sf):
    """Exact-copy dedupe, the last document (largest id) of each text wins."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))
    return finish(U.dedupe_last(d, "digest", "doc_id").select("doc_id", "lang", "n_chars"))


@query("allowlist_join", sql="""
SELECT l.doc_id, d.lang, d.n_chars, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def allowlist_join(spark, sf):
    """List-driven inner join of the labelled ids with the corpus."""
    allow = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return finish(U.allowlist_join(allow, d, "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic"))


_TOK_SQL = r"""
tk AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents)),
cnt AS (SELECT doc_id, 'roberta' AS tokenizer,
               sum(CAST(ceil((length(token) + CASE WHEN pos > 0 THEN 1 ELSE 0 END) / 4.0) AS BIGINT)) AS n
        FROM tk GROUP BY doc_id
        UNION ALL
        SELECT doc_id, 'bert', sum(CAST(ceil(length(token) / 3.0) AS BIGINT)) FROM tk GROUP BY doc_id)"""


@query("length_filter", sql="WITH " + _TOK_SQL + """
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS max_subtokens, coalesce(max(n), 0) + 2 <= 512 AS keep
FROM documents d LEFT JOIN cnt ON cnt.doc_id = d.doc_id GROUP BY d.doc_id""")
def length_filter(spark, sf):
    """Sub-token length filter under every tokenizer."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+", -1), lambda x: x != "")
    out = U.length_filter(d, subtokens(words))
    return finish(out.select("doc_id", "max_subtokens", "keep"))


_CAP_SQL = """
cap AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':123'), doc_id) AS rn
        FROM documents),
capped AS (SELECT * FROM cap WHERE rn <= 20000),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM capped),
lim AS (SELECT *, ceil(n * 0.2 - 1e-9) AS n_test FROM sized),
lim2 AS (SELECT *, ceil((n - n_test) * 0.125 - 1e-9) AS n_valid FROM lim),
splits AS (SELECT doc_id, lang, rn, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_valid THEN 'valid'
                  ELSE 'train' END AS split FROM lim2)"""


def splits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return U.assign_splits(U.sample_cap(d, "doc_id"))


@query("sample_cap", sql="WITH " + _CAP_SQL + " SELECT doc_id, lang, rn FROM capped")
def sample_cap(spark, sf):
    """S3: seeded shuffle, first 20 000 per language."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return finish(U.sample_cap(d, "doc_id"))


@query("sample_cap_40", sql="WITH " + _CAP_SQL + " SELECT doc_id, lang, rn FROM capped WHERE rn <= 40")
def sample_cap_40(spark, sf):
    """S3 with a cap that cuts: the first 40 of each language's shuffle."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return finish(U.sample_cap(d, "doc_id", cap=40))


@query("split_counts", sql="WITH " + _CAP_SQL + " SELECT lang, split, count(*) AS n FROM splits GROUP BY lang, split")
def split_counts(spark, sf):
    """Exact-count 70/20/10 split sizes per language."""
    return finish(splits(spark, sf).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n")))


@query("holdout_union", sql="""
SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE lang NOT IN ('de') GROUP BY lang""")
def holdout_union(spark, sf):
    """Hold one language out, all the others together, in one scan."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    u = U.exclude_langs(d, ["de"])
    return finish(u.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")))


@query("clean_dispatch", sql=rf"""
WITH src AS (SELECT doc_id, text, (['java', 'javascript', 'go', 'php', 'c', 'python', 'ruby'])[(doc_id % 7) + 1] AS lang FROM documents),
env AS (SELECT doc_id, lang, CASE lang WHEN 'java' THEN '{C.JAVA_PREFIX}' || text || '{C.JAVA_SUFFIX}'
               WHEN 'php' THEN CASE WHEN starts_with(text, '{C.PHP_OPEN}') THEN '' ELSE '{C.PHP_OPEN}' || chr(10) END || text
                               || CASE WHEN ends_with(text, '{C.PHP_CLOSE}') THEN '' ELSE chr(10) || '{C.PHP_CLOSE}' END
               ELSE text END AS code FROM src),
cl AS (SELECT doc_id, lang, CASE WHEN lang IN ('java', 'javascript', 'go') THEN regexp_replace(code, '{_JAVA_JS_SQL}', '\1', 'g')
              WHEN lang IN ('php', 'c') THEN regexp_replace(list_reduce(list_prepend(code, regexp_extract_all(code, '{_PHP_C_SQL}', 2)),
                                             lambda acc, x: replace(acc, coalesce(x, ''), '')), '{_HASH_SQL}', '', 'g')
              ELSE code END AS c FROM env)
SELECT doc_id, lang, strlen(c)::BIGINT AS n_after, md5(c) AS digest FROM cl""")
def clean_dispatch(spark, sf):
    """Envelope and comment stripping of every language, the documents dealt over the languages by id."""
    names = F.array(*[F.lit(x) for x in ("java", "javascript", "go", "php", "c", "python", "ruby")])
    d = table(spark, sf, "documents").select(
        "doc_id", "text", F.element_at(names, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("lang"))
    c = C.clean_code(F.col("text"), F.col("lang"))
    return finish(d.select("doc_id", "lang", F.octet_length(c).alias("n_after"), F.md5(c).alias("digest")))


@query("curated_rows", sql=r"""
WITH clean AS (SELECT page_id, regexp_replace(html, '""" + St.MARKUP_SKIPPED + r"""', '', 'g') AS h FROM pages),
parts AS (SELECT page_id, list_transform(regexp_extract_all(h, '</?[a-zA-Z][a-zA-Z0-9]*'), lambda t: lower(t)) AS tags,
                 list_filter(string_split_regex(regexp_replace(h, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM clean),
read AS (SELECT page_id, ws, list_reduce(tags, lambda a, t: CASE
    WHEN a.failure IS NOT NULL THEN a
    WHEN t IN ('<""" + "', '<".join(St.VOID) + r"""') THEN {'stack': a.stack, 'n': a.n + 1, 'bad': a.bad, 'failure': a.failure}
    WHEN NOT starts_with(t, '</') THEN {'stack': list_append(a.stack, substr(t, 2)), 'n': a.n + 1,
                                        'bad': a.bad OR (t = '<b' AND list_contains(a.stack, 'b')), 'failure': a.failure}
    WHEN NOT list_contains(a.stack, substr(t, 3)) THEN {'stack': a.stack, 'n': a.n, 'bad': a.bad, 'failure': 'unexpected ' || substr(t, 3)}
    ELSE {'stack': a.stack[1:len(a.stack) - list_position(list_reverse(a.stack), substr(t, 3))], 'n': a.n, 'bad': a.bad,
          'failure': a.failure} END,
    {'stack': []::VARCHAR[], 'n': 0, 'bad': false, 'failure': NULL::VARCHAR}) AS r FROM parts),
ended AS (SELECT page_id, ws, r.n AS n, r.bad AS bad, coalesce(r.failure, 'unclosed ' || list_filter(r.stack, lambda x: x NOT IN
                 ('""" + "', '".join(St.OPEN_ENDED) + r"""'))[-1], CASE WHEN r.n = 0 THEN 'no elements' END) AS failure FROM read),
sized AS (SELECT *, greatest(
    coalesce(list_sum(list_transform(ws, lambda w, i: ceil((length(w) + CASE WHEN i > 1 THEN 1 ELSE 0 END) / 4.0))), 0),
    coalesce(list_sum(list_transform(ws, lambda w: ceil(length(w) / 3.0))), 0))::BIGINT AS max_subtokens FROM ended),
why AS (SELECT *, CASE WHEN failure IS NOT NULL THEN 'parse: ' || failure WHEN bad THEN 'error node'
                       WHEN max_subtokens + 2 > 512 THEN 'too long' END AS reason FROM sized)
SELECT page_id, CASE WHEN failure IS NULL THEN n END::BIGINT AS n_nodes, max_subtokens, reason IS NULL AS keep, reason FROM why""")
def curated_rows(spark, sf):
    """Pages that do not parse, hold an error node, are no tree or are too long, with the reason."""
    ensure_shipped(spark)
    p = table(spark, sf, "pages").select("page_id", "html")
    out = U.curated(p, U.guarded(St.parse_markup)(St.markup_tags(F.col("html"))), subtokens(St.markup_words(F.col("html"))))
    return finish(out.select("page_id", F.when(F.col("nodes").isNotNull(), F.size("nodes")).alias("n_nodes"), "max_subtokens",
                             "keep", "reason"))
