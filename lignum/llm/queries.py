"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lignum.llm import (collocations, conversation_repair, embedding_dedup, language_id, line_dedup, minhash, mixing,
                        packing, quality, subword_quality, suffix_dedup, toxicity, url_filter)
from lignum.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from lignum.sources.tables import table

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(s.first_doc < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


@query("op2_url_filter")
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a page's URL names its document by number; the document's labels are the page's
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,18})(?:\\.[A-Za-z]+)?/?$", 1)
    named = pages.select("page_id", number.alias("n")).selectExpr("page_id", "try_cast(n AS bigint) AS doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = (named.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")),
                           "doc_id").groupBy("page_id").agg(F.max(bad).alias("bad")))
    return url_filter.judge(pages, labelled)


@query("op3_packing")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_embedding_dedup")
def op5(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op6_mixing")
def op6(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_quality_rules")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).drop("lang")


@query("op10_minhash")
def op10(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, ws[p:p + k - 1] AS g FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM lists, range(1, 6) AS t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, g, count(*)::HUGEINT AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM lists GROUP BY lang),
cand AS (SELECT f.*, t.n FROM f JOIN totals t USING (lang) WHERE len(g) > 1),
cuts AS (
  SELECT c.lang, c.g, c.a, c.n, k, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * c.n) // (l.a * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT b.lang, b.g[s:s + m - 1] AS g, b.a FROM (
    SELECT *, unnest(range(1, len(g) - m + 2)) AS s FROM (SELECT *, unnest(range(2, len(g))) AS m FROM cand)) b),
kept AS (SELECT w.* FROM worst w WHERE NOT EXISTS (
  SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.g = w.g AND i.a >= w.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""

# A row's damage is the CRC-32 of its key, worked out bit by bit.  Each step of the recursion goes a row
# back: t[s] is the cheapest (cost, audit, repaired lines) of the rows from here on, from state s (1 nothing,
# 2 system, 3 user, 4 assistant emitted so far).
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
lucky AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)),
      4294967295::BIGINT) % 20 AS luck FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN luck = 4 THEN 'user' ELSE role END AS role,
         CASE luck WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN luck = 3 THEN [0, 1] ELSE [0] END) AS copy FROM lucky WHERE luck <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text),
                               copy) AS p,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS neighbours FROM placed),
step AS (
  SELECT conv_id, max(p) + 1 AS p,
         [{'c': 0, 'a': '', 'x': ''}, {'c': 6, 'a': 'II', 'x': chr(10) || 'user:' || chr(10) || 'assistant:'},
          {'c': 3, 'a': 'I', 'x': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 'x': ''}] AS t FROM faulty GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, list_transform([1, 2, 3, 4], lambda s: list_sort([b[s],
      {'c': b[af[s]].c + 3, 'a': 'I' || b[af[s]].a, 'x': chr(10) || nr[s] || ':' || b[af[s]].x},
      {'c': b[af[af[s]]].c + 6, 'a': 'II' || b[af[af[s]]].a,
       'x': chr(10) || nr[s] || ':' || chr(10) || nr[af[s]] || ':' || b[af[af[s]]].x}])[1]) AS t
  FROM (
    SELECT conv_id, p, af, nr, list_transform([1, 2, 3, 4], lambda s: list_sort([
        {'c': t[s].c + 4, 'a': 'D' || t[s].a, 'x': t[s].x},
        {'c': t[af[s]].c + 3 + more, 'a': 'R' || t[af[s]].a, 'x': chr(10) || nr[s] || ':' || text || t[af[s]].x},
        {'c': t[af[s]].c + more + CASE WHEN left(role, 1) = left(nr[s], 1) THEN 0 ELSE 1000000 END,
         'a': 'K' || t[af[s]].a, 'x': chr(10) || role || ':' || text || t[af[s]].x},
        {'c': t[2].c + more + CASE WHEN s = 1 AND left(role, 1) = 's' THEN 0 ELSE 1000000 END,
         'a': 'K' || t[2].a, 'x': chr(10) || role || ':' || text || t[2].x}])[1]) AS b
    FROM (
      SELECT r.conv_id, r.p, r.role, r.text, s.t, [3, 3, 4, 3] AS af, ['user', 'user', 'assistant', 'user'] AS nr,
             CASE r.fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000 END AS more
      FROM step s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.p = s.p - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE neighbours NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.t[1].c, 0)::BIGINT AS cost,
       coalesce(s.t[1].a, '') AS audit, sha256(coalesce(substr(s.t[1].x, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM a.conv_id AND s.p = 1
"""


@query("op11_conversation_repair", OP11_SQL)
def op11(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    there = rows.where("NOT lost").drop("lost")
    return conversation_repair.audits(there, present=rows.where("lost"))


@query("op12_subword_quality")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subword_quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return subword_quality.score(docs, model)


@query("op13_collocations", OP13_SQL)
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
