"""Registered tree queries over the shared tables.

Trees: every document is a tree document -> line -> sentence -> word, and
every customer is a tree customer -> order -> lineitem.  Predictions are the
true encodings with deterministic md5-keyed noise on the heights and on the
labels, so the decoder sees real-valued, tie-breaking input.
"""

from __future__ import annotations

from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.columns import md5_bucket
from lignum.operators import parse_trees as P
from lignum.operators import spans as S
from lignum.operators import trees as T
from lignum.plans.registry import finish, query
from lignum.sources.tables import table

DOC_DEPTH = 3


def doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return T.nest_documents(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def own_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose ids are their own, as trees to be cut in their rows (tree_id, text, lang), and the others (None for none)."""
    docs = documents(spark, sf)
    own, rest = by_own_id(docs)
    return T.spread(own, docs).select(F.col("doc_id").cast("long").alias("tree_id"), F.col("text").cast("string").alias("text"), "lang"), rest


class DocEncoding(NamedTuple):
    """Encoded document trees: sentence rows, word rows, and the views of them that queries read."""
    sents: DataFrame
    words: DataFrame
    gaps: DataFrame
    leaves: DataFrame
    spans: DataFrame


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


by_own_id = T.by_own_id


def doc_encoding(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DocEncoding:
    sents = T.document_sentences(documents(spark, sf) if docs is None else docs)
    words = T.encode_sentences(sents)
    gaps = words.where(F.col("d").isNotNull()).select("tree_id", F.col("tok").alias("gap"), "d", "c")
    return DocEncoding(sents, words, gaps, words.select("tree_id", "tok", "u"), T.sentence_spans(sents))


def doc_paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Node table and ancestor closure of the document trees."""
    return T.nest_documents(table(spark, sf, "documents").select("doc_id", "text", "lang"), with_paths=True)


def predicted(words: DataFrame) -> DataFrame:
    """Noisy prediction: d + 0.3 * (h mod 7 - 3), label 'statement' where h mod 5 = 0.

    ``h`` is the md5 bucket of ``tree_id:gap``, computed on the word rows
    (codegen'd), then packed into per-tree arrays like the true encoding.
    """
    h = md5_bucket(F.concat_ws(":", F.col("tree_id").cast("string"), F.col("tok").cast("string")))
    noisy = words.select("tree_id", "tok", (F.col("d") + (h % 7 - 3) * 0.3).alias("d"),
                         F.when(h % 5 == 0, F.lit("statement")).otherwise(F.col("c")).alias("c"), "u")
    return T.word_features(noisy)


def predicted_slice(cols: pa.RecordBatch, w: T.Levels) -> P.Forest:
    """``predicted`` of cut texts: noisy heights and labels of their gaps, and the labels of their words."""
    d, c, u = T.encoded(w)
    gap = np.flatnonzero(d >= 0)
    ids, tok = cols.column("tree_id").to_pylist(), w.tok[gap]
    names = (f"{ids[r]}:{t}".encode() for r, t in zip(w.row[gap].tolist(), tok.tolist(), strict=True))
    h = np.fromiter((int(md5(x).hexdigest()[:6], 16) for x in names), np.int64, len(gap))
    label = np.where(h % 5 == 0, T.LABELS.index("statement"), c[gap])
    # a document without words is a leaf
    leaves = np.searchsorted(w.row, w.bare)
    return P.Forest(np.bincount(w.row[gap], minlength=len(w.size)), d[gap] + (h % 7 - 3) * 0.3, label, np.insert(u, leaves, 0))


def restored_slice(cols: pa.RecordBatch, w: T.Levels):
    """C11-C14 of cut texts: their predictions as binary trees, and the trees that these stand for."""
    yield P.restored(predicted_slice(cols, w), cols.column("tree_id"))


# --------------------------------------------------------------------------
# DuckDB oracle fragments (independent level-wise statement of the same trees)
# --------------------------------------------------------------------------

DOC_CTE = r"""
d AS (SELECT doc_id AS tree_id, lang, coalesce(text, '') AS text FROM documents),
l0 AS (SELECT tree_id, lang, strlen(text) AS tlen,
              unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS li FROM d),
l1 AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY tree_id ORDER BY li
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lstart FROM l0),
w0 AS (SELECT tree_id, lang, tlen, li, lstart, unnest(string_split(line, ' ')) AS word,
              generate_subscripts(string_split(line, ' '), 1) - 1 AS wi FROM l1),
w1 AS (SELECT *, coalesce(sum(strlen(word) + 1) OVER wb, 0) AS woff,
              coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER wb, 0) AS si
       FROM w0 WINDOW wb AS (PARTITION BY tree_id, li ORDER BY wi
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT tree_id, lang, tlen, li, si, wi, word, lstart + woff AS start,
             lstart + woff + strlen(word) AS "end",
             row_number() OVER (PARTITION BY tree_id, li, si ORDER BY wi) AS wj,
             row_number() OVER (PARTITION BY tree_id ORDER BY li, wi) - 1 AS tok
      FROM w1 WHERE strlen(word) > 0),
s0 AS (SELECT tree_id, li, si, min(start) AS start, max("end") AS "end", count(*) AS k,
              arg_max(word, wi) AS last, bool_or(contains(word, '"')) AS q,
              min(tok) AS lo, max(tok) AS hi
       FROM w GROUP BY tree_id, li, si),
s1 AS (SELECT *, CASE WHEN q THEN 'string_literal' WHEN suffix(last, '?') THEN 'question'
                      WHEN suffix(last, '!') THEN 'exclamation' WHEN suffix(last, '.') THEN 'statement'
                      ELSE 'fragment' END AS type, si + 1 AS j FROM s0),
ln0 AS (SELECT tree_id, li, min(start) AS start, max("end") AS "end", count(*) AS k,
               min(lo) AS lo, max(hi) AS hi FROM s1 GROUP BY tree_id, li),
ln AS (SELECT *, dense_rank() OVER (PARTITION BY tree_id ORDER BY li) AS j FROM ln0),
rt AS (SELECT tree_id, any_value(tlen) AS tlen, count(*) AS k, min(lo) AS lo, max(hi) AS hi
       FROM ln JOIN (SELECT DISTINCT tree_id, tlen FROM w) USING (tree_id) GROUP BY tree_id),
bare AS (SELECT tree_id, lang, strlen(text) AS tlen FROM d WHERE NOT regexp_matches(text, '[^ \n]'))
"""

NODES_CTE = DOC_CTE + r""",
nn AS (
  SELECT tree_id, 0 AS depth, NULL::BIGINT AS li, NULL::BIGINT AS si, 0 AS start, tlen AS "end",
         'document' AS type, false AS is_terminal FROM rt
  UNION ALL SELECT tree_id, 0, NULL, NULL, 0, tlen, 'document', false FROM bare
  UNION ALL SELECT tree_id, 1, li, NULL, start, "end", 'line', false FROM ln
  UNION ALL SELECT tree_id, 2, li, si, start, "end", type, false FROM s1
  UNION ALL SELECT tree_id, 3, li, si, start, "end", 'word', true FROM w),
ni AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY start, depth) - 1 AS node_id FROM nn),
nodes AS (
  SELECT n.tree_id, n.node_id,
         CASE n.depth WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN pl.node_id ELSE ps.node_id END AS parent_id,
         n.type, n.is_terminal, n.start, n."end", n.depth
  FROM ni n
  LEFT JOIN ni pl ON n.depth = 2 AND pl.depth = 1 AND pl.tree_id = n.tree_id AND pl.li = n.li
  LEFT JOIN ni ps ON n.depth = 3 AND ps.depth = 2 AND ps.tree_id = n.tree_id AND ps.li = n.li AND ps.si = n.si)
"""

GAPS_CTE = DOC_CTE + r""",
lc AS (SELECT ln.*, rt.k AS kt,
              CASE WHEN rt.k = 1 THEN 0 ELSE least(ln.j, rt.k - 1) END AS cost,
              CASE WHEN rt.k = 1 THEN 'document<sep>line' ELSE 'line' END AS chain
       FROM ln JOIN rt USING (tree_id)),
sc AS (SELECT s1.*, lc.k AS kl, lc.chain AS lchain,
              CASE WHEN lc.k = 1 THEN 0 ELSE least(s1.j, lc.k - 1) END AS cost,
              CASE WHEN lc.k = 1 THEN lc.chain || '<sep>' || s1.type ELSE s1.type END AS chain,
              CASE WHEN s1.k = 1 THEN 0 ELSE s1.k - 1 END AS h
       FROM s1 JOIN lc USING (tree_id, li)),
ssm AS (SELECT tree_id, li, j, max(cost + h) OVER (PARTITION BY tree_id, li ORDER BY j DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smax FROM sc),
lh AS (SELECT tree_id, li, max(cost + h) AS h FROM sc GROUP BY tree_id, li),
lsm AS (SELECT lc.tree_id, lc.li, lc.j, max(lc.cost + lh.h) OVER (PARTITION BY lc.tree_id ORDER BY lc.j DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smax
        FROM lc JOIN lh USING (tree_id, li)),
wt AS (SELECT w.tree_id, w.lang, w.tok, w.li, w.si, w.wj, sc.k AS ks, sc.chain AS schain, sc.j AS sj,
              lc.j AS lj, lc.chain AS lchain,
              lead(w.li) OVER (PARTITION BY w.tree_id ORDER BY w.tok) AS nli,
              lead(w.si) OVER (PARTITION BY w.tree_id ORDER BY w.tok) AS nsi
       FROM w JOIN sc USING (tree_id, li, si) JOIN lc USING (tree_id, li)),
gaps AS (
  SELECT wt.tree_id, wt.lang, wt.tok AS gap,
         CASE WHEN wt.nli = wt.li AND wt.nsi = wt.si THEN wt.ks - wt.wj
              WHEN wt.nli = wt.li THEN ssm.smax - (wt.sj - 1)
              ELSE lsm.smax - (wt.lj - 1) END AS d,
         CASE WHEN wt.nli = wt.li AND wt.nsi = wt.si THEN CASE WHEN wt.wj = 1 THEN wt.schain ELSE '<empty>' END
              WHEN wt.nli = wt.li THEN CASE WHEN wt.sj = 1 THEN wt.lchain ELSE '<empty>' END
              ELSE CASE WHEN wt.lj = 1 THEN 'document' ELSE '<empty>' END END AS c
  FROM wt
  LEFT JOIN ssm ON ssm.tree_id = wt.tree_id AND ssm.li = wt.li AND ssm.j = wt.sj
  LEFT JOIN lsm ON lsm.tree_id = wt.tree_id AND lsm.j = wt.lj
  WHERE wt.nli IS NOT NULL),
unary AS (SELECT tree_id, lang, tok, CASE WHEN ks = 1 THEN schain ELSE '<empty>' END AS u FROM wt
          UNION ALL SELECT tree_id, lang, 0, '<empty>' FROM bare),
tspans AS (
  SELECT tree_id, 'document' AS label, lo, hi FROM rt
  UNION ALL SELECT tree_id, 'line', lo, hi FROM ln
  UNION ALL SELECT tree_id, type, lo, hi FROM s1),
langs AS (SELECT DISTINCT tree_id, lang FROM w)
"""



def decode_score_sql(pg: str, pu: str) -> str:
    """Oracle CTEs decoding predicted gaps ``pg(tree_id, gap, d, c)`` and unary
    labels ``pu(tree_id, tok, u)`` (nearest greater gap by self-join) and
    scoring them against ``tspans``: defines pspans, tset, scores, rl."""
    return f""",
ng AS (SELECT tree_id, count(*) AS n FROM {pg} GROUP BY tree_id),
pl AS (SELECT a.tree_id, a.gap, max(b.gap) AS l FROM {pg} a JOIN {pg} b
       ON a.tree_id = b.tree_id AND b.gap < a.gap AND b.d >= a.d GROUP BY a.tree_id, a.gap),
pr AS (SELECT a.tree_id, a.gap, min(b.gap) AS r FROM {pg} a JOIN {pg} b
       ON a.tree_id = b.tree_id AND b.gap > a.gap AND b.d > a.d GROUP BY a.tree_id, a.gap),
pnode AS (SELECT g.tree_id, g.gap, g.c, coalesce(pl.l, -1) + 1 AS lo, coalesce(pr.r, ng.n) AS hi,
                 pl.l IS NULL AND pr.r IS NULL AS is_root
          FROM {pg} g JOIN ng USING (tree_id)
          LEFT JOIN pl USING (tree_id, gap) LEFT JOIN pr USING (tree_id, gap)),
praw AS (SELECT tree_id, CASE WHEN c = '<empty>' THEN 'bad_root' ELSE c END AS label, lo, hi
         FROM pnode WHERE c <> '<empty>' OR is_root
         UNION ALL SELECT tree_id, u, tok, tok FROM {pu} WHERE u <> '<empty>'),
pspans AS (SELECT tree_id, unnest(string_split(label, '<sep>')) AS label, lo, hi FROM praw),
tset AS (SELECT DISTINCT tree_id, label, lo, hi FROM tspans),
hits AS (SELECT p.tree_id, count(*) AS hit FROM pspans p
         WHERE EXISTS (SELECT 1 FROM tset t WHERE t.tree_id = p.tree_id AND t.label = p.label
                       AND t.lo = p.lo AND t.hi = p.hi) GROUP BY p.tree_id),
cnt AS (SELECT t.tree_id, t.n_true, p.n_pred, coalesce(h.hit, 0) AS hit
        FROM (SELECT tree_id, count(*) AS n_true FROM tspans GROUP BY tree_id) t
        JOIN (SELECT tree_id, count(*) AS n_pred FROM pspans GROUP BY tree_id) p USING (tree_id)
        LEFT JOIN hits h USING (tree_id)),
sc3 AS (SELECT tree_id, hit / n_pred AS p, hit / n_true AS r FROM cnt),
scores AS (SELECT tree_id, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM sc3),
tl AS (SELECT tree_id, label, count(*) AS n_true FROM tspans GROUP BY tree_id, label),
hl AS (SELECT p.tree_id, p.label, count(*) AS hit FROM pspans p
       WHERE EXISTS (SELECT 1 FROM tset t WHERE t.tree_id = p.tree_id AND t.label = p.label
                     AND t.lo = p.lo AND t.hi = p.hi) GROUP BY p.tree_id, p.label),
rl AS (SELECT tl.tree_id, tl.label, coalesce(hl.hit, 0) / tl.n_true AS recall
       FROM tl LEFT JOIN hl USING (tree_id, label))"""


# md5-keyed noise, same expression as ``predicted``
PRED_CTE = GAPS_CTE + r""",
hg AS (SELECT tree_id, gap, d, c,
              ('0x' || substr(md5(tree_id::VARCHAR || ':' || gap::VARCHAR), 1, 6))::BIGINT AS h FROM gaps),
pg AS (SELECT tree_id, gap, d + (h % 7 - 3) * 0.3 AS d,
              CASE WHEN h % 5 = 0 THEN 'statement' ELSE c END AS c FROM hg)""" + decode_score_sql("pg", "unary")


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

def digest_sql(parts: str) -> str:
    """Per-tree sum of the first 32 bits of the md5 of each node's ``parts``."""
    return f"sum(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT)::BIGINT"


def node_digest(*cols: str):
    """``digest_sql`` in Spark; booleans read true / false, and a null part is left out."""
    return F.sum(md5_bucket(F.concat_ws(":", *[F.col(c).cast("string") for c in cols]), 8))


@query("doc_tree_nodes", sql="WITH " + NODES_CTE + """,
rd AS (SELECT tree_id, count(*) AS n_roots, min("end") AS root_end FROM nodes WHERE parent_id IS NULL GROUP BY tree_id)
SELECT tree_id, node_id::BIGINT AS node_id, parent_id::BIGINT AS parent_id, type, is_terminal,
       start::BIGINT AS start, "end"::BIGINT AS "end", depth::BIGINT AS depth, n_roots, root_end::BIGINT AS root_end
FROM nodes JOIN rd USING (tree_id)""")
def doc_tree_nodes(spark, sf):
    """Node table of the document trees with dense ids; every node knows how many roots its tree
    has and where the first ends."""
    own, rest = own_trees(spark, sf)
    out = T.over_slices(own, lambda: T.nodes_with_tops, T.TOP_NODES)
    if rest is not None:
        nodes = T.nest_documents(rest)
        tops = T.roots(nodes).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_roots"), F.min("end").alias("root_end"))
        out = out.unionByName(T.next_ids(nodes).join(tops, "tree_id").select(*out.columns))
    return finish(out)


@query("doc_tree_levels", sql="WITH " + GAPS_CTE + r""",
wc AS (SELECT wt.tree_id, sc.cost AS sc, lc.cost AS lcost,
              CASE WHEN wt.ks = 1 THEN 0 ELSE least(wt.wj, wt.ks - 1) END AS wc
       FROM wt JOIN sc USING (tree_id, li, si) JOIN lc USING (tree_id, li)),
lv AS (
  SELECT tree_id, 0 AS depth, 0 AS c FROM rt
  UNION ALL SELECT tree_id, 0, 0 FROM bare
  UNION ALL SELECT tree_id, 1, cost FROM lc
  UNION ALL SELECT sc.tree_id, 2, lc.cost + sc.cost FROM sc JOIN lc USING (tree_id, li)
  UNION ALL SELECT tree_id, 3, lcost + sc + wc FROM wc)
SELECT tree_id, depth::BIGINT AS depth, count(*) AS n_nodes, sum(c)::BIGINT AS sum_c, max(c)::BIGINT AS max_c
FROM lv GROUP BY tree_id, depth""")
def doc_tree_levels(spark, sf):
    """Closure depth and binary depth per level."""
    _, paths = doc_paths(spark, sf)
    return finish(paths.groupBy("tree_id", "depth").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("C").alias("sum_c"), F.max("C").alias("max_c")))


@query("tree_gaps", sql="WITH " + GAPS_CTE + " SELECT tree_id, gap::BIGINT AS gap, d::BIGINT AS d, c FROM gaps",
       headline=True)
def tree_gaps(spark, sf):
    """Gap heights and labels."""
    return finish(doc_encoding(spark, sf).gaps)


@query("tree_unary", sql="WITH " + GAPS_CTE + " SELECT tree_id, tok::BIGINT AS tok, u FROM unary WHERE u <> '<empty>'")
def tree_unary(spark, sf):
    """Unary labels of leaves (non-empty only)."""
    leaves = doc_encoding(spark, sf).leaves
    return finish(leaves.where(F.col("u") != "<empty>").select("tree_id", "tok", "u"))


@query("tree_features", sql="WITH " + GAPS_CTE + r""",
fg AS (SELECT tree_id, count(*) AS n_gaps, sum(d) AS sum_d, max(d) AS max_d,
              sum(CASE WHEN c <> '<empty>' THEN 1 ELSE 0 END) AS n_labelled,
              string_agg(d::BIGINT::VARCHAR, ' ' ORDER BY gap) AS ds, string_agg(c, ' ' ORDER BY gap) AS cs
       FROM gaps GROUP BY tree_id),
fu AS (SELECT tree_id, count(*) AS num_tokens, sum(CASE WHEN u <> '<empty>' THEN 1 ELSE 0 END) AS n_unary,
              string_agg(u, ' ' ORDER BY tok) AS us
       FROM unary GROUP BY tree_id)
SELECT fu.tree_id, num_tokens, coalesce(n_gaps, 0) AS n_gaps, sum_d::BIGINT AS sum_d, max_d::BIGINT AS max_d,
       coalesce(n_labelled, 0)::BIGINT AS n_labelled, n_unary::BIGINT AS n_unary,
       md5(coalesce(ds, '')) AS d_digest, md5(coalesce(cs, '')) AS c_digest, md5(us) AS u_digest
FROM fu LEFT JOIN fg USING (tree_id)""")
def tree_features(spark, sf):
    """Compact per-tree arrays, summarised, with digests of each whole array."""
    f = T.word_features(doc_encoding(spark, sf).words)
    digest = lambda a: F.md5(F.array_join(F.col(a).cast("array<string>"), " "))
    return finish(f.select(
        "tree_id", "num_tokens", F.size("d").alias("n_gaps"),
        F.when(F.size("d") > 0, F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sum_d"),
        F.array_max("d").alias("max_d"),
        F.size(F.filter("c", lambda x: x != "<empty>")).alias("n_labelled"),
        F.size(F.filter("u", lambda x: x != "<empty>")).alias("n_unary"),
        digest("d").alias("d_digest"), digest("c").alias("c_digest"), digest("u").alias("u_digest")))


@query("span_set", sql="WITH " + GAPS_CTE + " SELECT tree_id, label, lo::BIGINT AS lo, hi::BIGINT AS hi FROM tspans",
       headline=True)
def span_set(spark, sf):
    """Decode the encoded trees back to labelled spans."""
    return finish(S.decode(T.word_features(doc_encoding(spark, sf).words)))


@query("roundtrip_f1", sql="WITH " + GAPS_CTE + """
SELECT tree_id, 1.0::DOUBLE AS p, 1.0::DOUBLE AS r, 1.0::DOUBLE AS f1 FROM rt""")
def roundtrip_f1(spark, sf):
    """decode(encode(tree)) against the tree's own spans (all 1.0)."""
    e = doc_encoding(spark, sf)
    sc = S.span_scores(e.spans, S.decode(T.word_features(e.words)))
    return finish(sc.select("tree_id", "p", "r", "f1"))


@query("perturbed_f1_by_lang", sql="WITH " + PRED_CTE + """
SELECT l.lang, count(*) AS n_trees, round(avg(s.p), 6) AS p, round(avg(s.r), 6) AS r, round(avg(s.f1), 6) AS f1
FROM scores s JOIN langs l USING (tree_id) GROUP BY l.lang""", headline=True)
def perturbed_f1_by_lang(spark, sf):
    """Macro precision / recall / F1 per language of a noisy prediction."""
    e = doc_encoding(spark, sf)
    sc = S.span_scores(e.spans, S.decode(predicted(e.words))).where("f1 IS NOT NULL")
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("tree_id"), "lang")
    return finish(sc.join(langs, "tree_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_trees"), F.avg("p").alias("p"), F.avg("r").alias("r"),
        F.avg("f1").alias("f1")))


@query("recall_by_label", sql="WITH " + PRED_CTE + r"""
SELECT label, count(*) AS n_trees, round(avg(recall), 6) AS recall FROM rl GROUP BY label""")
def recall_by_label(spark, sf):
    """Mean per-label recall of the noisy prediction."""
    e = doc_encoding(spark, sf)
    lr = S.label_recall(e.spans, S.decode(predicted(e.words)))
    return finish(lr.groupBy("label").agg(F.count(F.lit(1)).alias("n_trees"), F.avg("recall").alias("recall")))


@query("recall_by_label_lang", sql="WITH " + PRED_CTE + r"""
SELECT rl.label || '--' || l.lang AS label_key, count(*) AS n_trees, round(avg(recall), 6) AS recall,
       md5(string_agg(rl.tree_id::VARCHAR || ':' || tl.n_true::VARCHAR || ':' || coalesce(hl.hit, 0)::VARCHAR, ' '
                      ORDER BY rl.tree_id)) AS samples
FROM rl JOIN langs l USING (tree_id) JOIN tl USING (tree_id, label) LEFT JOIN hl USING (tree_id, label)
GROUP BY rl.label, l.lang""")
def recall_by_label_lang(spark, sf):
    """Recall keyed ``label--lang``: the mean, and a digest of each key's list of samples."""
    e = doc_encoding(spark, sf)
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("tree_id"), "lang")
    lr = S.label_recall(e.spans, S.decode(predicted(e.words))).join(langs, "tree_id")
    lists = S.recall_lists(lr)
    text = F.transform("samples", lambda x: F.concat_ws(":", x["tree_id"].cast("string"), x["n_true"].cast("string"),
                                                        x["hit"].cast("string")))
    return finish(lists.select("label_key", "n_trees", "recall", F.md5(F.array_join(text, " ")).alias("samples")))


# --------------------------------------------------------------------------
# trees out of predictions
# --------------------------------------------------------------------------

# nodes of the predicted binary trees; a child shares one end of its range with its parent
PARSED_CTE = PRED_CTE + r""",
pn AS (SELECT tree_id, lo, hi, c AS type, false AS is_terminal, NULL AS unary, is_root FROM pnode
       UNION ALL SELECT tree_id, tok, tok, tok::VARCHAR, true, u, false FROM unary),
num AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY lo, hi DESC) - 1 AS node_id FROM pn),
over AS (SELECT a.tree_id, a.node_id, b.node_id AS up, b.hi - b.lo AS w FROM num a JOIN num b
         ON b.tree_id = a.tree_id AND b.lo = a.lo AND b.hi > a.hi
         UNION ALL SELECT a.tree_id, a.node_id, b.node_id, b.hi - b.lo FROM num a JOIN num b
         ON b.tree_id = a.tree_id AND b.hi = a.hi AND b.lo < a.lo),
par AS (SELECT tree_id, node_id, arg_min(up, w) AS parent_id FROM over GROUP BY tree_id, node_id),
parsed AS (SELECT num.*, par.parent_id FROM num LEFT JOIN par USING (tree_id, node_id))"""


def parsed_trees(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, sf) if docs is None else docs
    return P.parse_nodes(predicted(doc_encoding(spark, sf, docs).words), parts=T.parts_of(docs, F.octet_length("text")))


@query("parse_tree_nodes", sql="WITH " + PARSED_CTE + """
SELECT tree_id, count(*) AS n_nodes, """ + digest_sql("node_id, parent_id, type, is_terminal, lo, hi + 1, unary") + """ AS digest
FROM parsed GROUP BY tree_id""")
def parse_tree_nodes(spark, sf):
    """C11: the noisy predictions as binary trees: a digest of every node table."""
    n = parsed_trees(spark, sf)
    return finish(n.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), node_digest(
        "node_id", "parent_id", "type", "is_terminal", "start", "end", "unary").alias("digest")))


@query("restored_tree_nodes", sql="WITH " + PARSED_CTE + r""",
kept AS (SELECT tree_id, node_id, lo, hi, is_terminal, unary, CASE WHEN type = '<empty>' THEN 'bad_root' ELSE type END AS type
         FROM num WHERE is_terminal OR type <> '<empty>' OR is_root),
cov AS (SELECT a.tree_id, a.node_id, arg_min(b.node_id, b.hi - b.lo) AS parent_id FROM kept a JOIN kept b
        ON b.tree_id = a.tree_id AND NOT b.is_terminal AND b.lo <= a.lo AND b.hi >= a.hi AND b.node_id <> a.node_id
        GROUP BY a.tree_id, a.node_id),
con AS (SELECT k.*, c.parent_id, is_terminal AND unary <> '<empty>' AS lab FROM kept k LEFT JOIN cov c USING (tree_id, node_id)),
una AS (SELECT *, max(node_id) OVER (PARTITION BY tree_id) + sum(CASE WHEN lab THEN 1 ELSE 0 END)
               OVER (PARTITION BY tree_id ORDER BY node_id) AS fresh FROM con),
unr AS (SELECT tree_id, node_id, CASE WHEN lab THEN fresh ELSE parent_id END AS parent_id, type, is_terminal, lo, hi FROM una
        UNION ALL SELECT tree_id, fresh, parent_id, unary, false, lo, hi FROM una WHERE lab),
spl AS (SELECT *, CASE WHEN is_terminal THEN [type] ELSE string_split(type, '<sep>') END AS parts FROM unr),
spn AS (SELECT *, max(node_id) OVER (PARTITION BY tree_id) + 1 + sum(len(parts) - 1)
               OVER (PARTITION BY tree_id ORDER BY node_id) - (len(parts) - 1) AS base FROM spl),
spx AS (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM spn),
res AS (SELECT tree_id, CASE WHEN i = len(parts) - 1 THEN node_id ELSE base + i END::BIGINT AS node_id,
               CASE WHEN i = 0 THEN parent_id ELSE base + i - 1 END::BIGINT AS parent_id, part AS type, is_terminal, lo, hi FROM spx)
SELECT tree_id, count(*) AS n_nodes, """ + digest_sql("node_id, parent_id, type, is_terminal, lo, hi + 1") + """ AS digest
FROM res GROUP BY tree_id""")
def restored_tree_nodes(spark, sf):
    """Fillers contracted, unary labels and fused chains inserted: a digest of every node table."""
    own, rest = own_trees(spark, sf)
    n = T.over_slices(own, lambda: restored_slice, P.RESTORED)
    if rest is not None:
        n = n.unionByName(P.restore(parsed_trees(spark, sf, rest)).select(*n.columns))
    return finish(n.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), node_digest(
        "node_id", "parent_id", "type", "is_terminal", "start", "end").alias("digest")))


# --------------------------------------------------------------------------
# relational trees and tree edits
# --------------------------------------------------------------------------

ORDER_CTE = r"""
ordr AS (SELECT o_custkey AS tree_id, o_orderkey, 'order_' || lower(o_orderstatus) AS type FROM orders
         WHERE o_custkey IN (SELECT c_custkey FROM customer)),
li AS (SELECT o.tree_id, o.o_orderkey, l_linenumber,
              row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS j,
              count(*) OVER (PARTITION BY o.o_orderkey) AS k
       FROM lineitem JOIN ordr o ON l_orderkey = o.o_orderkey),
nk AS (SELECT o_orderkey, count(*) AS k FROM li GROUP BY o_orderkey),
oc AS (SELECT o.*, row_number() OVER (PARTITION BY tree_id ORDER BY o_orderkey) AS j,
              count(*) OVER (PARTITION BY tree_id) AS kt, coalesce(nk.k, 0) AS k
       FROM ordr o LEFT JOIN nk USING (o_orderkey)),
oc2 AS (SELECT *, CASE WHEN kt = 1 THEN 0 ELSE least(j, kt - 1) END AS cost,
               CASE WHEN k <= 1 THEN 0 ELSE k - 1 END AS h,
               CASE WHEN kt = 1 THEN 'customer<sep>' || type ELSE type END AS chain FROM oc),
osm AS (SELECT tree_id, j, max(cost + h) OVER (PARTITION BY tree_id ORDER BY j DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smax FROM oc2),
lv AS (SELECT oc2.tree_id, oc2.o_orderkey, li.l_linenumber, li.j AS ij, oc2.k, oc2.j AS oj, oc2.chain
       FROM oc2 LEFT JOIN li USING (o_orderkey)),
seq AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY tree_id ORDER BY o_orderkey, ij NULLS FIRST) AS nxt,
               row_number() OVER (PARTITION BY tree_id ORDER BY o_orderkey, ij NULLS FIRST) - 1 AS tok
        FROM lv),
ogaps AS (SELECT s.tree_id, s.tok AS gap,
                 CASE WHEN s.nxt = s.o_orderkey THEN s.k - s.ij ELSE m.smax - (s.oj - 1) END AS d,
                 CASE WHEN s.nxt = s.o_orderkey THEN CASE WHEN s.ij = 1 THEN s.chain ELSE '<empty>' END
                      ELSE CASE WHEN s.oj = 1 THEN 'customer' ELSE '<empty>' END END AS c
          FROM seq s LEFT JOIN osm m ON m.tree_id = s.tree_id AND m.j = s.oj
          WHERE s.nxt IS NOT NULL)
"""


@query("order_tree_gaps", sql="WITH " + ORDER_CTE + """
SELECT tree_id, gap::BIGINT AS gap, d::BIGINT AS d, c FROM ogaps""")
def order_tree_gaps(spark, sf):
    """C1 (relational), C6-C9: customer -> order -> lineitem."""
    nodes = T.nest_orders(table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    gaps, _ = T.encode(nodes, max_depth=2)
    return finish(gaps)


@query("order_binary_nodes", sql="WITH " + r"""
ordr AS (SELECT c_custkey AS tree_id, o_orderkey, 'order_' || lower(o_orderstatus) AS type,
                row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS j, count(*) OVER (PARTITION BY c_custkey) AS kt
         FROM orders JOIN customer ON o_custkey = c_custkey),
item AS (SELECT o.*, 'item_' || lower(l_returnflag) AS itype,
                row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ij,
                count(*) OVER (PARTITION BY o.o_orderkey) AS k
         FROM ordr o JOIN lineitem ON l_orderkey = o.o_orderkey),
oc AS (SELECT o.*, 4294967296 * o.j AS id, coalesce(n.k, 0) AS k FROM ordr o
       LEFT JOIN (SELECT o_orderkey, count(*) AS k FROM lineitem JOIN ordr ON l_orderkey = o_orderkey GROUP BY 1) n USING (o_orderkey)),
tops AS (
  SELECT c_custkey AS tree_id, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 1 AS j, 1 AS kp,
         'customer' || coalesce('<sep>' || oc.type, '') AS type, coalesce(oc.k = 1, false) AS is_terminal, 0::BIGINT AS start
  FROM customer LEFT JOIN oc ON oc.tree_id = c_custkey AND oc.kt = 1
  UNION ALL SELECT tree_id, id, 0, j, kt, type, k = 1, id FROM oc WHERE kt > 1
  UNION ALL SELECT tree_id, 4294967296 * j + ij, CASE WHEN kt = 1 THEN 0 ELSE 4294967296 * j END, ij, k, itype, true,
                   4294967296 * j + ij FROM item WHERE k > 1),
ext AS (SELECT *, CASE WHEN parent_id IS NOT NULL AND kp > 2 THEN kp - 2 ELSE 0 END AS extra,
               max(start + 1) OVER (PARTITION BY tree_id, parent_id) AS past,
               max(node_id) OVER (PARTITION BY tree_id) AS top FROM tops),
bas AS (SELECT *, top + 1 - extra + sum(CASE WHEN j = 1 THEN extra ELSE 0 END)
               OVER (PARTITION BY tree_id ORDER BY parent_id NULLS FIRST, j ROWS UNBOUNDED PRECEDING) + j - 2 AS filler FROM ext),
nodes AS (
  SELECT tree_id, node_id, CASE WHEN extra = 0 OR j = 1 THEN parent_id WHEN j < kp THEN filler ELSE filler - 1 END AS parent_id,
         type, is_terminal, start, start + 1 AS "end",
         CASE WHEN is_terminal AND NOT starts_with(type, 'item_') THEN type END AS unary FROM bas
  UNION ALL SELECT tree_id, filler, CASE WHEN j = 2 THEN parent_id ELSE filler - 1 END, '<empty>', false, start, past, NULL
  FROM bas WHERE extra > 0 AND j > 1 AND j < kp)
SELECT tree_id, node_id::BIGINT AS node_id, parent_id::BIGINT AS parent_id, type, is_terminal, start::BIGINT AS start,
       "end"::BIGINT AS "end", unary FROM nodes""")
def order_binary_nodes(spark, sf):
    """The binary trees of customer -> order -> lineitem, as node tables."""
    nodes = T.nest_orders(table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return finish(P.binarise(nodes))


@query("collapse_literals", sql="WITH " + NODES_CTE + r""",
lit AS (SELECT tree_id, node_id FROM nodes WHERE type = 'string_literal' AND NOT is_terminal)
SELECT n.tree_id, count(*) AS n_nodes, sum(CASE WHEN n.is_terminal OR n.type = 'string_literal' THEN 1 ELSE 0 END)::BIGINT
       AS n_terminals
FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM lit WHERE lit.tree_id = n.tree_id AND lit.node_id = n.parent_id)
GROUP BY n.tree_id""")
def collapse_literals(spark, sf):
    """C4: string-literal sentences lose their words and become terminals."""
    own, rest = own_trees(spark, sf)
    out = T.over_slices(own, lambda: T.collapsed_counts, "tree_id long, n_nodes long, n_terminals long")
    if rest is not None:
        nodes, paths = T.nest_documents(rest, with_paths=True)
        c = T.collapse_literals(nodes, paths=paths)
        out = out.unionByName(c.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_terminal").alias("n_terminals")))
    return finish(out)


@query("drop_nodes", sql="WITH " + NODES_CTE + r""",
ex AS (SELECT tree_id, node_id FROM nodes WHERE type = 'exclamation'),
kept AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.tree_id = n.tree_id AND ex.node_id = n.node_id)),
reach AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.tree_id = k.tree_id AND ex.node_id = k.parent_id))
SELECT k.tree_id, count(*) AS n_nodes, count(*) FILTER (WHERE k.parent_id IS NULL) AS n_roots,
       (SELECT count(*) FROM reach r WHERE r.tree_id = k.tree_id) AS n_reached,
       count(*) = (SELECT count(*) FROM reach r WHERE r.tree_id = k.tree_id) AS is_tree,
       bool_or(k.type = 'fragment') AS has_error
FROM kept k GROUP BY k.tree_id""")
def drop_nodes(spark, sf):
    """Drop exclamation sentences (orphaning their words), then check tree shape."""
    nodes = doc_nodes(spark, sf)
    kept = T.drop_nodes(nodes, F.col("type") == "exclamation").select(*T.NODE_COLS)
    chk = T.tree_check(kept)
    err = T.has_error(kept, "fragment")
    return finish(chk.join(err, "tree_id").select("tree_id", "n_nodes", "n_roots", "n_reached", "is_tree",
                                                   "has_error"))


@query("gap_render", sql="WITH " + GAPS_CTE + r""",
pieces AS (SELECT w.tree_id, w.tok, CASE WHEN g.c IS NULL THEN w.word
                  ELSE w.word || ' -' || g.c || ' ' || g.d::VARCHAR || '-' END AS piece
           FROM w LEFT JOIN gaps g ON g.tree_id = w.tree_id AND g.gap = w.tok),
r AS (SELECT tree_id, string_agg(piece, ' ' ORDER BY tok) AS rendered FROM pieces GROUP BY tree_id)
SELECT tree_id, strlen(rendered)::BIGINT AS n_bytes, md5(rendered) AS digest FROM r""")
def gap_render(spark, sf):
    """Token texts cut by byte range, rendered inline with their gaps."""
    own, rest = by_own_id(documents(spark, sf))
    gaps = T.sentence_gaps(doc_encoding(spark, sf, own).sents)
    r = T.render_gaps(T.tokens(T.text_trees(own, beside=gaps)))
    if rest is not None:
        r = r.unionByName(T.render_gaps(T.tokens(T.nest_documents(rest), rest), doc_encoding(spark, sf, rest).gaps))
    return finish(r.select("tree_id", F.octet_length("rendered").alias("n_bytes"), F.md5("rendered").alias("digest")))
