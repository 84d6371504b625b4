"""Registered vocabulary (M1-M5, J3-J5, G11, B14) and vector (V1-V8) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.constants import (LABEL_FAMILIES_CONTAINS, LABEL_FAMILY_EQUALS, LABEL_FAMILY_OTHER, LANGUAGES,
                                        TOP_LABELS)
from lignum.operators import curate as U
from lignum.operators import results as R
from lignum.operators import trees as T
from lignum.operators import vectors as V
from lignum.operators import vocab as Vo
from lignum.plans import curation as Cu
from lignum.plans import doc_trees as D
from lignum.plans.registry import finish, query
from lignum.sources.tables import table

LANG_ORDER = ["de", "en", "es", "fr"]
SPLIT_ORDER = {"train": 0, "valid": 1, "test": 2}


def occurrences(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = D.documents(spark, sf) if docs is None else docs
    # every document that is scored later, never the capped sample: no label may be missing
    sp = docs.select(F.col("doc_id").alias("tree_id"), "lang", U.hash_split(F.col("doc_id")).alias("split"))
    so = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    # sentences meet their document's language and split, and words only leave them afterwards
    sents = T.document_sentences(docs, keep=()).join(sp.withColumn("split_ord", so).drop("split"), "tree_id")
    words = T.encode_sentences(sents, keep=("lang", "split_ord"))
    # both labels of a word leave in one explode
    both = F.array_compact(F.array(
        F.when(F.col("c").isNotNull(), F.struct(F.lit("c").alias("kind"), F.col("c").alias("label"))),
        F.struct(F.lit("u").alias("kind"), F.col("u").alias("label"))))
    occ = words.select("tree_id", "lang", "split_ord", F.col("tok").alias("pos"), F.explode(both).alias("o"))
    return occ.select("o.kind", "lang", "o.label", "split_ord", F.col("tree_id").alias("sample_ord"), "pos")


def label_firsts(spark: SparkSession, sf: str) -> DataFrame:
    """``occurrences`` counted: the labels of a document whose id is its own are read in its row and no word is a row."""
    docs = D.documents(spark, sf)
    own, rest = D.by_own_id(docs)
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    own = T.spread(own, docs).select(F.col("doc_id").cast("long").alias("tree_id"), F.col("text").cast("string").alias("text"), "lang",
                                     U.hash_split(F.col("doc_id")).alias("split")).withColumn("split_ord", order)
    firsts = T.first_labels(own)
    if rest is None:
        return firsts
    more = occurrences(spark, sf, rest).groupBy("kind", "lang", "label", "split_ord", "sample_ord").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("count"))
    return firsts.unionByName(more)


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return Vo.global_vocab(Vo.local_vocab(label_firsts(spark, sf)), LANG_ORDER)


OCC_SQL = D.GAPS_CTE + r""",
hs AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR || ':123'), 1, 6))::BIGINT / 16777216.0 AS h
       FROM documents),
splits AS (SELECT doc_id, lang, CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.3 THEN 'valid' ELSE 'train' END AS split
           FROM hs),
occ AS (SELECT 'c' AS kind, s.lang, g.c AS label, CASE s.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END
               AS split_ord, g.tree_id AS sample_ord, g.gap AS pos FROM gaps g JOIN splits s ON s.doc_id = g.tree_id
        UNION ALL
        SELECT 'u', s.lang, x.u, CASE s.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, x.tree_id, x.tok
        FROM unary x JOIN splits s ON s.doc_id = x.tree_id),
firsts AS (SELECT kind, lang, label, count(*) AS count, min(split_ord * 1e15 + sample_ord * 1e6 + pos) AS f
           FROM occ GROUP BY kind, lang, label),
lv AS (SELECT kind, lang, label, row_number() OVER (PARTITION BY kind, lang ORDER BY f) - 1 AS local_id, count
       FROM firsts),
gv AS (SELECT *, label || '--' || lang AS label_key,
              row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN 0 ELSE 1 END, lang, local_id) - 1
              AS global_id FROM lv)"""


@query("vocab_local", sql="WITH " + OCC_SQL + """
SELECT kind, lang, label, local_id::BIGINT AS local_id, count FROM lv""")
def vocab_local(spark, sf):
    """M1, M2: per-language label ids by first occurrence over train, valid, test."""
    return finish(Vo.local_vocab(label_firsts(spark, sf)))


@query("vocab_global", sql="WITH " + OCC_SQL + """
SELECT kind, label_key, global_id::BIGINT AS global_id FROM gv""")
def vocab_global(spark, sf):
    """M3, M4: global ``label--lang`` ids in language order."""
    return finish(vocab(spark, sf).select("kind", "label_key", "global_id"))


@query("encode_ids", sql="WITH " + OCC_SQL + """
SELECT o.kind, o.lang, g.global_id::BIGINT AS label_id, g.label, count(*) AS n
FROM occ o JOIN gv g ON g.kind = o.kind AND g.lang = o.lang AND g.label = o.label
GROUP BY o.kind, o.lang, g.global_id, g.label""")
def encode_ids(spark, sf):
    """Labels to language-qualified ids and back."""
    v = vocab(spark, sf)
    occ = occurrences(spark, sf)

    def both_ways(kind):
        enc = Vo.encode_labels(occ.where(F.col("kind") == kind).select("lang", F.col("label").alias("orig")), v, kind,
                               label_col="orig")
        ids = enc.groupBy("lang", "label_id").agg(F.count(F.lit(1)).alias("n"))
        return Vo.decode_labels(ids, v, kind).select(F.lit(kind).alias("kind"), "lang", "label_id", "label", "n")
    return finish(both_ways("c").unionByName(both_ways("u")))


@query("label_counts_top100", sql="WITH " + D.GAPS_CTE + f"""
SELECT c AS label, count(*) AS count FROM gaps GROUP BY c ORDER BY count DESC, label LIMIT {TOP_LABELS}""")
def label_counts_top100(spark, sf):
    """The 100 most frequent gap labels."""
    gaps = D.doc_encoding(spark, sf).gaps
    return finish(R.top_k(gaps.withColumnRenamed("c", "label"), "label", TOP_LABELS))


_FAMILY_SQL = ("CASE " + " ".join(f"WHEN contains(w, '{f}') THEN '{f}'" for f in LABEL_FAMILIES_CONTAINS)
               + f" WHEN w = '{LABEL_FAMILY_EQUALS}' THEN '{LABEL_FAMILY_EQUALS}' ELSE '{LABEL_FAMILY_OTHER}' END")


@query("label_family", sql=r"""
WITH tk AS (SELECT lower(unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> ''))) AS w
            FROM documents)
SELECT """ + _FAMILY_SQL + """ AS family, count(*) AS n FROM tk GROUP BY 1""")
def label_family(spark, sf):
    """Family cascade over every (lower-cased) word."""
    t = Cu.tokens(spark, sf).select(F.lower("token").alias("w"))
    return finish(t.groupBy(R.label_family(F.col("w")).alias("family")).agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# vectors: embeddings with language = LANGUAGES[vec_id % 8]
# --------------------------------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.pmod("vec_id", F.lit(8)) + 1).cast("int"))
    return e.withColumn("lang", lang)


_VEC_SQL = f"""
ev AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec, ({"[" + ", ".join(repr(x) for x in LANGUAGES) + "]"})[(vec_id % 8) + 1] AS lang
       FROM embeddings),
en AS (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM ev),
eu AS (SELECT *, list_transform(vec, lambda x: x / nrm) AS unit FROM en)"""


@query("normalised", sql="WITH " + _VEC_SQL + """
SELECT vec_id, label::BIGINT AS label, lang, round(nrm, 6) AS norm, (generate_subscripts(unit, 1) - 1)::BIGINT AS i,
       round(unnest(unit), 6) AS x FROM eu""")
def normalised(spark, sf):
    """Unit vectors, every component, with their language split off the id."""
    return finish(vectors(spark, sf).select("vec_id", "label", "lang", V.norm(F.col("vec")).alias("norm"),
                                            F.posexplode(V.normalize(F.col("vec"))).alias("i", "x")))


_CENT_SQL = _VEC_SQL + """,
ed AS (SELECT lang, vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM ev),
cm AS (SELECT lang, i, avg(x) AS m FROM ed GROUP BY lang, i),
cents AS (SELECT lang, list(m ORDER BY i) AS centroid FROM cm GROUP BY lang)"""


@query("centroids", sql="WITH " + _CENT_SQL + """
SELECT cm.lang, n.n, (cm.i - 1)::BIGINT AS i, round(cm.m, 6) AS x
FROM cm JOIN (SELECT lang, count(*) AS n FROM ev GROUP BY lang) n USING (lang)""")
def centroids(spark, sf):
    """V6: mean vector per language, every component."""
    c = V.centroids(vectors(spark, sf), "lang")
    return finish(c.select("lang", "n", F.posexplode("centroid").alias("i", "x")))


@query("displaced", sql="WITH " + _CENT_SQL + """,
tg AS (SELECT centroid AS t FROM cents WHERE lang = 'c'),
mv AS (SELECT e.vec_id, e.lang, CASE WHEN e.lang = 'c' THEN e.vec
              ELSE list_transform(list_zip(e.vec, tg.t, c.centroid), lambda z: z[1] + (z[2] - z[3])) END AS v
       FROM ev e JOIN cents c USING (lang), tg)
SELECT vec_id, lang, (generate_subscripts(v, 1) - 1)::BIGINT AS i, round(unnest(v), 6) AS x FROM mv""")
def displaced(spark, sf):
    """V8: every vector moved onto the centroid of language 'c', every component."""
    v = vectors(spark, sf)
    moved = V.displace(v, V.centroids(v, "lang"), "lang", "c")
    return finish(moved.select("vec_id", "lang", F.posexplode("vec").alias("i", "x")))


@query("knn", sql="WITH " + _VEC_SQL + """,
ud AS (SELECT label, vec_id, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM eu),
qm AS (SELECT label, i, avg(x) AS m FROM ud GROUP BY label, i),
q AS (SELECT label AS query, list(m ORDER BY i) AS qv FROM qm GROUP BY label),
dd AS (SELECT q.query, e.vec_id, sqrt(list_sum(list_transform(list_zip(e.unit, q.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))
              AS dist FROM eu e, q),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rank FROM dd)
SELECT query::BIGINT AS query, vec_id, round(dist, 6) AS dist, rank FROM rk WHERE rank <= 10""")
def knn(spark, sf):
    """V5: 10 nearest unit vectors to each label centroid (queries bounded by the label set)."""
    v = vectors(spark, sf).withColumn("vec", V.normalize(F.col("vec")))
    q = V.centroids(v, "label").select(F.col("label").alias("query"), F.col("centroid").alias("vec"))
    return finish(V.knn(v, q, 10))


@query("pca2")
def pca2(spark, sf):
    """V2: centred 2-D PCA of the unit vectors (sign arbitrary: no SQL oracle)."""
    v = vectors(spark, sf).withColumn("vec", V.normalize(F.col("vec")))
    p = V.pca2(v)
    return finish(p.select("vec_id", "lang", F.abs(F.col("pc")[0]).alias("abs_pc1"), F.abs(F.col("pc")[1]).alias("abs_pc2")))


# the reference's range, k from 4 to 79
ELBOW_RANGE = (4, 80)


@query("kmeans_elbow")
def kmeans_elbow(spark, sf):
    """V3, V4, V8: k-means elbow over displaced unit vectors, first 10 ids per cluster."""
    v = vectors(spark, sf)
    moved = V.displace(v, V.centroids(v, "lang"), "lang", "c").withColumn("vec", V.normalize(F.col("vec")))
    k, _costs, clustered = V.kmeans_elbow(moved, *ELBOW_RANGE)
    heads = V.cluster_heads(clustered, "label", "vec_id")
    return finish(heads.select("cluster", "pos", "vec_id", "label", F.lit(k).alias("k")))


# --------------------------------------------------------------------------
# label vectors: one centroid per (label, language) -- bounded by the label set
# --------------------------------------------------------------------------

def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).withColumn("key", F.concat_ws("--", F.col("label").cast("string"), F.col("lang")))
    c = V.centroids(v, "key").select("key", F.col("centroid").alias("vec"))
    parts = F.split("key", "--")
    return c.withColumn("label", F.get(parts, 0)).withColumn("lang", F.get(parts, 1))


_LV_SQL = _VEC_SQL + """,
lvd AS (SELECT label::VARCHAR || '--' || lang AS key, label::VARCHAR AS label, lang, unnest(vec) AS x,
               generate_subscripts(vec, 1) AS i FROM ev),
lvm AS (SELECT key, any_value(label) AS label, any_value(lang) AS lang, i, avg(x) AS m FROM lvd GROUP BY key, i),
lv AS (SELECT key, any_value(label) AS label, any_value(lang) AS lang, list(m ORDER BY i) AS vec FROM lvm GROUP BY key),
lvu AS (SELECT *, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS unit FROM lv),
lmd AS (SELECT lang, i, avg(m) AS mu FROM lvm GROUP BY lang, i),
lm AS (SELECT lang, list(mu ORDER BY i) AS mu FROM lmd GROUP BY lang)"""


@query("analogy", sql="WITH " + _LV_SQL + """,
q AS (SELECT s.label AS query, list_transform(list_zip(s.vec, t.mu, sm.mu), lambda z: z[1] + (z[2] - z[3])) AS y
      FROM lv s JOIN lm t ON t.lang = 'c' JOIN lm sm ON sm.lang = 'csharp' WHERE s.lang = 'csharp'),
qn AS (SELECT query, list_transform(y, lambda x: x / sqrt(list_sum(list_transform(y, lambda w: w * w)))) AS y FROM q),
dd AS (SELECT qn.query, u.key, u.lang,
              sqrt(list_sum(list_transform(list_zip(u.unit, qn.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
       FROM qn, lvu u),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, key) AS rank FROM dd)
SELECT query, key, round(dist, 6) AS dist, rank FROM rk WHERE rank <= 3 AND lang = 'c'""")
def analogy(spark, sf):
    """Shift each csharp label vector by the c - csharp centroid difference,
    normalise, take its 3 nearest unit label vectors and keep the c ones."""
    lv = label_vectors(spark, sf).persist()
    mu = V.centroids(lv, "lang")
    rows = {r.lang: r.centroid for r in mu.where(F.col("lang").isin("c", "csharp")).collect()}
    shift = F.array(*[F.lit(float(a - b)) for a, b in zip(rows["c"], rows["csharp"])])
    q = (lv.where(F.col("lang") == "csharp")
         .select(F.col("label").alias("query"), V.normalize(V.add(F.col("vec"), shift)).alias("vec")))
    units = lv.select(F.col("key").alias("vec_id"), V.normalize(F.col("vec")).alias("vec"), "lang")
    nn = V.knn(units, q, 3)
    return finish(nn.join(units.select(F.col("vec_id"), "lang"), "vec_id").where(F.col("lang") == "c")
                  .select("query", F.col("vec_id").alias("key"), "dist", "rank"))


@query("plain_labels", sql="WITH " + OCC_SQL + """
SELECT kind, lang, count(*) AS n_plain, sum(count)::BIGINT AS n_occ FROM lv
WHERE NOT contains(label, '<empty>') AND NOT contains(label, '<sep>') GROUP BY kind, lang""")
def plain_labels(spark, sf):
    """Distinct labels without filler or fused parts, per kind and language."""
    v = Vo.local_vocab(occurrences(spark, sf))
    p = v.where(~F.col("label").contains("<empty>") & ~F.col("label").contains("<sep>"))
    return finish(p.groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("n_plain"), F.sum("count").alias("n_occ")))
