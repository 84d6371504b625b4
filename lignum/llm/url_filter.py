"""URL filter by path templates.

A URL is judged by rules first: a rule is a host with a path; it fits that host
and all hosts below it when the URL's path begins with the rule's path, and the
longest rule wins.

URLs without a rule are judged by the template of their path.  Per host a tree of
path segments is grown level by level from counts only:

- a branch is kept apart when its labelled share of bad URLs differs from all the
  siblings' share together: the count of bad ones lies more than ``Z`` standard errors
  (and half a URL, the continuity correction, as most numbered branches have one label)
  from what that share gives.  An only child is kept too;
- all other branches, however many, with digits or not, labelled or not, are one ``*``
  (keeping an extension);
- a template (host and generalised path) is rejected when the smoothed share of
  bad URLs among its labelled ones, ``(bad + PRIOR * base) / (n + PRIOR)`` with
  ``base`` the share over all labelled URLs, reaches ``REJECT``.

A branch is compared with its siblings' pooled counts, never with each of them.
All counts combine before the shuffle, so a host with a third of all URLs is no
hot group; levels are written to the shared folder.  A level holds only URLs that go
on; a node all of whose URLs go on alike is done at once, so there are as many levels
as the longest beginning that two different paths share.

Cases: a null URL or one without ``://`` has an empty host and path and is
allowed unless a rule fits.  A closing slash is an empty last segment, which stands by
itself.  A segment's own leading ``*`` is written ``%2A``.  Rows alike are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import UPPER, stored

# (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
Z = 2.0
PRIOR = 5.0
REJECT = 0.8


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        at, _slash, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def parsed(pages: DataFrame, id_col: str, url_col: str, rules=RULES) -> DataFrame:
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": rule, "rule_verdict": verdict})


def _segments(path: Column) -> Column:
    """Segments of a path; a closing slash is an empty last segment."""
    return F.split(F.regexp_replace(path, "^/", ""), "/", -1)


def wildcard(segment: Column) -> Column:
    """``*`` and the segment's extension."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, "(\\.[A-Za-z]{1,5})$", 1))


def literal(segment: Column) -> Column:
    """The segment itself, never mistaken for a wildcard."""
    return F.regexp_replace(segment, "^\\*", "%2A")


def kept_branches(stats: DataFrame) -> DataFrame:
    """Branches that are not merged: ``_h, _t, _c`` and ``_alone`` (all URLs of their node go on alike)."""
    named = F.col("_child") != ""
    nodes = stats.groupBy("host", "template").agg(
        F.count_if(named).alias("kinds"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("pn"),
        F.sum(F.when(named, F.col("bad_n")).otherwise(0)).alias("pb"),
        (F.min("lo") == F.max("hi")).alias("_alone"))
    rate = F.col("pb") / F.greatest("pn", F.lit(1))
    error = F.sqrt(F.col("n") * F.greatest(rate * (1 - rate), F.lit(0.01)))
    differs = (F.col("n") > 0) & (F.abs(F.col("bad_n") - F.col("n") * rate) - 0.5 > Z * error)
    return stats.join(nodes, ["host", "template"]).where(~named | (F.col("kinds") == 1) | differs).select(
        F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_child").alias("_c"), "_alone")


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (``host, path`` and ``bad``: 1, 0 or null) plus ``template``."""
    rows = urls.withColumns({"_seg": _segments(F.col("path")), "template": F.lit("")})
    done, depth = [], 0
    while True:
        rest = F.slice("_seg", F.lit(depth + 1), F.size("_seg"))
        rows = rows.withColumn("_child", F.get("_seg", F.lit(depth)))
        stats = rows.withColumn("_rest", F.xxhash64(rest)).groupBy("host", "template", "_child").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_n"),
            F.min("_rest").alias("lo"), F.max("_rest").alias("hi"))
        kept = kept_branches(stored(stats, "branches"))
        alone = F.coalesce("_alone", F.lit(False))
        step = (F.when(alone, F.array_join(F.transform(rest, literal), "/"))
                .when(F.col("_c").isNotNull(), literal(F.col("_child"))).otherwise(wildcard(F.col("_child"))))
        rows = (rows.join(kept, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))
                          & (F.col("_child") == F.col("_c")), "left")
                .withColumns({"template": F.concat("template", F.lit("/"), step),
                              "_done": alone | (F.size("_seg") <= depth + 1)})
                .drop("_h", "_t", "_c", "_alone", "_child"))
        rows = stored(rows, "urls")
        done.append(rows.where("_done").drop("_seg", "_done"))
        rows = rows.where("NOT _done").drop("_done")
        depth += 1
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``.

    ``labelled`` has ``page_id`` and ``bad`` (1 or 0; one row an id).
    """
    known = labelled.select(F.col("page_id").alias("_k"), F.col("bad").cast("long").alias("bad"))
    rows = parsed(pages, id_col, url_col, rules)
    rows = rows.join(known, F.col("page_id") == F.col("_k"), "left").drop("_k")
    rows = templates(rows)
    base = rows.agg(F.avg("bad")).first()[0] or 0.0
    per = rows.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    per = per.select("_h", "_t", ((F.col("b") + PRIOR * base) / (F.col("n") + PRIOR)).alias("purity"))
    out = rows.join(per, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    own = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"),
                      "template", "purity")
