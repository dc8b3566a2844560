"""URL filter: listed rules first, then a tree of path templates judged by labelled purity.

Every host has a tree of path segments, grown level by level with Spark aggregations. At a node, a child segment
stays a branch of its own only if it is supported (``min_support`` urls) and its labelled share of bad urls differs
from its siblings' by a two-proportion z-test; all others are merged into the wildcard ``*``: rare and variable
segments (numbers, slugs) for want of support, supported ones because they are statistically like the rest.
What is left at the end of each path is its template. A template's badness is its smoothed labelled share,
``(bad + strength * prior) / (labelled + strength)``, where the prior of a template is the smoothed share of its host
and the prior of a host is that of all labelled urls; templates above ``reject`` are blocked.

Scale: the tree is grown over distinct (host, path) rows with counts. Counts are combined before each shuffle; kept
branches join back by an equi-join which adaptive execution can split where one host has a third of all urls.
Paths deeper than ``max_depth`` segments keep their rest as one last segment. No url is skipped.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the verdict of the
template of that empty host; repeated rows are judged each; a url without labelled company falls back to the prior
and is allowed unless that is above ``reject``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages

#: (verdict, host, path): a short list given by the caller; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path behind it; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones go in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def templates(
    urls: DataFrame, max_depth: int = 8, min_support: int = 20, z: float = 2.58, strength: float = 10.0, reject: float = 0.5,
) -> DataFrame:
    """From (host, path, bad: 1, 0 or null), a row for each distinct (host, path): its template, badness and verdict."""
    stages = Stages(urls.sparkSession)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    nodes = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    ).withColumn("parts", parts).withColumn(
        "parts",
        F.when(F.size("parts") > max_depth, F.concat(
            F.slice("parts", 1, max_depth - 1), F.array(F.array_join(F.slice("parts", max_depth, 2**31 - 1), "/"))
        )).otherwise(F.col("parts")),
    ).withColumn("template", F.lit(""))
    nodes = stages.keep(nodes)
    depth = nodes.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    for level in range(depth):
        at = nodes.withColumn("segment", F.get("parts", F.lit(level)))
        inner = at.filter("segment is not null")
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = inner.groupBy("host", "template", "segment").agg(*sums)
        totals = children.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        gap = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest)
        apart = gap > z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
        kept = children.filter(F.col("n") >= min_support).join(totals, ["host", "template"]).filter(
            (F.col("labelled") > 0) & (rest > 0)
        ).filter(apart).select("host", "template", "segment", F.lit(True).alias("kept"))
        nodes = stages.keep(
            at.join(kept, ["host", "template", "segment"], "left").withColumn(
                "template",
                F.when(F.col("segment").isNull(), F.col("template"))
                .otherwise(F.concat("template", F.lit("/"), F.when(F.col("kept"), F.col("segment")).otherwise("*"))),
            ).select("host", "path", "n", "labelled", "bad", "parts", "template")
        )
    whole = nodes.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("prior"))
    smooth = lambda bad, labelled, prior: (bad + strength * prior) / (labelled + strength)
    hosts = nodes.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("labelled").alias("host_labelled"))
    # ``whole`` is one row
    hosts = hosts.crossJoin(F.broadcast(whole)).select("host", smooth(F.col("host_bad"), F.col("host_labelled"), F.col("prior")).alias("host_share"))
    judged = nodes.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled")).join(hosts, "host").select(
        "host", "template", smooth(F.col("t_bad"), F.col("t_labelled"), F.col("host_share")).alias("badness")
    )
    return nodes.select("host", "path", "template").join(judged, ["host", "template"]).select(
        "host", "path", "template", "badness", F.when(F.col("badness") > reject, "block").otherwise("allow").alias("judged")
    )


def filter_urls(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, badness) for every row."""
    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(bad_col).alias("bad"), host.alias("host"), path.alias("path"))
    rows = Stages(urls.sparkSession).keep(rows)
    rule, listed = rule_of(F.col("host"), F.col("path"), rules)
    found = templates(rows.select("host", "path", "bad"), **options)
    return rows.join(found, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(listed, F.col("judged")).alias("verdict"), "template", "badness"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the last number of a url's path is the id of the document that the page shows, whose quality label
    is the url's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    _, path = host_and_path(F.col("url"))
    shown = pages.withColumn("doc_id", F.regexp_extract(path, r"([0-9]+)[^0-9]*$", 1).try_cast("bigint"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return filter_urls(shown.join(labels, "doc_id", "left"))
