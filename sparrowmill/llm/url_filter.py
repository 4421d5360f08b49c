"""Operator 4 [native]: URL filters by a path-template tree.

Per host, the paths form a tree of segments. From the root down, a segment becomes a wildcard if it looks variable
(numbers, with or without an ending, long hexadecimal strings, dates), or if its branch is statistically like its
siblings: its number of bad pages differs from what their pooled rate makes expected by less than SIGMAS deviations. Each
resulting template has labelled pages; its share of bad ones is smoothed by PRIOR pages of the host's rate, itself smoothed
by the overall rate. A template whose smoothed bad share reaches REJECT is blocked.

The rules come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest one wins.

Labels: a page that a rule decides is labelled by it (block: bad), so the tree carries the rules' judgement over to like
pages of their hosts that no rule names. A table of further labels (page_id, bad) may be given.

Everything is counted on distinct (host, path) pairs, pre-aggregated, and node tables are joined by salted keys, so that
a hot host is dealt out. The tree is walked a level at a time, to the last segment of each path.

Defined cases: a null url, or one without "://", has an empty host and path. No rule fits it, and it forms a template of
its own. Pages without labels count as unlabelled; repeated labels of a page count as bad if any is, and a rule comes before
them. A template without labels of its own isn't blocked. Rules that fit one url equally long can't differ, as each is an
end of its host and a start of its path, one of which they would share. Repeated rows and page_ids are judged each, and an
empty table gives no rows. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SIGMAS = 3.0
PRIOR = 8.0
REJECT = 0.5
SALTS = 16
_VARIABLE = r"^(?:[0-9]+|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F-]{16,})(?:\.[a-z]{2,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return runtime.lower_ascii(F.regexp_extract(url, cut, 1)), F.regexp_extract(url, cut, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as host and path in one, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, word).otherwise(verdict)
    return name, verdict


def _salted_join(rows: DataFrame, nodes: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    many = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(many, [*keys, "_salt"], how).drop("_salt")


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, n_labelled, n_bad) with their template."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.withColumns({"segments": segments, "template": F.lit("")})
    done, level = None, 0
    while True:
        # paths that end here take no further step; their nodes don't count as branches
        ended = rows.where(F.size("segments") <= level).drop("segments")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where(F.size("segments") > level)
        if rows.isEmpty():
            return done
        level += 1
        raw = F.get("segments", F.lit(level - 1))
        shape = F.when(F.regexp_like(raw, F.lit(_VARIABLE)), F.concat(F.lit("*"), F.regexp_extract(raw, r"(\.[a-z]{2,5})?$", 0))).otherwise(raw)
        rows = rows.withColumn("segment", shape)
        node = rows.groupBy("host", "template", "segment").agg(F.sum("n_labelled").alias("labelled"), F.sum("n_bad").alias("bad"))
        parent = node.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("branches"))
        rate = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
        error = F.sqrt(rate * (1 - rate) * F.col("labelled") + 1)
        alike = (F.col("branches") > 1) & (F.abs(F.col("bad") - rate * F.col("labelled")) < SIGMAS * error)
        step = F.when(F.col("segment").startswith("*"), F.concat(F.lit("/"), "segment")).when(alike, "/*").otherwise(F.concat(F.lit("/"), "segment"))
        nodes = node.join(parent, ["host", "template"]).select("host", "template", "segment", step.alias("step"))
        rows = runtime.checkpointed(_salted_join(rows, nodes, ["host", "template", "segment"]).withColumn("template", F.concat("template", "step")).drop("step", "segment"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template, and the template's smoothed share of bad pages. labels:
    page_id, bad (0 or 1)."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = pages.withColumn("bad", (verdict == "block").cast("long"))
    if labels is not None:
        known = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("given"))
        marked = marked.join(known, "page_id", "left").withColumn("bad", F.coalesce("bad", "given"))
    paths = marked.groupBy("host", "path").agg(F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    named = runtime.checkpointed(templates(runtime.checkpointed(paths)))
    overall = named.agg((F.sum("n_bad") / F.greatest(F.sum("n_labelled"), F.lit(1))).alias("overall"))
    hosts = named.groupBy("host").agg(F.sum("n_labelled").alias("host_labelled"), F.sum("n_bad").alias("host_bad"))
    tree = named.groupBy("host", "template").agg(F.sum("n_labelled").alias("labelled"), F.sum("n_bad").alias("bad"))
    rate = (F.col("host_bad") + PRIOR * F.coalesce("overall", F.lit(0.0))) / (F.col("host_labelled") + PRIOR)
    share = F.when(F.col("labelled") > 0, (F.col("bad") + PRIOR * rate) / (F.col("labelled") + PRIOR)).otherwise(0.0)  # by labels of its own only
    tree = tree.join(hosts, "host").join(F.broadcast(overall)).select("host", "template", share.alias("bad_share"))  # overall: one row
    decided = _salted_join(named.select("host", "path", "template"), tree, ["host", "template"])
    own = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return pages.join(decided, ["host", "path"]).select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(runtime.read_table(spark, sf_dir, "pages"))
