"""URL filter: allow and block rules, then a path-template tree per host. DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, staged

#: Segments that hold a digit, or are very long, stand for a variable wherever they occur.
VARIABLE = r"[0-9]|^.{40,}$"


def url_parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host, path, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. rules: (verdict, text), as ("block", "example.com/en/")."""
    fits = []
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r)):
        at, _, tail = text.partition("/")
        fits.append((((host == at) | host.endswith("." + at)) & path.startswith("/" + tail), text, verdict))
    pick = lambda k: functools.reduce(lambda rest, f: F.when(f[0], F.lit(f[k])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


def _grown(tree: DataFrame, min_share: float, same_z: float, min_labels: int) -> DataFrame:
    """The next branching of each node of the tree. Rows (host, seg, urls, labels, bads, prefix, at): the template of the first
    `at` segments is prefix. Segments that all of a node's rows share are taken in one step, as in a radix tree."""
    node = ["host", "prefix"]
    rows = tree.where(F.size("seg") > F.col("at"))
    left = F.slice("seg", F.col("at") + 1, F.greatest(F.size("seg") - F.col("at"), F.lit(0)))
    ends = rows.groupBy(*node).agg(F.min(left).alias("lo"), F.max(left).alias("hi"))
    same = F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y))
    shared = F.when(F.col("lo") == F.col("hi"), F.size("lo")).otherwise(F.array_position(same, False).cast("int") - 1)
    way = F.concat_ws("/", "prefix", F.when(F.col("shared") > 0, F.array_join(F.slice("lo", F.lit(1), F.col("shared")), "/")))
    ends = ends.withColumn("shared", shared).select(*node, "shared", way.alias("way"))
    rows = rows.join(ends, node).select("host", "seg", "urls", "labels", "bads", F.col("way").alias("prefix"), (F.col("at") + F.col("shared")).alias("at"))
    done, rows = rows.where(F.size("seg") == F.col("at")), rows.where(F.size("seg") > F.col("at")).withColumn("here", F.try_element_at("seg", F.col("at") + 1))
    kids = rows.groupBy(*node, "here").agg(F.sum("urls").alias("urls"), F.sum("labels").alias("labels"), F.sum("bads").alias("bads"))
    whole = kids.groupBy(*node).agg(F.sum("urls").alias("of"), F.sum("labels").alias("all_labels"), F.sum("bads").alias("all_bads"))
    wild = (F.col("here") == "*") | (F.col("urls") < min_share * F.col("of"))
    kids = kids.join(whole, node).withColumn("name", F.when(wild, "*").otherwise(F.col("here")))
    labels, bads, rest, rest_bads = F.col("l"), F.col("b"), F.col("all_labels") - F.col("l"), F.col("all_bads") - F.col("b")
    over = lambda x, y: F.try_divide(x, y)
    p = over(F.col("all_bads"), F.col("all_labels"))
    z = over(F.abs(over(bads, labels) - over(rest_bads, rest)), F.sqrt(p * (1 - p) * (over(F.lit(1), labels) + over(F.lit(1), rest))))
    mixed = (F.col("all_bads") > 0) & (F.col("all_bads") < F.col("all_labels"))
    apart = F.coalesce((labels >= min_labels) & (rest >= min_labels) & mixed & (z >= same_z), F.lit(False))
    branches = kids.groupBy(*node, "name").agg(F.sum("labels").alias("l"), F.sum("bads").alias("b"), F.max("all_labels").alias("all_labels"), F.max("all_bads").alias("all_bads")).select(*node, "name", apart.alias("apart"))
    alike = branches.where(~F.col("apart")).groupBy(*node).agg(F.count("*").alias("alike"))
    branches = branches.join(alike, node, "left").select(*node, "name", F.when(F.col("apart") | (F.col("alike") == 1), F.col("name")).otherwise("~").alias("next"))
    steps = kids.select(*node, "here", "name").join(branches, [*node, "name"]).select(*node, "here", "next")
    rows = rows.join(steps, [*node, "here"]).select("host", "seg", "urls", "labels", "bads", F.concat_ws("/", "prefix", "next").alias("prefix"), (F.col("at") + 1).alias("at"))
    return rows.unionByName(done)


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
    min_share: float = 0.02,
    same_z: float = 1.96,
    prior_weight: float = 4.0,
    min_labels: int = 5,
    reject_purity: float = 0.9,
) -> DataFrame:
    """Judge every url: the longest fitting rule decides; else its path template does.

    Returns id, host, path, rule, verdict ('allow' or 'block'), template, labelled (examples behind the template's purity)
    and purity.

    Template tree: under each host the path's segments are levels, as many as the path has (a round for each level at which
    templates still part). A segment becomes the wildcard *
    if it looks variable (VARIABLE) or its share of its parent's urls is under min_share. Labels: label_col (1 bad, 0 good,
    null unknown) where given; the rules' own verdicts otherwise. Branches of one parent are merged (as ~) unless a
    two-proportion z-test tells a branch's rate of bad urls from that of its siblings (|z| >= same_z, with min_labels labelled
    urls or more on both sides); a branch with few labels or none can't be told from its siblings, so it joins them and takes
    its evidence from their pool. The next level goes on under the merged branch. A template's purity is its rate of bad
    urls, smoothed towards the rate of all labelled urls with prior_weight; it is rejected at reject_purity. A host without
    labels has no evidence and is allowed.

    Every step is a hash aggregation with map-side combine by (host, prefix), joined back; a host with a third of all urls
    gathers only its distinct templates, and its urls meet theirs by broadcast: templates as frequent as a hundredth of all
    urls are a hundred at most. Null and odd urls have an empty host and path and are allowed unless a rule says otherwise.
    Repeated rows and ties give one result each; an empty table an empty result; other columns of pages are not read.
    """
    host, path = url_parts(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (F.col(label_col) if label_col else F.lit(None)).cast("int").alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    src = src.withColumn("rule", rule).withColumn("said", verdict)
    bad = F.col("given") if label_col else F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    segments = F.split(F.substr("path", F.lit(2)), "/")
    general = F.transform(segments, lambda s: F.when(s.rlike(VARIABLE) | (s == "~"), "*").otherwise(s))
    src = src.withColumn("bad", bad).withColumn("seg", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(general))

    # One row for each host and lexical template from here on: the tree is built on these, not on urls.
    leaves = staged(src.groupBy("host", "seg").agg(F.count("*").alias("urls"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")), "leaves")
    urls, labels, bads = leaves.agg(F.sum("urls"), F.sum("labels"), F.sum("bads")).first()
    tree = leaves.withColumn("prefix", F.lit("")).withColumn("at", F.lit(0))
    whole, old = tree.where(F.size("seg") == 0), []
    while not tree.where(F.size("seg") > F.col("at")).isEmpty():
        tree = staged(_grown(tree, min_share, same_z, min_labels), "tree")
        old.append(tree)
        whole = whole.unionByName(tree.where(F.size("seg") == F.col("at")))

    prior = (bads or 0) / labels if labels else 0.0
    nodes = whole.groupBy("host", "prefix").agg(F.sum("labels").alias("labelled"), F.sum("bads").alias("bad"))
    purity = F.when(F.col("labelled") > 0, (F.col("bad") + prior_weight * prior) / (F.col("labelled") + prior_weight)).otherwise(F.lit(prior))
    nodes = nodes.select("host", "prefix", "labelled", purity.alias("purity"))
    judged = staged(whole.select("host", "seg", "urls", "prefix").join(nodes, ["host", "prefix"]).select("host", "seg", "urls", F.struct(F.col("prefix").alias("template"), "labelled", "purity").alias("t")), "judged")
    dropped(leaves, *old)

    common = F.col("urls") * 100 >= (urls or 1)
    often = F.broadcast(judged.where(common).select(F.col("host").alias("often_host"), F.col("seg").alias("often_seg"), F.col("t").alias("often")))
    some = src.join(often, (F.col("host") == F.col("often_host")) & (F.col("seg") == F.col("often_seg")), "left")
    # What has met its template joins nothing more: keys that no host has, spread over the tasks.
    some = some.withColumn("k", F.when(F.col("often").isNull(), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("id", "path").cast("string"))))
    rest = judged.where(~common).select(F.col("host").alias("k"), F.col("seg").alias("rest_seg"), F.col("t").alias("rare"))
    some = some.alias("s")
    out = some.join(rest.alias("r"), (F.col("s.k") == F.col("r.k")) & (F.col("seg") == F.col("rest_seg")), "left").withColumn("t", F.coalesce("often", "rare"))
    final = F.coalesce(F.col("said"), F.when((F.col("t.labelled") > 0) & (F.col("t.purity") >= reject_purity), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), F.col("s.host").alias("host"), "path", "rule", final.alias("verdict"), "t.template", "t.labelled", F.round("t.purity", 6).alias("purity"))
