"""URL filters: rules first, then a tree of path templates per host.

A url's host and path are cut out of it; of the rules that fit, the longest
decides. The urls that rules decide are the labels. Per host, all path segments
made of digits or long hexadecimal numbers become typed wildcards, and where a
node has many rare children those become ``*``, level by level from the root, so
that what is below a ``*`` counts together. Then, level by level too, branches
under one parent whose share of blocked urls does not differ significantly from
their siblings' are merged with them, subtrees and all. A template is rejected when its smoothed share of blocked
urls (smoothed towards its host, that towards the same template on all hosts,
that towards all urls) exceeds a threshold.

Defined results: null urls and urls without ``://`` have an empty host and
path and fit no rule; repeated rows are judged alike; an empty table gives an
empty result. Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, lower_ascii, materialize

#: Action and rule: host, then the beginning of the path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A node with more children than this has its rare ones generalised.
MAX_CHILDREN = 16
#: Children with a share below this are rare.
RARE = 0.05
#: Two shares differ when their distance exceeds this many standard errors.
Z = 1.96
#: Pseudo-counts of each level of smoothing, and the share from which a template is rejected.
KAPPA, THRESHOLD = 4.0, 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return rule, action


def _typed(seg: Column) -> Column:
    """A segment with its variable kind named, if it has one."""
    ext = F.regexp_extract(seg, r"(\.[a-z]{1,5})$", 1)
    stem = F.regexp_replace(seg, r"\.[a-z]{1,5}$", "")
    return (
        F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("{n}"), ext))
        .when(stem.rlike("^(?=.*[0-9])[0-9a-f-]{8,}$"), F.concat(F.lit("{h}"), ext))
        .otherwise(seg)
    )


def templates(parsed: DataFrame) -> DataFrame:
    """host, shape, template, n, labelled, blocked: one row per host and shape of (host, shape, label)."""
    is_label, is_block = F.col("label").isNotNull().cast("int"), (F.col("label") == "block").cast("int")
    shapes = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(is_label).alias("labelled"), F.sum(F.coalesce(is_block, F.lit(0))).alias("blocked"))
    shapes = materialize(shapes, "url-shapes")
    rows = shapes.select("host", "shape", "n", F.lit("").alias("prefix"), F.split("shape", "/").alias("rest"))
    seg, parts = F.element_at("rest", 1).alias("seg"), []
    while True:
        nodes = rows.groupBy("host", "prefix", seg).agg(F.sum("n").alias("n_child"), F.count(F.lit(1)).alias("shapes"))
        parents = nodes.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n_child").alias("n_parent"), F.sum("shapes").alias("shapes"))
        marks = nodes.drop("shapes").join(parents, ["host", "prefix"])
        rare = (F.col("children") > MAX_CHILDREN) & (F.col("n_child") < RARE * F.col("n_parent")) & ~F.col("seg").startswith("{")
        # where few shapes are left, no node below has many children
        marks = marks.select("host", "prefix", "seg", F.when(rare, "*").otherwise(F.col("seg")).alias("mark"), (F.col("shapes") <= MAX_CHILDREN).alias("is_last"))
        walked = rows.withColumn("seg", seg).join(marks, ["host", "prefix", "seg"])
        ends = F.col("is_last") | (F.size("rest") == 1)
        left = F.when(F.col("is_last"), F.array_join("rest", "/")).otherwise(F.col("mark"))
        walked = walked.select("host", "shape", "n", F.concat("prefix", F.when(ends, left).otherwise(F.concat("mark", F.lit("/")))).alias("prefix"), F.when(~ends, F.slice("rest", 2, F.size("rest"))).alias("rest"))
        walked = materialize(walked, "url-levels")
        parts.append(walked.where(F.col("rest").isNull()).select("host", "shape", F.col("prefix").alias("template")))
        rows = walked.where(F.col("rest").isNotNull())
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, parts).join(shapes, ["host", "shape"])


def merged(tree: DataFrame) -> DataFrame:
    """tree's host, template, labelled and blocked with n and b: the labels of the merged node that each template ends in."""
    rows = tree.select("host", "template", "labelled", "blocked", F.lit("").alias("group"), F.split("template", "/").alias("rest"))
    seg, parts = F.element_at("rest", 1).alias("seg"), []
    while True:
        nodes = rows.groupBy("host", "group", seg).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("k"))
        above = nodes.groupBy("host", "group").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.sum("k").alias("pk"))
        others_l, others_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        # without labels on either side a share is null, and the branch is merged
        pooled, own, others = F.try_divide("pb", "pl"), F.try_divide("b", "l"), F.try_divide(others_b, others_l)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("l")) + F.try_divide(F.lit(1), others_l)))
        differs = F.coalesce(F.abs(own - others) > Z * error, F.lit(False))
        nodes = nodes.join(above, ["host", "group"])
        nodes = nodes.withColumn("to", F.concat("group", F.when(differs, F.concat(F.lit("="), "seg")).otherwise(F.lit("~")), F.lit("/")))
        pools = nodes.groupBy("host", "to").agg(F.sum("l").alias("n"), F.sum("b").alias("b"))
        nodes = nodes.select("host", "group", "seg", "to", "pl", "pk").join(pools, ["host", "to"])
        walked = rows.withColumn("seg", seg).join(nodes, ["host", "group", "seg"])
        # nothing is left to compare below a node without labels or with one template
        alone, ends = F.col("pk") == 1, (F.col("pk") == 1) | (F.col("pl") == 0) | (F.size("rest") == 1)
        n, b = (F.when(alone, F.col(own)).otherwise(F.col(pool)).alias(pool) for own, pool in (("labelled", "n"), ("blocked", "b")))
        walked = walked.select("host", "template", "labelled", "blocked", F.col("to").alias("group"), F.when(~ends, F.slice("rest", 2, F.size("rest"))).alias("rest"), n, b)
        walked = materialize(walked, "url-merged")
        parts.append(walked.where(F.col("rest").isNull()).drop("group", "rest"))
        rows = walked.where(F.col("rest").isNotNull()).drop("n", "b")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def verdicts(found: DataFrame) -> DataFrame:
    """_key, n_key, learned: the verdict of each host and shape."""
    stats = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    tree = merged(found.groupBy("host", "template").agg(*stats))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    everywhere = tree.groupBy("template").agg(F.sum("labelled").alias("gl"), F.sum("blocked").alias("gb"))
    total = tree.agg(F.sum("labelled").alias("tl"), F.sum("blocked").alias("tb"))
    tree = tree.join(hosts, "host").join(everywhere, "template").crossJoin(F.broadcast(total))  # total is one row
    p = (F.col("tb") + 1) / (F.col("tl") + 2)
    for bad, all_ in ((F.col("gb"), F.col("gl")), (F.col("hb"), F.col("hl")), (F.col("b"), F.col("n"))):
        p = (bad + KAPPA * p) / (all_ + KAPPA)
    judged = tree.select("host", "template", F.when(p > THRESHOLD, "block").otherwise("allow").alias("learned"), p.alias("p_block"))
    return found.join(judged, ["host", "template"]).select(F.concat_ws("\n", "host", "shape").alias("_key"), F.col("n").alias("n_key"), "template", "learned", "p_block")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, p_block: one row for each row of pages."""
    host, path = parse(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    segs = F.split(F.regexp_replace(lower_ascii(F.col("path")), "^/|\n", ""), "/")
    shape = F.array_join(F.transform(segs, _typed), "/")
    parsed = parsed.withColumns({"rule": rule, "label": action, "shape": shape, "host": F.col("host")})
    learned = materialize(verdicts(templates(parsed.select("host", "shape", "label"))), "url-verdicts")
    total = learned.agg(F.coalesce(F.sum("n_key"), F.lit(0))).first()[0]
    rows = parsed.withColumn("_key", F.concat_ws("\n", "host", "shape"))
    rows = join_groups(rows, "_key", learned, "n_key", total)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("label", "learned").alias("verdict"), "template", "p_block")
