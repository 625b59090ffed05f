"""URL filter: list rules first, then a tree of path templates per host.

Paths are first reduced to skeletons, in which digits and long hexadecimal
runs are wildcards, and counted per host. The tree is built on these counts
level by level: under a branch with many children the rare ones become one
wildcard, and children whose labelled rates do not differ statistically are
merged. A template is rejected by its smoothed share of bad labels. The
smoothing backs off to the share of the parent branch, which starts from that of
the host, and before it to the labels that the same path has on other hosts, so a
child without labels is judged by those of its template elsewhere.

Cases: a null url, or one without ``://``, has an empty host and path. Rows
with null ids and repeated rows come back one for one. Without any label every
template is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.operators.beside import beside
from incidentkit.session import checkpoint

LEVELS = 8  # path levels that get branches of their own; what lies deeper is one more level
MANY_CHILDREN = 32  # children from which on rare ones become a wildcard
RARE = 0.01  # share of a branch below which a child is rare
SAME = 1.96  # two rates closer than this many standard errors are merged
WEIGHT = 8.0  # labels that the smoothing counts as much as
PRIOR = 0.1  # share of bad urls that is assumed without any label
REJECT = 0.5  # templates with a smoothed share from here on are rejected

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; built-in expressions only."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    host, path = (F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits.

    ``rules`` are (verdict, domain/path) pairs. They are tried from the longest
    on; of two equally long ones the first in the list wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def skeleton(path: Column) -> Column:
    """Segments with their variable parts as wildcards; levels beyond the last are joined."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[0-9a-f-]*\d)[0-9a-f][0-9a-f-]{7,}\b", "#"), r"\d+", "#"))
    return F.when(F.size(shaped) <= LEVELS, shaped).otherwise(F.concat(F.slice(shaped, 1, LEVELS), F.array(F.array_join(F.slice(shaped, LEVELS + 1, 1 << 20), "/"))))


def _merged(children: Column) -> Column:
    """Children (name, n, labelled, bad) of one branch in groups with like rates.

    They are sorted by rate; a child joins the group before it unless the two
    rates differ by SAME standard errors. Children without labels stay alone.
    """
    rate = lambda c: F.when(c["labelled"] > 0, c["bad"] / c["labelled"]).otherwise(F.lit(-1.0))
    order = lambda a, b: F.when(rate(a) < rate(b), -1).when(rate(a) > rate(b), 1).when(a["name"] < b["name"], -1).otherwise(1)
    group = "array<struct<names:array<string>,n:bigint,labelled:bigint,bad:bigint>>"

    def add(groups: Column, c: Column) -> Column:
        last = F.element_at(groups, -1)
        both = (last["bad"] + c["bad"]) / (last["labelled"] + c["labelled"])
        # One success and one failure are added, so that two pure samples of few rows do not look certain.
        p = ((last["bad"] + c["bad"]) + 1.0) / ((last["labelled"] + c["labelled"]) + 2.0)
        error = F.sqrt(p * (1 - p) * (1.0 / last["labelled"] + 1.0 / c["labelled"]))
        alike = (c["labelled"] > 0) & (last["labelled"] > 0) & (F.abs(last["bad"] / last["labelled"] - c["bad"] / c["labelled"]) < SAME * error) & both.isNotNull()
        alone = F.struct(F.array(c["name"]).alias("names"), c["n"].alias("n"), c["labelled"].alias("labelled"), c["bad"].alias("bad"))
        joined = F.struct(F.concat(last["names"], F.array(c["name"])).alias("names"), (last["n"] + c["n"]).alias("n"), (last["labelled"] + c["labelled"]).alias("labelled"), (last["bad"] + c["bad"]).alias("bad"))
        return F.when((F.size(groups) > 0) & alike, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(alone)))

    return F.aggregate(F.array_sort(children, order), F.array().cast(group), add)


def template_tree(counts: DataFrame) -> DataFrame:
    """host, segs, template and purity from counts (host, segs, n, labelled, bad) of skeletons.

    The table has one row per skeleton. A branch keeps at most MANY_CHILDREN +
    1 / RARE children by name, so what is gathered per branch is bounded.
    """
    share = lambda bad, labelled, parent: (bad + WEIGHT * parent) / (labelled + WEIGHT)
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    hosts = checkpoint(hosts.select("host", share(F.col("hb"), F.col("hl"), F.lit(PRIOR)).alias("purity")))
    tree = checkpoint(counts.join(hosts, "host").withColumn("template", F.lit("")))
    deepest = tree.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(1, deepest + 1):
        here = tree.where(F.size("segs") >= level).withColumn("name", F.get("segs", F.lit(level - 1))).withColumn("path", F.slice("segs", 1, level))
        paths = checkpoint(here.groupBy("host", "template", "name", "path").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
        everywhere = paths.groupBy("path").agg(F.sum("labelled").alias("al"), F.sum("bad").alias("ab"))
        # Labels of the same path on other hosts.
        paths = beside(paths, everywhere, ["path"]).withColumn("ol", F.col("al") - F.col("labelled")).withColumn("ob", F.col("ab") - F.col("bad"))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "ol", "ob")]
        children = checkpoint(paths.groupBy("host", "template", "name").agg(*sums))
        branches = checkpoint(children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")))
        rare = (F.col("k") > MANY_CHILDREN) & (F.col("n") < RARE * F.col("all"))
        named = checkpoint(children.join(branches, ["host", "template"]).withColumn("as", F.when(rare, "*").otherwise(F.col("name"))))
        kept = checkpoint(named.groupBy("host", "template", "as").agg(*sums))
        groups = kept.groupBy("host", "template").agg(_merged(F.collect_list(F.struct(F.col("as").alias("name"), "n", "labelled", "bad"))).alias("groups"))
        groups = groups.select("host", "template", F.explode("groups").alias("g")).select(
            "host", "template", F.explode("g.names").alias("as"), F.array_join(F.array_sort("g.names"), "|").alias("branch"), F.col("g.labelled").alias("gl"), F.col("g.bad").alias("gb")
        )
        elsewhere = checkpoint(groups.join(kept.select("host", "template", "as", "ol", "ob"), ["host", "template", "as"]))
        prior = elsewhere.groupBy("host", "template", "branch").agg(F.sum("ol").alias("ol"), F.sum("ob").alias("ob"))
        groups = elsewhere.drop("ol", "ob").join(prior, ["host", "template", "branch"])
        mapping = checkpoint(named.select("host", "template", "name", "as").join(groups, ["host", "template", "as"]).drop("as"))
        down = here.join(mapping, ["host", "template", "name"])
        down = down.withColumn("purity", share(F.col("gb"), F.col("gl"), share(F.col("ob"), F.col("ol"), F.col("purity"))))
        down = down.withColumn("template", F.concat("template", F.lit("/"), "branch"))
        tree = checkpoint(tree.where(F.size("segs") < level).unionByName(down.select(*tree.columns)))
    # A skeleton that other paths continue keeps the share of its branch.
    return tree.select("host", "segs", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row.

    ``labels`` (page_id, bad 0/1) teaches the tree. Without it the rules do:
    urls that a rule decides are the labelled ones.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), skeleton(F.col("path")).alias("segs"))
    if labels is None:
        taught = rows.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        taught = rows.join(labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    counts = checkpoint(taught.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    tree = checkpoint(template_tree(counts))
    out = rows.join(tree, ["host", "segs"])
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity")
