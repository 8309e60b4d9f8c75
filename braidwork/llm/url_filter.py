"""URL filters: a path-template tree per host, judged by smoothed labelled purity.

The tree of a host is walked from the first segment on. A branch with fewer than ``MIN_COUNT`` addresses
is taken for a value of a variable segment, whatever it looks like, and joins the wildcard of its node;
what follows the wildcard is looked at again. Labelled branches of a node are then compared with each
other: from the worst share of good labels upwards, neighbours whose shares can't be told apart are merged,
the wildcard among them. A branch without labels that has enough addresses stays by itself. Each leaf is a
template. It is rejected when the share of good labels among its addresses, smoothed towards that of its
host and that towards the share of all hosts, falls below a limit. Rules given by host and path overrule
the templates. All counts cover all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored, table

#: (host, path, verdict) of the fixed rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies deeper counts as one last segment.
DEPTH = 16
#: A branch with fewer addresses is a value of a variable segment.
MIN_COUNT = 5
#: Two-proportion z value below which shares count as similar, and classes of shares that are compared.
SIMILAR, BINS = 2.58, 40
STRENGTH, MIN_PURITY = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the address is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The non-empty segments of a path, those beyond ``DEPTH`` as one."""
    parts = F.array_remove(F.split(path, "/"), "")
    rest = F.array(F.array_join(F.slice(parts, F.lit(DEPTH), F.size(parts)), "/"))
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), rest)).otherwise(parts)


def similar(classes: Column) -> Column:
    """Groups of an array of structs (bin, labelled, good), sorted: neighbours that can't be told apart go together.

    Gives structs of first bin ``low``, last bin ``high``, labelled, good and number of branches.
    """

    def step(groups, x):
        last = F.element_at(groups, -1)
        labelled, good = last["labelled"] + x["labelled"], last["good"] + x["good"]
        p = good / labelled
        spread = F.sqrt(p * (1 - p) * (1 / last["labelled"] + 1 / x["labelled"]))
        z = F.coalesce(F.try_divide(F.abs(last["good"] / last["labelled"] - x["good"] / x["labelled"]), spread), F.lit(0.0))
        one = F.struct(x["bin"].alias("low"), x["bin"].alias("high"), x["labelled"].alias("labelled"), x["good"].alias("good"), x["branches"].alias("branches"))
        both = F.struct(
            last["low"].alias("low"), x["bin"].alias("high"), labelled.alias("labelled"), good.alias("good"),
            (last["branches"] + x["branches"]).alias("branches"),
        )
        kept = F.slice(groups, F.lit(1), F.size(groups) - 1)
        return F.when(F.size(groups) == 0, F.array(one)).when(z < SIMILAR, F.concat(kept, F.array(both))).otherwise(F.concat(groups, F.array(one)))

    kind = "array<struct<low:int,high:int,labelled:bigint,good:bigint,branches:bigint>>"
    return F.aggregate(classes, F.array().cast(kind), step)


def _names(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per branch of at least ``MIN_COUNT`` addresses: host, template, _seg, its name ``_as`` and ``k``, its rows of ``tree``.

    The second table has host, template and ``_rare``, the name of a node's rare branches, where that isn't ``*``.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    branches = tree.where("_seg is not null").groupBy("host", "template", "_seg").agg(*sums, F.count("*").alias("k"))
    branches = stored(branches, "branches")
    frequent = branches.where(F.col("n") >= MIN_COUNT)
    rare = branches.where(F.col("n") < MIN_COUNT).groupBy("host", "template").agg(*sums).withColumn("_seg", F.lit(None).cast("string"))
    named = frequent.select("host", "template", "_seg", "n", "labelled", "good").unionByName(rare)
    place = F.floor(F.try_divide(F.col("good"), F.col("labelled")) * BINS).cast("int")
    named = named.withColumn("bin", place)
    classes = named.where("bin is not null").groupBy("host", "template", "bin").agg(
        F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.count("*").alias("branches")
    )
    of_node = classes.groupBy("host", "template").agg(  # at most a row per bin
        F.sort_array(F.collect_list(F.struct("bin", "labelled", "good", "branches"))).alias("c")
    )
    groups = of_node.select("host", "template", similar(F.col("c")).alias("g")).select("host", "template", F.size("g").alias("groups"), F.posexplode("g"))
    groups = groups.select("host", "template", "groups", "pos", F.inline(F.array(F.col("col"))))
    groups = groups.select("host", "template", "groups", "pos", "branches", F.explode(F.sequence("low", "high")).alias("bin"))
    joined = named.join(groups, ["host", "template", "bin"], "left").select("host", "template", "_seg", "branches", "groups", "pos")
    several = F.when(F.col("groups") > 1, F.concat(F.lit("*"), F.col("pos") + 1)).otherwise("*")
    shown = F.when(F.col("branches") > 1, several).otherwise(F.coalesce("_seg", F.lit("*")))
    joined = joined.withColumn("_as", shown)
    # Rare branches are found by their absence; where their group has another name than "*", by the node's.
    pooled = joined.where("_seg is null").select("host", "template", F.col("_as").alias("_rare"))
    out = joined.where("_seg is not null").join(branches.select("host", "template", "_seg", "k"), ["host", "template", "_seg"])
    return stored(out.select("host", "template", "_seg", "_as", "k"), "names"), stored(pooled.where("_rare <> '*'"), "pooled")


def templates(urls: DataFrame) -> DataFrame:
    """A row per ``host`` and ``path``: its ``template``, the template's ``purity``, ``verdict`` and ``rows``.

    ``urls`` has host, path and label (1 good, 0 bad, null unknown).
    """
    known = F.col("label").isNotNull().cast("bigint")
    tree = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.sum(known).alias("labelled"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0).cast("bigint")).alias("good"),
    )
    tree = stored(tree.withColumns({"segments": segments(F.col("path")), "template": F.lit("")}), "templates")
    total = tree.count()
    node = lambda: F.concat_ws("\n", "host", "template")
    for d in range(DEPTH):
        tree = tree.withColumn("_seg", F.get("segments", F.lit(d)))
        nodes = tree.where("_seg is not null").groupBy("host", "template").agg(F.sum("n").alias("all_n"))
        if not nodes.where(F.col("all_n") >= MIN_COUNT).head(1):
            break
        names, pooled = _names(tree)
        names = names.select(F.concat_ws("\n", "host", "template", "_seg").alias("_branch"), "_as", "k")
        tree = tree.withColumn("_branch", F.when(F.col("_seg").isNotNull(), F.concat_ws("\n", "host", "template", "_seg")))
        tree = join_hot(tree, names, "_branch", "k", total, ["host", "path"]).withColumn("_node", F.when(F.col("_seg").isNotNull() & F.col("_as").isNull(), node()))
        counts = tree.where("_node is not null").groupBy("_node").agg(F.count("*").alias("k"))
        rare = pooled.select(node().alias("_node"), "_rare").join(counts, "_node")
        tree = join_hot(tree, stored(rare, "rare"), "_node", "k", total, ["host", "path"])
        name = F.coalesce("_as", "_rare", F.lit("*"))
        whole = F.when(F.col("_seg").isNotNull(), F.concat_ws("/", "template", name)).otherwise(F.col("template"))
        # Written at each depth: the next one reads it several times.
        tree = stored(tree.withColumn("template", whole).select("host", "path", "n", "labelled", "good", "segments", "template"), "templates")
    else:
        d = DEPTH
    left = F.greatest(F.size("segments") - d, F.lit(0))
    tree = tree.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), left))).select("host", "path", "n", "labelled", "good", "template")
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("good").alias("h_good"))
    total = hosts.agg(F.sum("h_labelled").alias("t_labelled"), F.sum("h_good").alias("t_good"))
    prior = (F.col("t_good") + 1.0) / (F.col("t_labelled") + 2.0)
    of_host = (F.col("h_good") + STRENGTH * prior) / (F.col("h_labelled") + STRENGTH)
    purity = (F.col("good") + STRENGTH * of_host) / (F.col("labelled") + STRENGTH)
    judged = leaves.join(hosts, "host").join(F.broadcast(total)).select("host", "template", purity.alias("purity"))
    judged = judged.withColumn("verdict", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
    return tree.select("host", "path", "template", F.col("n").alias("rows")).join(judged, ["host", "template"])


def url_filter(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", label: str = "label") -> DataFrame:
    """Adds host, path, rule, verdict, template and purity to every row of ``urls``.

    ``label`` is 1, 0 or null. Addresses that are null or lack ``://`` share the empty host and path and
    are judged like any other template; very long paths are told apart whole; repeated rows count each; an
    empty table stays empty; columns with the name of a result are replaced, the others are kept.
    """
    made = ("host", "path", "rule", "verdict", "template", "purity")
    kept = [c for c in urls.columns if c not in made]
    host, path = host_and_path(F.col(url))
    rows = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept"), F.col(label).cast("int").alias("_label"), host.alias("host"), path.alias("path")
    )
    found = templates(rows.select("host", "path", F.col("_label").alias("label")))
    # A path is empty or starts with a slash, which no host has, so both together name an address.
    found = found.select(F.concat("host", "path").alias("_address"), "template", "purity", F.col("verdict").alias("_verdict"), "rows")
    rows = rows.withColumn("_address", F.concat("host", "path"))
    joined = join_hot(rows, stored(found, "addresses"), "_address", "rows", rows.count(), ["_kept"])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return joined.select(
        *[F.col("_kept")[c].alias(c) for c in kept],
        "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_verdict")).alias("verdict"), "template", "purity",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``label``: the quality of the document whose id ends their path, that is the text they show."""
    _, path = host_and_path(F.col("url"))
    shown = F.regexp_extract(path, r"([0-9]{1,18})(?:\.html)?/?$", 1)
    pages = pages.withColumn("_doc", F.try_to_number(F.nullif(shown, F.lit("")), F.lit("9" * 18)).cast("bigint"))
    counts = pages.where("_doc is not null").groupBy("_doc").agg(F.count("*").alias("k"))
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("label"))
    return join_hot(pages, stored(counts.join(known, "_doc"), "shown"), "_doc", "k", pages.count(), ["page_id", "url"]).drop("_doc")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = labelled_pages(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
