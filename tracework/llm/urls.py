"""URL filters: host and path rules, then a path-template tree per host with labelled purity.

DataFrame expressions only.  Variable segments become wildcards by their form (digits, hex, long
tokens) or by how many values stand at one place; at every level, sibling branches whose labelled
shares are statistically alike are merged; a branch without labels of its own takes the counts of
its siblings, or of the nearest ancestor that more than one labelled branch speaks for; a template
is rejected when its smoothed share of bad labels reaches a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keep

#: Fixed values: (verdict, host and path) rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of a host or path that label a page as bad where no rule judges it.
BAD_WORDS = r"(?:^|[./_-])(?:ads?|adult|bets?|betting|casino|dating|jackpot|malware|phish\w*|pills?|poker|porn\w*|spam|track(?:er|ing)?|viagra|warez|xxx)(?:[./_-]|$)"


@dataclass(frozen=True)
class Tree:
    #: A place with more values than this, each seen fewer than ``spread`` times on average, is a wildcard.
    values: int = 20
    spread: int = 5
    #: Labelled pages that a branch needs to be compared with its siblings.
    labelled: int = 5
    #: Such branches that must speak before their counts hold for siblings without labels: the labels of
    #: one branch alone are its rule's, and say nothing of the places beside it.
    branches: int = 2
    #: Standard errors within which branches count as alike.
    alike: float = 1.0
    #: Pseudo-labels, half of them bad, that every template starts with.
    smoothing: float = 2.0
    #: Smoothed share of bad labels from which a template is rejected.
    reject: float = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no ``://`` stands."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as ``struct<rule, verdict>``; null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _shape(segment: Column) -> Column:
    """A segment with what varies by form replaced: numbers, hex strings, long tokens with digits."""
    return (
        F.when(segment.rlike(r"^\d+$"), F.lit("<n>"))
        .when(segment.rlike(r"^\d+\.\w+$"), F.regexp_replace(segment, r"^\d+", "<n>"))
        .when(segment.rlike(r"^[0-9a-f-]{8,}$"), F.lit("<h>"))
        .when(segment.rlike(r"\d") & (F.length(segment) >= 12), F.lit("<t>"))
        .otherwise(segment)
    )


def _depth(seen: DataFrame) -> int:
    """How many levels can have siblings in any host, and one more.

    Below the length of a host's second longest shape there is a single branch: no wildcard, merge or other evidence.
    """
    lengths = seen.groupBy("host", F.size("shape").alias("s")).agg(F.count("*").alias("c"))
    longer = F.sum("c").over(Window.partitionBy("host").orderBy(F.desc("s")))
    return 1 + (lengths.withColumn("longer", longer).where("longer > 1").agg(F.max("s")).first()[0] or 0)


def _merged(leaf: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """``leaf`` (host, template, labelled, bad) with ``n`` and ``b``, the counts that each template is judged on.

    Level by level from the host, siblings with labels enough are merged, in the order of their
    shares, as long as each is alike to the one before, and go on as one branch.  Others take what ``given_n`` and ``given_b``
    hold: all labels below their parent if branches enough have them, else what the parent took.
    """
    none = F.lit(None).cast("bigint")
    leaf = leaf.withColumns({"n": F.col("labelled"), "b": F.col("bad"), "given_n": none, "given_b": none, "path": F.col("template")})
    for level in range(1, depth + 1):
        node = F.when(F.size("path") >= level, F.slice("path", 1, level))
        leaf = leaf.withColumn("node", node)
        nodes = leaf.where("node is not null").groupBy("host", "node").agg(F.sum("labelled").alias("own_n"), F.sum("bad").alias("own_b"))
        nodes = nodes.withColumn("parent", F.slice("node", 1, level - 1)).withColumn("strong", F.col("own_n") >= tree.labelled)
        nodes = nodes.withColumn("share", F.when(F.col("strong"), F.col("own_b") / F.col("own_n")))
        siblings = Window.partitionBy("host", "parent", "strong")
        order = siblings.orderBy("share", "node")
        n0, b0 = F.lag("own_n").over(order), F.lag("own_b").over(order)
        mean = (b0 + F.col("own_b")) / (n0 + F.col("own_n"))
        error = F.sqrt(mean * (1 - mean) * (1 / n0 + 1 / F.col("own_n")))
        apart = F.col("share") - F.lag("share").over(order) > tree.alike * error
        nodes = nodes.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
        nodes = nodes.withColumn("group", F.sum("apart").over(order))
        group, parent = Window.partitionBy("host", "parent", "strong", "group"), Window.partitionBy("host", "parent")
        nodes = nodes.withColumns(
            {
                "all_n": F.sum("own_n").over(group),
                "all_b": F.sum("own_b").over(group),
                "members": F.count("*").over(group),
                "name": F.min(F.element_at("node", level)).over(group),
                "up_n": F.sum("own_n").over(parent),
                "up_b": F.sum("own_b").over(parent),
                "speak": F.sum(F.col("strong").cast("int")).over(parent),
            }
        )
        leaf = leaf.join(nodes.drop("parent", "share", "apart", "group"), ["host", "node"], "left")
        here, strong, merged = F.col("node").isNotNull(), F.col("strong"), F.col("strong") & (F.col("members") > 1)
        new = {}
        for x in ("n", "b"):
            above = F.when(F.col("speak") >= tree.branches, F.col(f"up_{x}")).otherwise(F.col(f"given_{x}"))
            own = F.when(strong, F.col(f"all_{x}")).otherwise(F.coalesce(above, F.col(f"own_{x}")))
            new[x] = F.when(here, own).otherwise(F.col(x))
            new[f"given_{x}"] = F.when(here, F.when(merged, F.col(f"all_{x}")).when(~strong, above))
        one = F.concat(F.slice("path", 1, level - 1), F.array("name"), F.slice("path", level + 1, F.greatest(F.lit(1), F.size("path"))))
        new["path"] = F.when(here & merged, one).otherwise(F.col("path"))
        leaf = leaf.select("host", "template", "labelled", "bad", *[c.alias(x) for x, c in new.items()])
        leaf = keep(leaf, "branches")
    return leaf


def url_filter(pages: DataFrame, rules=RULES, tree: Tree = Tree(), bad_words: str = BAD_WORDS) -> DataFrame:
    """``page_id, host, path, rule, template, purity, verdict`` for every row of ``pages``.

    Labels for the tree are the pages that a rule judges (block is bad), and those whose host or path
    holds one of ``bad_words``; pages without a rule get their template's verdict, and ``allow`` where it
    has none.  One row per input row, repeated rows included; null urls and urls without ``://`` have an
    empty host and path, no rule and ``allow``; an empty table gives no rows; urls of any length and depth
    are read whole: levels go as deep as a host has siblings (``_depth``).  Other columns are left out, so clashing names do no harm.  A hot host only adds to
    partial counts: templates, not pages, are grouped by host.
    """
    host, path = split_url(F.col("url"))
    a = pages.select("page_id", host.alias("host"), path.alias("path"))
    a = a.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    a = a.withColumn("shape", F.transform(F.array_remove(F.split("path", "/"), ""), _shape))
    worded = F.when(F.concat("host", "path").rlike(bad_words), 1)
    label = F.when(F.col("m").isNotNull(), (F.col("m.verdict") == "block").cast("int")).otherwise(worded)
    seen = a.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.sum(label).alias("bad"))
    seen = keep(seen.withColumn("bad", F.coalesce("bad", F.lit(0))), "shapes")
    depth = _depth(seen)
    # level by level from the host: a place with too many values becomes a wildcard below its parent
    seen = seen.withColumn("template", F.expr("cast(array() as array<string>)"))
    for level in range(depth):
        here = F.get("shape", F.lit(level))
        counts = (
            seen.where(here.isNotNull())
            .groupBy("host", "template", here.alias("here"))
            .agg(F.sum("n").alias("n"))
            .groupBy("host", "template")
            .agg(F.count("*").alias("values"), F.sum("n").alias("pages"))
            .where((F.col("values") > tree.values) & (F.col("pages") < tree.spread * F.col("values")))
            .select("host", "template", F.lit("*").alias("wild"))
        )
        if counts.isEmpty():
            name = here
        else:
            seen, name = seen.join(counts, ["host", "template"], "left"), F.coalesce("wild", here)
        grown = F.when(here.isNull(), F.col("template")).otherwise(F.concat("template", F.array(name)))
        seen = seen.withColumn("template", grown).drop("wild")
        if name is not here:
            seen = keep(seen, "templates")  # each level reads the one above it twice
    rest = F.when(F.size("shape") > depth, F.slice("shape", depth + 1, F.greatest(F.lit(1), F.size("shape")))).otherwise(F.expr("cast(array() as array<string>)"))
    seen = seen.withColumn("template", F.concat("template", rest))
    seen = keep(seen, "templates")
    leaf = seen.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    leaf = _merged(leaf, tree, depth)
    leaf = leaf.withColumn("purity", (F.col("b") + tree.smoothing / 2) / (F.col("n") + tree.smoothing))
    judged = seen.select("host", "shape", "template").join(
        leaf.select("host", "template", "purity"), ["host", "template"]
    )
    out = a.join(judged, ["host", "shape"], "left")
    verdict = F.when(F.col("purity") >= tree.reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.concat("host", F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
        F.when(F.col("m").isNotNull(), F.col("m.verdict")).otherwise(verdict).alias("verdict"),
    )
