"""URL filters: rules, and a path-template tree for each host with smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, written
from lodestone.llm.rows import spread_join

# The rules (host, start of the path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

SUPPORT = 20
"""A segment stays apart only if at least this number of its parent's pages have it."""
ALIKE = 2.0
"""Standard errors within which a branch's purity is taken for its parent's, or for its siblings'."""
PRIOR = (2.0, 2_000.0)
"""Least and most labels that the purity of the level above counts for; how many between them is estimated."""
LEAST = 0.5


def host_of(url: Column) -> Column:
    """What follows the first :// up to the path, query or fragment, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to the query or fragment; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones come later and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path with every run of digits as one wildcard #, and long hexadecimal segments too."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "#"), "[0-9]+", "#")


def branch(*columns: str) -> Column:
    """Several columns as one key."""
    return F.concat_ws("\x01", *columns)


def purity(good: str, labelled: str, rate: Column) -> Column:
    """Share of good labels, with two more of the given rate."""
    return (F.col(good) + 2 * rate) / (F.col(labelled) + 2)


def template_tree(pages: DataFrame) -> DataFrame:
    """host, shape, template, n, labelled, good: the template of every shape, level by level.

    pages: host, shape, good (1, 0 or null). Everything works on counts of (host, shape), not on
    pages, so a host with a third of all pages is a number of rows like any other. At each level
    a parent's segments that fewer than SUPPORT pages have, or whose purity a test of two
    proportions can't tell from the parent's, become the wildcard *. The others fall to two
    sides, below and above the parent. Siblings on one side are merged into *- or *+ where the
    test can't tell one from the rest of its side; a segment that differs from these too stays
    literal. The levels end where no branch has SUPPORT pages of several shapes; what lies below
    is a * for each segment.
    """
    counts = written(pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")), "shapes")
    tree = counts.withColumn("parts", F.split("shape", "/")).withColumn("template", F.lit(""))
    level = 0
    while True:  # parts[0] is what stands before the first slash
        level += 1
        here = tree.withColumn("part", F.when(F.size("parts") > level, F.col("parts")[level])).withColumn("parent", branch("host", "template"))
        open_ = here.where("part is not null")
        parent = open_.groupBy("parent").agg(F.sum("n").alias("n_all"), F.count("*").alias("size"), F.sum("labelled").alias("l_all"), F.sum("good").alias("g_all"))
        parent = written(parent.where((F.col("n_all") >= SUPPORT) & (F.col("size") > 1)), "parents")  # no other can be told apart further down
        total = here.count()
        if parent.isEmpty():
            break
        child = open_.groupBy("parent", "part").agg(F.sum("n").alias("n_of"), F.count("*").alias("shapes"), F.sum("labelled").alias("l_of"), F.sum("good").alias("g_of")).where((F.col("n_of") >= SUPPORT) & (F.col("l_of") > 0))
        rate = (F.col("g_all") + 1) / (F.col("l_all") + 2)
        away = (purity("g_of", "l_of", rate) - rate) / F.sqrt(rate * (1 - rate) / F.col("l_of"))
        child = spread_join(child, parent, "parent", total, "inner").withColumn("away", away).where(F.abs("away") > ALIKE)
        child = written(child.withColumn("side", F.concat("parent", F.when(F.col("away") < 0, "-").otherwise("+"))), "branches")
        sides = child.groupBy("side").agg(F.sum("l_of").alias("l_side"), F.sum("g_of").alias("g_side"), F.count("*").alias("size"))
        pool = (F.col("g_side") + 1) / (F.col("l_side") + 2)
        l_rest, g_rest = F.col("l_side") - F.col("l_of"), F.col("g_side") - F.col("g_of")
        apart = F.abs(purity("g_of", "l_of", pool) - (g_rest + 2 * pool) / (l_rest + 2)) / F.sqrt(pool * (1 - pool) * (1 / F.col("l_of") + 1 / F.greatest(l_rest, F.lit(1))))
        named = spread_join(child, written(sides, "sides"), "side", total, "inner")
        named = named.select(branch("parent", "part").alias("place"), F.when((l_rest > 0) & (apart <= ALIKE), F.concat(F.lit("*"), F.right("side", F.lit(1)))).otherwise(F.col("part")).alias("segment"), F.col("shapes").alias("size"))
        segment = F.when(F.col("part").isNotNull(), F.concat(F.lit("/"), F.coalesce("segment", F.lit("*")))).otherwise("")
        here = here.withColumn("place", F.when(F.col("part").isNotNull(), branch("parent", "part")))
        tree = spread_join(here, written(named, "segments"), "place", total).select("host", "shape", "n", "labelled", "good", "parts", F.concat("template", segment).alias("template"))
        tree = written(tree, "templates")
    tree = tree.withColumn("template", F.concat("template", F.expr(f"repeat('/*', greatest(size(parts) - {level}, 0))")))
    return tree.drop("parts")


def weight(groups: DataFrame) -> float:
    """How many labels the level above counts for, from how much the groups' shares of good labels vary.

    groups: g, l, and above (the share to expect). By moments: what the shares vary beyond what
    so many labels vary by chance. Where they vary no more than that, labels say nothing about
    single groups, and the weight is PRIOR's most; the more they vary, the closer to its least.
    """
    spread = F.pow(F.col("g") / F.col("l") - F.col("above"), 2) * F.col("l")
    chance = F.col("above") * (1 - F.col("above"))
    r = groups.where("l > 0").agg(F.sum(spread - chance).alias("over"), F.sum(chance * (F.col("l") - 1)).alias("scale")).first()
    if not r.scale:
        return PRIOR[0]
    share = max((r.over or 0) / r.scale, 1e-9)
    return min(max(1 / share - 1, PRIOR[0]), PRIOR[1])


def rejected(tree: DataFrame, least: float = LEAST) -> DataFrame:
    """host, shape, size (its pages) of the shapes whose template's purity is below `least`.

    A template's purity is its share of good labels, smoothed towards its host's; the host's is
    smoothed likewise towards that of all pages. How strongly is estimated for either level.
    """
    sums = (F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    g, l = (x or 0 for x in tree.agg(*sums).first())
    everywhere = F.lit((g + 1) / (l + 1))
    hosts = written(tree.groupBy("host").agg(*sums, F.countDistinct("template").alias("size")), "hosts").withColumn("above", everywhere)
    w = weight(hosts)
    hosts = hosts.select("host", "size", ((F.col("g") + w * F.col("above")) / (F.col("l") + w)).alias("above"))
    templates = tree.groupBy("host", "template").agg(*sums, F.count("*").alias("size"))
    templates = written(spread_join(templates.withColumnRenamed("size", "shapes"), written(hosts, "hosts"), "host", tree.count()), "purity")
    w = weight(templates)
    bad = templates.where((F.col("g") + w * F.col("above")) / (F.col("l") + w) < least).select(branch("host", "template").alias("key"), F.col("shapes").alias("size"))
    shapes = spread_join(tree.select("host", "shape", "n", branch("host", "template").alias("key")), written(bad, "bad"), "key", tree.count(), "inner")
    return shapes.select("host", "shape", F.col("n").alias("size"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    The verdict is the longest fitting rule's; where none fits, block if the purity of the
    path's template is too low, else allow. Null urls and those without :// have an empty host
    and path. labels: for page ids whether a page is good (1) or bad (0); of an id with several
    labels the lowest counts, and other values and null ids don't. Repeated rows and null ids are
    kept, one row each, and all count; an empty table gives an empty one. Other columns are not read.
    """
    url = F.col("url")
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("shape", shape_of(F.col("path")))
    known = labels.select(F.col(f"`{label_id}`").alias("page_id"), F.col(f"`{label_col}`").cast("int").alias("good")).where("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.min("good").alias("good"))
    tree = template_tree(parsed.join(known, "page_id", "left").select("host", "shape", "good"))
    bad = written(rejected(tree).select(branch("host", "shape").alias("key"), "size", F.lit(True).alias("bad")), "rejected")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = spread_join(parsed.withColumn("key", branch("host", "shape")), bad, "key", parsed.count())
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
