"""The inheritance graph: ancestors, children, descendants, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, fold, same_type
from lodestone.model import Snapshot
from lodestone.plans.predicates import any_contains
from lodestone.shared import shared_path

MAX_HOPS = 10_000


def ancestors(s: Snapshot, name: str) -> tuple[list[str], str]:
    """G1: the names from the node of `name` upwards, and how the chain ends: root, cycle, or broken.

    Each hop reads one node, the first of its name, so the driver holds just the chain.
    """
    chain: list[str] = []
    seen: set[str] = set()
    at = s.xml_nodes.where((F.col("name_fold") == fold(name)) | (F.col("def_name_fold") == fold(name))).orderBy(F.desc(F.col("name").isNotNull()), "id").first()
    while at is not None and len(chain) < MAX_HOPS:
        parent = at.parent_name
        if not parent:
            return chain, "root"
        if fold(parent) in seen:
            return chain, "cycle"
        chain.append(parent)
        seen.add(fold(parent))
        at = s.xml_nodes.where(F.col("name_fold") == fold(parent)).orderBy("id").first()
    return chain, "broken"


def descendants(s: Snapshot, root: str) -> DataFrame:
    """name_fold of the root and of every named node below it.

    One step joins the newest names with their children; names found before are left out, which
    ends cycles. A step's result is cut from its lineage in the shared folder.
    """
    spark = s.spark
    shared_path(spark, "closure")  # sets the checkpoint folder
    edges = s.xml_nodes.where("name is not null and name <> '' and parent_name is not null").select(F.col("parent_name_fold").alias("parent"), F.col("name_fold").alias("child")).distinct()
    known = spark.createDataFrame([(fold(root),)], "name string").checkpoint()
    newest = known
    while True:
        below = edges.join(newest, F.col("parent") == F.col("name")).select(F.col("child").alias("name")).distinct()
        newest = below.join(known, "name", "left_anti").checkpoint()
        if newest.isEmpty():
            return known.withColumnRenamed("name", "name_fold")
        known = known.union(newest)


def kin(s: Snapshot, root: str, exclude: tuple[str, str] | None = None) -> DataFrame:
    """id of the entities below a node: those whose node's parent is in its closure, and whose type is the node's or whose name is one entity's only."""
    closure = descendants(s, root)
    nodes = s.xml_nodes.where("def_name is not null and def_name <> ''").drop("name_fold").join(closure, F.col("parent_name_fold") == F.col("name_fold"), "left_semi")
    nodes = nodes.select(F.col("def_name_fold").alias("name_fold"), afold("def_type").alias("node_type")).distinct()
    alone = s.defs.groupBy("name_fold").agg(F.count("*").alias("n_name"))
    found = s.defs.join(nodes, "name_fold").join(alone, "name_fold").where(same_type("def_type", "node_type") | (F.col("n_name") == 1))
    if exclude:
        found = found.where(~((F.col("name_fold") == fold(exclude[0])) & (F.col("def_type") == exclude[1])))
    return found.select("id").distinct()


def witnesses(s: Snapshot, root: str, path_filter: str, value: str | None = None, exclude: tuple[str, str] | None = None, below: DataFrame | None = None) -> DataFrame:
    """In one row, the entities below a node, those with a field of the path, with the same value, and with dropped fields."""
    below = kin(s, root, exclude).checkpoint() if below is None else below
    facts = s.facts.where(any_contains("path_fold", [path_filter])).join(below.withColumnRenamed("id", "def_id"), "def_id", "left_semi")
    same = F.countDistinct(F.when(F.col("value_fold") == fold(value), F.col("def_id"))) if value is not None else F.lit(0).cast("long")
    held = facts.agg(F.countDistinct("def_id").alias("with_path"), same.alias("same_value"))
    all_ = s.defs.join(below, "id", "left_semi").agg(F.count("*").alias("descendants"), F.count_if(F.col("fields_truncated") > 0).alias("truncated"))
    return all_.crossJoin(held).select("descendants", "with_path", "same_value", "truncated")  # a row each


def dominant_value(s: Snapshot, root: str, path_filter: str, below: DataFrame | None = None) -> DataFrame:
    """Value, defs, distinct: the value (A-Z folded; its least spelling) that most entities below a node have, ties by value, and the number of values."""
    facts = s.facts.where(any_contains("path_fold", [path_filter])).join((kin(s, root) if below is None else below).withColumnRenamed("id", "def_id"), "def_id", "left_semi")
    groups = facts.groupBy("value_fold").agg(F.countDistinct("def_id").alias("defs"), F.min("value").alias("value"))
    total = groups.agg(F.count("*").alias("distinct"))
    return groups.orderBy(F.desc("defs"), "value").limit(1).crossJoin(total).select("value", "defs", "distinct")  # a row each


def witness_table(s: Snapshot, name: str, path_filter: str) -> list[dict]:
    """For each layer above an entity, its witnesses and the value they are compared with.

    That value is the entity's own if it has just one for the path; with none or several there
    is no comparison, and for an abstract node it is each layer's dominant value.
    """
    own = [r.value for r in s.facts.where((afold("def_name") == fold(name)) & any_contains("path_fold", [path_filter])).select("value").distinct().limit(2).collect()]
    node = s.xml_nodes.where((F.col("name_fold") == fold(name)) | (F.col("def_name_fold") == fold(name))).orderBy(F.desc("abstract")).first()
    chain, end = ancestors(s, name)
    out = []
    for layer in chain:
        below = kin(s, layer).checkpoint()  # for both questions
        value = own[0] if len(own) == 1 else None
        if value is None and node is not None and node.abstract:
            top = dominant_value(s, layer, path_filter, below).first()
            value = top.value if top else None
        out.append({"layer": layer, "value": value, **witnesses(s, layer, path_filter, value, below=below).first().asDict()})
    if out:
        out[-1]["end"] = end
    return out


def outside_layer(s: Snapshot, name: str) -> DataFrame:
    """How many entities of a name no node declares."""
    nodes = s.xml_nodes.where("def_name is not null").select(F.col("def_name_fold").alias("name_fold"), F.col("def_type")).distinct()
    return s.defs.where(F.col("name_fold") == fold(name)).join(nodes, ["name_fold", "def_type"], "left_anti").agg(F.count("*").alias("n"))
