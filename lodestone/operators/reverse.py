"""From fields and values to entities: reverse lookups and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.paths import container_prefix, fold, index_prefixes, inner_segment, whole_segments
from lodestone.model import SAME, Snapshot
from lodestone.operators.paging import Page
from lodestone.plans.predicates import PathQuery, ValueMatch, any_contains, class_condition, type_condition, value_condition
from lodestone.plans.scope import Scope, scoped
from lodestone.shared import shared_path

SUGGESTIONS, SHAPES = 3, 6
"""Shapes that value_elsewhere shows, and how many at most if the last ties."""


def matching(s: Snapshot, path: PathQuery, value: str | None = None, exact: bool = False, scope: Scope | None = None) -> DataFrame:
    """The facts of a path, and of a value if given: contained in theirs, or equal."""
    rows = scoped(s.facts, scope).where(path.condition())
    return rows if value is None else rows.where(value_condition(value, ValueMatch.EXACT if exact else ValueMatch.SUBSTRING))


def find_by_field(s: Snapshot, path: PathQuery, value: str | None = None, exact: bool = False, scope: Scope | None = None) -> tuple[Page, DataFrame]:
    """(entity, path) rows, and one row with their number and that of the entities."""
    rows = matching(s, path, value, exact, scope)
    return Page(rows.select("def_id", "seq", "def_type", "def_name", "path", "value", "is_default"), [F.asc("def_name"), F.asc("def_id"), F.asc("seq")]), rows.agg(F.count("*").alias("matches"), F.countDistinct("def_id").alias("defs"))


def path_shapes(s: Snapshot, path: PathQuery, value: str | None = None, exact: bool = False, scope: Scope | None = None) -> Page:
    """R2: the same rows by the shape of their path."""
    return Page(matching(s, path, value, exact, scope).groupBy("shape").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("shape")])


def generated_defs(s: Snapshot, path: PathQuery, value: str | None = None, exact: bool = False, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """The names of those of the entities that code generates, and how many entities they are."""
    rows = matching(s, path, value, exact, scope).where("generated")
    return rows.select("def_name").distinct(), rows.agg(F.countDistinct("def_id").alias("defs"))


def type_defs_with_path(s: Snapshot, def_type: str, filters: list[str]) -> DataFrame:
    """Entities of a type with a field that contains any filter, and the number of such paths."""
    return s.facts.where(type_condition(def_type) & any_contains("path_fold", filters)).agg(F.countDistinct("def_id").alias("defs"), F.countDistinct("path").alias("paths"))


def paths_of_type(s: Snapshot, def_type: str, filters: list[str] | None = None) -> tuple[Page, DataFrame]:
    """A type's paths with the number of their rows; one row with all paths and those that hold a filter as whole segments."""
    rows = s.facts.where(type_condition(def_type))
    if filters:
        rows = rows.where(any_contains("path_fold", filters))
    paths = rows.groupBy("path").agg(F.count("*").alias("n"))
    whole = F.count_if(whole_segments("path", filters)) if filters else F.count("*")
    return Page(paths, [F.desc("n"), F.asc("path")]), paths.agg(F.count("*").alias("paths"), whole.alias("whole"))


def in_type(rows: DataFrame, def_type: str | None) -> DataFrame:
    return rows.where(type_condition(def_type)) if def_type else rows


def value_coverage(s: Snapshot, path: PathQuery, scope: Scope | None = None, def_type: str | None = None) -> tuple[Page, Page, DataFrame]:
    """The paths and types that a path query reaches, and one row with the numbers of paths and entities."""
    rows = in_type(matching(s, path, scope=scope), def_type)
    paths = rows.groupBy("path").agg(F.count("*").alias("n"))
    kinds = rows.groupBy("def_type").agg(F.countDistinct("def_id").alias("defs"))
    return Page(paths, [F.desc("n"), F.asc("path")]), Page(kinds, [F.desc("defs"), F.asc("def_type")]), rows.agg(F.countDistinct("path").alias("paths"), F.countDistinct("def_id").alias("defs"))


def distinct_values(s: Snapshot, path: PathQuery, scope: Scope | None = None, def_type: str | None = None) -> Page:
    """A path's values and the number of their rows (not entities); null is one of them."""
    return Page(in_type(matching(s, path, scope=scope), def_type).groupBy("value").agg(F.count("*").alias("matches")), [F.desc("matches"), F.asc("value")])


def paths_with_value(s: Snapshot, value: str, scope: Scope | None = None, match: ValueMatch = ValueMatch.SUBSTRING) -> tuple[Page, DataFrame]:
    """Where a value stands: (path, type) with entities and least value; one row with all groups and those with just the value."""
    rows = scoped(s.facts, scope).where(value_condition(value, match)).withColumn("__same", F.col("value_fold") == fold(value))
    groups = rows.groupBy("path", "def_type").agg(F.countDistinct("def_id").alias("defs"), F.min("value").alias("sample"), F.max("__same").alias("__same"))
    exact = F.count_if("__same") if match is ValueMatch.SUBSTRING else F.count("*")
    return Page(groups.drop("__same"), [F.desc("defs"), F.asc("path"), F.asc("def_type")]), groups.agg(F.count("*").alias("groups"), exact.alias("exact"))


def value_elsewhere(s: Snapshot, own: PathQuery, value: str, match: ValueMatch = ValueMatch.SUBSTRING, scope: Scope | None = None) -> DataFrame:
    """Shape, defs, others: the other shapes that the value has in the types where the path has it.

    Shapes come by the sum of their paths' entities. SUGGESTIONS are shown; more, up to SHAPES,
    while they tie with the last; and if one is left over, it too. defs counts a shape's
    entities exactly; others is the number of all such shapes. The path's own types, a few names,
    and shapes are found first: fields of other types are not read, nor what they rest on.
    """
    hits = scoped(s.facts, scope).where(value_condition(value, match))
    shared_path(s.spark, "own")  # sets the checkpoint folder
    own_shapes = hits.where(own.condition()).select("def_type", "shape").distinct().checkpoint()
    kinds = [r.def_type for r in own_shapes.select("def_type").distinct().collect()]
    others = hits.where(F.col("def_type").isin(kinds)).join(own_shapes.select("shape").distinct(), "shape", "left_anti")
    # An entity's paths of a shape are counted in one place, so a shape's entities and the sum of its paths' come from one reading.
    each = others.where("shape is not null").groupBy("shape", "def_id").agg(F.countDistinct("path").alias("paths"))
    shapes = each.groupBy("shape").agg(F.sum("paths").alias("rough"), F.count("*").alias("defs"))
    # One row for each shape of one value; the ranking needs them in one place.
    order = Window.orderBy(F.desc("rough"), "shape")
    everything = Window.partitionBy(F.lit(0))
    ranked = shapes.withColumn("rank", F.row_number().over(order)).withColumn("others", F.count("*").over(everything))
    bound = F.max(F.when(F.col("rank") == SUGGESTIONS, F.col("rough"))).over(everything)
    ranked = ranked.withColumn("take", F.max(F.when((F.col("rank") <= SUGGESTIONS) | ((F.col("rank") <= SHAPES) & (F.col("rough") == bound)), F.col("rank"))).over(everything))
    shown = (F.col("rank") <= F.col("take")) | (F.col("others") == F.col("take") + 1)
    return ranked.where(shown).select("shape", "defs", "others")


def paths_below(s: Snapshot, name: str, scope: Scope | None = None) -> Page:
    """Paths with the name as a segment above others, with entities and the type that has most of them."""
    rows = scoped(s.facts, scope).where(inner_segment("path", name))
    kinds = rows.groupBy("path", "def_type").agg(F.countDistinct("def_id").alias("n"))
    top = kinds.groupBy("path").agg(F.sum("n").alias("defs"), F.min(F.struct(-F.col("n"), F.col("def_type"))).getField("def_type").alias("top_type"))
    return Page(top, [F.desc("defs"), F.asc("path")])


def path_exists(s: Snapshot, path: PathQuery) -> bool:
    """Whether any field answers the path query."""
    return not s.facts.where(path.condition()).limit(1).isEmpty()


def authored_siblings(s: Snapshot, shown: DataFrame) -> Page:
    """The other set fields of the indexed blocks that hold the shown (def_id, def_type, path) rows, in storage order.

    The types of the shown rows, a few names, come first: fields of other types are not read, nor
    what they rest on.
    """
    blocks = shown.select("def_id", container_prefix("path").alias("block")).where("block <> ''").distinct()
    kinds = [r.def_type for r in shown.where(container_prefix("path") != "").select("def_type").distinct().collect()]
    near = s.facts.where(F.col("def_type").isin(kinds) & (F.col("is_default") != SAME) & F.col("path").contains("]."))
    # A field lies in the block of each of its indexed prefixes.
    near = near.withColumn("block", F.explode(F.transform(index_prefixes("path"), lambda p: F.concat(p, F.lit(".")))))
    near = near.join(blocks, ["def_id", "block"], "left_semi").join(shown.select("def_id", "path"), ["def_id", "path"], "left_anti")
    return Page(near.groupBy("leaf").agg(F.min(F.struct("def_id", "seq")).alias("first")).select("leaf", "first.def_id", "first.seq"), [F.asc("def_id"), F.asc("seq")])


def shared_of(s: Snapshot, def_type: str, rows: DataFrame) -> DataFrame:
    """Rows (path, value) with the number of entities that share them in the type; a null value is an empty one."""
    shared = s.shared_values.where(F.col("def_type") == def_type).select("path", F.coalesce("value", F.lit("")).alias("value"), "defs")
    return rows.select("path", F.coalesce("value", F.lit("")).alias("value")).join(shared, ["path", "value"])


def classes_in_type(s: Snapshot, def_type: str) -> Page:
    """A type's classes."""
    return Page(s.defs.where(type_condition(def_type)).where("class is not null").groupBy("class").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("class")])


def types_holding_class(s: Snapshot, name: str) -> Page:
    """The types that have entities of a class."""
    return Page(s.defs.where(class_condition(name)).groupBy("def_type").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("def_type")])


def truncated_sharing(s: Snapshot, rows: DataFrame, scope: Scope | None = None) -> Page:
    """For the types that the rows are of, their entities with dropped fields: an answer may be among those."""
    kinds = rows.select("def_type").distinct()
    return Page(scoped(s.defs, scope).where("fields_truncated > 0").join(kinds, "def_type", "left_semi").groupBy("def_type").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("def_type")])


def same_label_groups(page: DataFrame) -> DataFrame:
    """The labels that several rows of a page share within a type."""
    return page.where("label <> ''").groupBy("label", "def_type").agg(F.count("*").alias("n")).where("n > 1")


def hidden_indexes(s: Snapshot, def_id: int, shown: DataFrame) -> DataFrame:
    """The list entries that an entity has fields in, none of which is shown."""
    prefixes = lambda rows: rows.select(F.explode(index_prefixes("path")).alias("prefix")).distinct()
    return prefixes(s.facts.where(F.col("def_id") == def_id)).join(prefixes(shown), "prefix", "left_anti")
