"""Entities by name, type and class; an entity's fields and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, fold
from lodestone.model import SAME, Snapshot
from lodestone.operators.paging import Page
from lodestone.plans.predicates import any_contains, class_condition, type_condition, types_condition
from lodestone.plans.scope import Scope, scoped


def types(s: Snapshot, scope: Scope | None = None) -> Page:
    """L1: types and their entities, most first."""
    return Page(scoped(s.defs, scope).groupBy("def_type").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("def_type")])


def all_names(s: Snapshot, scope: Scope | None = None) -> DataFrame:
    """L2: one name for each entity."""
    return scoped(s.defs, scope).select("def_name")


def named(s: Snapshot, name: str) -> DataFrame:
    """L3: every entity of a name, A-Z folded."""
    return s.defs.where(F.col("name_fold") == fold(name))


def by_names(s: Snapshot, names: list[str]) -> Page:
    """L4: the entities of several names, in the caller's order; a name given twice counts once."""
    folded = list(dict.fromkeys(map(fold, names)))
    ranks = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(folded)) for x in pair])
    return Page(s.defs.where(F.col("name_fold").isin(*folded)).withColumn("rank", ranks[F.col("name_fold")]), [F.asc("rank"), F.asc("id")])


def list_by_type(s: Snapshot, def_type: str, scope: Scope | None = None, class_name: str | None = None, name_like: str | None = None) -> Page:
    """The entities of a type, filtered before any cut."""
    rows = scoped(s.defs, scope).where(type_condition(def_type))
    if class_name:
        rows = rows.where(class_condition(class_name))
    if name_like:
        rows = rows.where(F.col("name_fold").contains(fold(name_like)) | afold("label").contains(fold(name_like)))
    return Page(rows, [F.asc("def_name"), F.asc("id")])


def fields(s: Snapshot, def_id: int, filters: list[str] | None = None, include_defaults: bool = False) -> tuple[Page, DataFrame]:
    """An entity's fields, and one row of counts (matched, total, defaulted): defaults are hidden but counted."""
    own = s.facts.where(F.col("def_id") == def_id)
    matches = any_contains("path_fold", filters) if filters else F.lit(True)
    counts = own.agg(F.count_if(matches).alias("matched"), F.count("*").alias("total"), F.count_if(matches & (F.col("is_default") == SAME)).alias("defaulted"))
    shown = own.where(matches)
    if not include_defaults:
        shown = shown.where(F.col("is_default") != SAME)
    return Page(shown.select("path", "value", "is_default", "seq"), [F.asc("seq")]), counts


def value_hits(s: Snapshot, def_id: int, text: str) -> DataFrame:
    """How many of an entity's values contain a text."""
    return s.facts.where(F.col("def_id") == def_id).agg(F.count_if(F.col("value_fold").contains(fold(text))).alias("hits"))


def truncated(s: Snapshot, scope: Scope | None = None, def_types: list[str] | None = None, name_like: str | None = None) -> Page:
    """Entities with dropped fields, most first. The filter on types heeds case."""
    rows = scoped(s.defs, scope).where("fields_truncated > 0")
    if def_types:
        rows = rows.where(types_condition(def_types))
    if name_like:
        rows = rows.where(F.col("name_fold").contains(fold(name_like)))
    return Page(rows, [F.desc("fields_truncated"), F.asc("def_name"), F.asc("id")])


def counts(s: Snapshot) -> DataFrame:
    """Entities, truncated entities, UI texts and nodes, in one row."""
    d = s.defs.agg(F.count("*").alias("defs"), F.count_if(F.col("fields_truncated") > 0).alias("truncated"))
    k = s.keyed.agg(F.count("*").alias("keyed"))
    n = s.xml_nodes.agg(F.count("*").alias("nodes"))
    return d.crossJoin(k).crossJoin(n)  # a row each


def mods(s: Snapshot) -> Page:
    """The mods in load order."""
    return Page(s.mods, [F.asc("ordinal")])


def translations_of(s: Snapshot, def_id: int) -> Page:
    """An entity's texts."""
    return Page(s.translations.where(F.col("def_id") == def_id), [F.asc("origin"), F.asc("path")])


def translations_outside(s: Snapshot) -> DataFrame:
    """How many names have texts that were found outside the mod list."""
    return s.translations.where("origin = 'harvested_outside'").agg(F.countDistinct("def_name").alias("n"))


NODE_ORDER = [F.desc, F.asc, F.asc, F.asc]


def node_page(rows: DataFrame) -> Page:
    return Page(rows, [f(c) for f, c in zip(NODE_ORDER, ("abstract", "name", "def_name", "id"), strict=True)])


def nodes_named(s: Snapshot, name: str) -> Page:
    """Nodes by their own or their entity's name."""
    return node_page(s.xml_nodes.where((F.col("name_fold") == fold(name)) | (F.col("def_name_fold") == fold(name))))


def nodes_below(s: Snapshot, name: str) -> Page:
    """Nodes whose parent has the name."""
    return node_page(s.xml_nodes.where(F.col("parent_name_fold") == fold(name)))
