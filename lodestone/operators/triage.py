"""Why a query finds nothing, and what a result should be read with.

Every probe is the query with one condition relaxed, asked only when the one before it had no
answer; each takes as little as settles it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, class_like, declared_in, default_text, fold
from lodestone.functions.text import phrases
from lodestone.model import Snapshot
from lodestone.operators import lookup, reverse, search
from lodestone.operators.paging import MAX_LIMIT
from lodestone.plans.predicates import PathQuery, ValueMatch, class_condition, type_condition
from lodestone.plans.scope import Scope


FEW = 200
"""Rows up to which a result's neighbours are looked at."""


@dataclass
class Finding:
    """Where the answer is instead: a reason, its evidence, and names to try."""

    reason: str
    text: str
    names: tuple[str, ...] = ()


def some(df: DataFrame, column: str, n: int = 3) -> list[str]:
    """A few different values, in order."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n).collect()]


def is_scoped(scope: Scope | None) -> bool:
    return scope is not None and scope.ids is not None


def where_triage(s: Snapshot, path: PathQuery, value: str | None, exact: bool, scope: Scope | None) -> Finding | None:
    """A2: why `where` has no rows."""
    if path.exact and (names := some(reverse.matching(s, PathQuery(path.text), value, exact, scope), "path")):
        return Finding("exact path", f"no path is just {path.text}; paths end with it", tuple(names))
    if is_scoped(scope) and (names := some(reverse.matching(s, path, value, exact), "source_mod")):
        return Finding("scope", "the matches are in mods outside the scope", tuple(names))
    if not reverse.path_exists(s, path):
        below = reverse.paths_below(s, path.text.rpartition(".")[2], scope).take(3).collect()
        if below:
            return Finding("deeper", f"{path.text} holds no value itself; values are below it", tuple(r.path for r in below))
        near = search.closest(s.facts.select("leaf"), path.text.rpartition(".")[2])
        return Finding("unknown field", f"no field is called {path.text}", tuple(near))
    if value is None:
        return None
    if value.startswith("CompProperties_"):
        short = "Comp" + value.removeprefix("CompProperties_")
        if names := some(reverse.matching(s, path, short, exact, scope), "value"):
            return Finding("identity", f"the field has the component, {short}, not its properties", tuple(names))
    if names := some(reverse.paths_with_value(s, value, scope, ValueMatch.IDENTIFIER)[0].rows, "path"):
        return Finding("elsewhere", f"other fields have the value {value}", tuple(names))
    if class_like(value) and (names := some(reverse.types_holding_class(s, value).rows, "def_type")):
        return Finding("class", f"{value} is the class of entities, which the field doesn't name; they are in", tuple(names))
    if n := index_has(s, value, scope):
        return Finding("indexed text", f"no field has {value}, but names and texts of {n} entities do; search for it")
    near = search.closest(reverse.matching(s, path, scope=scope).select("value"), value)
    return Finding("not in domain", f"{path.text} never has {value}", tuple(near))


def list_triage(s: Snapshot, def_type: str, scope: Scope | None, class_name: str | None, name_like: str | None, offset: int) -> Finding | None:
    """A3: why `list` has no rows."""
    page = lookup.list_by_type(s, def_type, scope, class_name, name_like)
    if offset and (n := page.total()):
        return Finding("past the end", f"there are {n}; the offset is beyond them")
    if is_scoped(scope) and (names := some(lookup.list_by_type(s, def_type, None, class_name, name_like).rows, "source_mod")):
        return Finding("scope", "the matches are in mods outside the scope", tuple(names))
    of_type = s.defs.where(type_condition(def_type))
    if (class_name or name_like) and (names := some(of_type, "class")):
        return Finding("filtered", f"{def_type} has entities, but none that fit", tuple(names))
    if names := some(reverse.types_holding_class(s, def_type).rows, "def_type"):
        return Finding("class", f"{def_type} is a class, not a type; its entities are in", tuple(names))
    return Finding("unknown type", f"no type is called {def_type}", tuple(search.closest(s.defs.select("def_type"), def_type)))


def values_triage(s: Snapshot, path: PathQuery, scope: Scope | None, def_type: str | None) -> Finding | None:
    """A4: why `values` has no rows."""
    if def_type and (names := some(reverse.matching(s, path, scope=scope), "def_type")):
        return Finding("type", f"{def_type} has no such field; these types have", tuple(names))
    if is_scoped(scope) and (names := some(reverse.matching(s, path), "source_mod")):
        return Finding("scope", "the field is in mods outside the scope", tuple(names))
    return where_triage(s, path, None, False, scope)


def locate(s: Snapshot, name: str, scope: Scope | None = None, others: dict[str, Snapshot] | None = None) -> list[Finding]:
    """Everywhere that a name is known, nearest first; in other snapshots if it is known nowhere here."""
    probes = (
        ("def out of scope", lambda: lookup.named(s, name) if is_scoped(scope) else None, "source_mod"),
        ("node", lambda: lookup.nodes_named(s, name).rows, "parent_name"),
        ("type", lambda: s.defs.where(type_condition(name)), "def_type"),
        ("class", lambda: s.defs.where(class_condition(name)), "def_type"),
        ("UI text", lambda: s.keyed.where(afold("key") == fold(name)), "key"),
        ("mod", lambda: s.mods.where(afold("package_id") == fold(name)), "package_id"),
        ("value", lambda: reverse.paths_with_value(s, name, None, ValueMatch.IDENTIFIER)[0].rows, "path"),
        ("mod by name", lambda: s.mods.where(afold("name").contains(fold(name)) | (afold(F.substring_index("package_id", ".", -1)) == fold(name))), "package_id"),
    )
    out = []
    for reason, rows, column in probes:
        df = rows()
        if df is not None and not df.limit(1).isEmpty():
            out.append(Finding(reason, f"{name} is known as a {reason}", tuple(some(df, column))))
    if not out and others and (names := elsewhere(others, lambda o: lookup.named(o, name))):
        out.append(Finding("other snapshot", f"{name} is an entity in another snapshot", tuple(names)))
    return out


def elsewhere(others: dict[str, Snapshot], probe) -> list[str]:
    """A10: the other snapshots in which a probe (a function from snapshot to DataFrame), without scope, finds something."""
    return [name for name, other in others.items() if not probe(other).limit(1).isEmpty()]


def advisories(s: Snapshot, path: PathQuery, value: str | None, exact: bool, scope: Scope | None, matches: int) -> list[Finding]:
    """What a `where` result should be read with. The counts come from one pass over its rows."""
    out = []
    rows = reverse.matching(s, path, value, exact, scope)
    is_value = F.col("value_fold") == fold(value) if value is not None else F.lit(True)
    n = rows.agg(F.countDistinct("shape").alias("shapes"), F.countDistinct(F.when(F.col("generated"), F.col("def_id"))).alias("generated"), F.count_if(is_value).alias("exact")).first()
    if n.shapes > 1:
        out.append(Finding("shapes", f"the rows are of {n.shapes} different shapes of path", tuple(r.shape for r in reverse.path_shapes(s, path, value, exact, scope).take(3).collect())))
    if n.generated:
        out.append(Finding("generated", f"{n.generated} of the entities are generated by code"))
    if value is not None and not exact and 0 < n.exact < matches:
        out.append(Finding("widened", f"{n.exact} of {matches} rows have just this value; the others contain it"))
    if value is not None:
        other = reverse.value_elsewhere(s, path, value, ValueMatch.EXACT if exact else ValueMatch.SUBSTRING, scope).collect()
        if other:
            out.append(Finding("elsewhere", f"the value is also on {other[0].others} other shapes of these types", tuple(f"{r.shape} ({r.defs})" for r in other)))
    if matches <= FEW:
        beside = reverse.authored_siblings(s, rows).take(4).collect()
        if beside:
            out.append(Finding("siblings", "the same list entries also have", tuple(r.leaf for r in beside)))
        alike = reverse.same_label_groups(s.defs.join(rows.select(F.col("def_id").alias("id")).distinct(), "id", "left_semi")).limit(3).collect()
        if alike:
            out.append(Finding("same label", "some of the entities share a label", tuple(f"{r.label} ({r.n})" for r in alike)))
    cut = reverse.truncated_sharing(s, rows, scope).take(3).collect()
    if cut:
        out.append(Finding("truncated", "entities of these types had fields dropped: " + ", ".join(f"{r.def_type} {r.n}" for r in cut)))
    return out


def outside_texts(s: Snapshot) -> Finding | None:
    """That some texts are from mods outside the snapshot's list."""
    n = lookup.translations_outside(s).first().n
    return Finding("outside texts", f"texts of {n} names are from mods that aren't in the list") if n else None


def index_has(s: Snapshot, text: str, scope: Scope | None = None) -> int:
    """How many entities the text index finds for a value that no field has."""
    page = search.search_index(s, text, scope) if phrases(text) else None
    return page.total() if page is not None else 0


def entity(s: Snapshot, def_id: int, filters: list[str] | None = None, include_defaults: bool = False, limit: int | None = 25) -> dict[str, DataFrame]:
    """A5: an entity's parts: identity, fields and their counts, shared values, texts, namesakes, nodes, hidden list entries."""
    own = s.defs.where(F.col("id") == def_id)
    page, counts = lookup.fields(s, def_id, filters, include_defaults)
    shown = page.take(limit)
    row = own.first()
    return {
        "identity": own.withColumn("declared_in", declared_in("generated", "source_file")),
        "fields": shown.withColumn("default", default_text("is_default")),
        "counts": counts,
        "shared": reverse.shared_of(s, row.def_type, shown).limit(limit or MAX_LIMIT),
        "texts": lookup.translations_of(s, def_id).take(limit),
        "namesakes": lookup.named(s, row.def_name).where(F.col("id") != def_id).orderBy("id").limit(limit or MAX_LIMIT),
        "inherits_from": lookup.nodes_named(s, row.def_name).take(limit),
        "hidden": reverse.hidden_indexes(s, def_id, shown),
    }
