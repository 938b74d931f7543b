"""Which mods a query looks at: include and exclude expressions, as sets and as predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFICIAL = ("vanilla", "base", "core", "official")


class ScopeError(ValueError):
    """Tokens that name no mod or group."""

    def __init__(self, unknown: list[str]):
        super().__init__("unknown in scope: " + ", ".join(unknown))
        self.unknown = unknown


@dataclass(frozen=True)
class Scope:
    """A set of mod ids; None is all of them."""

    ids: frozenset[str] | None = None
    universe: tuple[str, ...] = ()
    exclusion: bool = False

    def condition(self, column: str = "source_mod") -> Column | None:
        """None for all; an empty set holds nothing; ids are compared with case, being canonical."""
        if self.ids is None:
            return None
        return F.col(column).isin(*sorted(self.ids)) if self.ids else F.lit(False)

    def complement(self) -> Scope | None:
        """What a pure exclusion from everything leaves out; None for any other scope."""
        if not self.exclusion or self.ids is None:
            return None
        return Scope(frozenset(self.universe) - self.ids, self.universe)


def resolve(token: str, universe: list[str], groups: dict[str, list[str]], official: str) -> set[str] | None:
    """The mods of a token: a built-in group, a group of the settings, an id, or the last dotted part of ids; None if none."""
    low = token.lower()
    if low == "all":
        return set(universe)
    if low in OFFICIAL:
        return {m for m in universe if m.lower().startswith(official)}
    for name, members in groups.items():
        if name.lower() == low:
            return set().union(*(resolve(m, universe, {}, official) or set() for m in members))
    return {m for m in universe if m.lower() == low} or {m for m in universe if m.lower().rpartition(".")[2] == low} or None


def parse(text: str | None, universe: list[str], groups: dict[str, list[str]] | None = None, official: str = "base.") -> Scope:
    """A scope from a comma list folded from left to right; -x takes away, and if that comes first, from everything."""
    tokens = [t.strip() for t in (text or "").split(",") if t.strip()]
    if not tokens or [t.lower() for t in tokens] == ["all"]:
        return Scope(None, tuple(universe))
    chosen: set[str] = set(universe) if tokens[0].startswith("-") else set()
    unknown = []
    for token in tokens:
        name = token.lstrip("-").strip()
        found = resolve(name, universe, groups or {}, official)
        if found is None:
            unknown.append(name)
        elif token.startswith("-"):
            chosen -= found
        else:
            chosen |= found
    if unknown:
        raise ScopeError(unknown)
    return Scope(frozenset(chosen), tuple(universe), all(t.startswith("-") for t in tokens))


def scoped(df, scope: Scope | None, column: str = "source_mod"):
    """The rows in scope."""
    condition = scope.condition(column) if scope else None
    return df if condition is None else df.where(condition)
