"""UI texts by key (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, fold
from lodestone.model import Snapshot
from lodestone.operators.paging import Page
from lodestone.operators.search import search_keyed


def by_key(s: Snapshot, key: str) -> Page:
    """K1: a key's texts, those in effect first."""
    return Page(s.keyed.where(afold("key") == fold(key)), [F.desc(F.col("origin") == "runtime"), F.asc("origin"), F.asc("source_mod"), F.asc("id")])


def prefix_siblings(s: Snapshot, key: str) -> Page:
    """K2: the other keys that begin with a key, shortest first."""
    rows = s.keyed.where(afold("key").startswith(fold(key)) & (afold("key") != fold(key))).select("key").distinct()
    return Page(rows, [F.asc(F.length("key")), F.asc("key")])


def all_texts(s: Snapshot, placeholders_only: bool = False) -> Page:
    """K3: every text."""
    return Page(s.keyed.where("placeholder") if placeholders_only else s.keyed, [F.asc("key"), F.asc("origin"), F.asc("id")])


def in_effect(s: Snapshot, keys: DataFrame) -> DataFrame:
    """K4: the runtime texts of the keys (column key; with case)."""
    return s.keyed.where("origin = 'runtime'").join(keys.select("key").distinct(), "key", "left_semi").select("key", "translated", "placeholder")


def all_keys(s: Snapshot) -> DataFrame:
    """K5: every key once."""
    return s.keyed.select("key").distinct()


def lookup(s: Snapshot, query: str, placeholders_only: bool = False) -> tuple[str, Page]:
    """K6: the texts of just that key, else those that the index finds; placeholders are filtered before any cut."""
    page = by_key(s, query)
    if placeholders_only:
        page = Page(page.rows.where("placeholder"), page.order)
    if not page.rows.limit(1).isEmpty():
        return "key", page
    found = search_keyed(s, query, placeholders_only)
    return "index", found if found is not None else Page(s.keyed.limit(0), [F.asc("key")])
