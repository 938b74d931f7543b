"""Ranked text search, its fallbacks, and where a hit comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, fold
from lodestone.functions.text import FUZZY_LEAST, for_index, fuzzy_score, is_compound, phrases, tokens, without_kind
from lodestone.model import Snapshot
from lodestone.operators.paging import Page
from lodestone.plans.predicates import type_condition
from lodestone.plans.scope import Scope, scoped

# Column weights and the constants of the ranking formula.
DEF_WEIGHTS = (10.0, 4.0, 1.0, 3.0)
KEYED_WEIGHTS = (10.0, 3.0, 3.0)
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _phrase_hits(postings: DataFrame, words: list[str], prefix: bool, n_columns: int) -> DataFrame:
    """doc_id, length, hits (array by column) of one phrase."""

    def of(word: str, last: bool) -> DataFrame:
        return postings.where(F.col("term").startswith(word) if prefix and last else F.col("term") == word)

    if len(words) == 1:
        sums = F.array(*[F.sum(F.col("hits")[k]) for k in range(n_columns)])
        return of(words[0], True).groupBy("doc_id", "length").agg(sums.alias("hits"))
    # Each word's places less its place in the phrase: a phrase stands where all agree.
    found = None
    for i, word in enumerate(words):
        here = of(word, i == len(words) - 1).select("doc_id", "length", F.explode("places").alias("place")).withColumn("place", F.col("place") - i).distinct()
        found = here if found is None else found.join(here.select("doc_id", "place"), ["doc_id", "place"])
    hits = F.array(*[F.count_if(F.shiftright("place", 40) == k) for k in range(n_columns)])
    return found.groupBy("doc_id", "length").agg(hits.alias("hits"))


def totals(s: Snapshot, name: str) -> DataFrame:
    """n_docs, mean: an index's documents and their mean length, as the import has stored them."""
    of = lambda k: F.max(F.when(F.col("key") == f"{name}_{k}", F.col("value")))
    return s.meta.agg(of("docs").cast("long").alias("n_docs"), of("mean").cast("double").alias("mean"))


def bm25(postings: DataFrame, query: str, weights: tuple[float, ...], total: DataFrame | None = None) -> DataFrame | None:
    """doc_id, score of the documents that have every phrase of a query; lower is better. None if it asks for nothing.

    Each phrase adds -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean length)), f being
    its weighted hits; a phrase of more than half of the documents has the least idf. total: one
    row of n_docs and mean; without it they are taken from the postings.
    """
    wanted = phrases(query)
    if not wanted:
        return None
    if total is None:
        total = postings.select("doc_id", "length").distinct().agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    parts = []
    for i, (words, prefix) in enumerate(wanted):
        hits = _phrase_hits(postings, words, prefix, len(weights))
        f = sum((F.col("hits")[k] * w for k, w in enumerate(weights)), F.lit(0.0))
        parts.append(hits.select(F.lit(i).alias("phrase"), "doc_id", "length", f.alias("f")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    found = every.groupBy("phrase").agg(F.count("*").alias("n"))  # a row for each phrase
    scored = every.join(F.broadcast(found), "phrase").crossJoin(F.broadcast(total))  # one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    term = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("doc_id").agg(F.sum(term).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def search_index(s: Snapshot, query: str, scope: Scope | None = None, def_type: str | None = None) -> Page | None:
    """Entities by rank: exact name, any label, name that begins so, score, shorter name, name."""
    hits = bm25(s.postings, query, DEF_WEIGHTS, totals(s, "postings"))
    if hits is None:
        return None
    rows = scoped(s.defs, scope)
    if def_type:
        rows = rows.where(type_condition(def_type))
    rows = rows.join(hits, F.col("id") == F.col("doc_id")).drop("doc_id")
    exact, starts = F.col("name_fold") == fold(query), F.col("name_fold").startswith(fold(query))
    has_label = F.coalesce(F.col("label"), F.lit("")) != ""
    return Page(rows, [F.desc(exact), F.desc(has_label), F.desc(starts), F.asc(F.round("score", 9)), F.asc(F.length("def_name")), F.asc("def_name"), F.asc("id")])


def search_keyed(s: Snapshot, query: str, placeholders_only: bool = False) -> Page | None:
    """UI texts by rank: exact key, runtime texts, score, shorter key, key."""
    hits = bm25(s.keyed_postings, query, KEYED_WEIGHTS, totals(s, "keyed_postings"))
    if hits is None:
        return None
    rows = s.keyed.join(hits, F.col("id") == F.col("doc_id")).drop("doc_id")
    if placeholders_only:
        rows = rows.where("placeholder")
    return Page(rows, [F.desc(afold("key") == fold(query)), F.desc(F.col("origin") == "runtime"), F.asc(F.round("score", 9)), F.asc(F.length("key")), F.asc("key"), F.asc("id")])


def names_containing(s: Snapshot, query: str, scope: Scope | None = None) -> Page:
    """Entities whose name contains the query and that the index doesn't find."""
    rows = scoped(s.defs, scope).where(F.col("name_fold").contains(fold(query)))
    hits = bm25(s.postings, query, DEF_WEIGHTS, totals(s, "postings"))
    if hits is not None:
        rows = rows.join(hits, F.col("id") == F.col("doc_id"), "left_anti")
    return Page(rows, [F.asc(F.length("def_name")), F.asc("def_name"), F.asc("id")])


def names_by_original(s: Snapshot, query: str, scope: Scope | None = None) -> DataFrame:
    """Names of entities of which some text's original contains the query; joined by name alone."""
    texts = s.translations.where(afold("original").contains(fold(query))).select("def_name").distinct()
    return scoped(s.defs, scope).join(texts, "def_name", "left_semi").select("def_name").distinct()


def fuzzy(s: Snapshot, query: str, scope: Scope | None = None, least: float = FUZZY_LEAST) -> Page:
    """Names like the query, best first."""
    names = scoped(s.defs, scope).select("def_name").distinct()
    return Page(names.withColumn("score", fuzzy_score("def_name", query)).where(F.col("score") >= least), [F.desc("score"), F.asc(F.length("def_name")), F.asc("def_name")])


def closest(names: DataFrame, query: str, n: int = 3) -> list[str]:
    """The n names most like the query."""
    scored = names.toDF("name").distinct().withColumn("score", fuzzy_score("name", query)).where(F.col("score") >= FUZZY_LEAST)
    return [r.name for r in scored.orderBy(F.desc("score"), F.length("name"), "name").limit(n).collect()]


def cascade(s: Snapshot, query: str, scope: Scope | None = None, def_type: str | None = None, limit: int | None = 25, offset: int = 0) -> tuple[str, DataFrame, int]:
    """The first stage that finds something: its name, the page, and the total.

    index: ranked hits, and after them, for a query of one compound token, the other names that
    contain it. original: names by their texts' originals. fuzzy: names like the query. The last
    two are tried on the first page only.
    """
    query = without_kind(query)
    page = search_index(s, query, scope, def_type)
    columns = ["id", "def_type", "def_name", "label"]
    if page is not None:
        exact, starts = F.col("name_fold") == fold(query), F.col("name_fold").startswith(fold(query))
        rows = page.rows.select(*columns, F.lit(0).alias("part"), F.when(exact, 0).otherwise(1).alias("k1"), F.when(F.coalesce("label", F.lit("")) != "", 0).otherwise(1).alias("k2"), F.when(starts, 0).otherwise(1).alias("k3"), F.round("score", 9).alias("k4"))
        if is_compound(query):
            more = names_containing(s, query, scope).rows
            more = more.where(type_condition(def_type)) if def_type else more
            rows = rows.unionAll(more.select(*columns, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0)))
        found = Page(rows, [F.asc(c) for c in ("part", "k1", "k2", "k3", "k4")] + [F.asc(F.length("def_name")), F.asc("def_name"), F.asc("id")])
        if total := found.total():
            return "index", found.take(limit, offset).select(*columns), total
    if offset == 0:
        for name, names in (("original", names_by_original(s, query, scope)), ("fuzzy", fuzzy(s, query, scope).rows.select("def_name"))):
            rows = scoped(s.defs, scope).join(names, "def_name", "left_semi")
            rows = rows.where(type_condition(def_type)) if def_type else rows
            found = Page(rows.select(*columns), [F.desc(fuzzy_score("def_name", query))] * (name == "fuzzy") + [F.asc(F.length("def_name")), F.asc("def_name"), F.asc("id")])
            if total := found.total():
                return name, found.take(limit), total
    return "none", s.defs.limit(0).select(*columns), 0


def matched_on(s: Snapshot, page: DataFrame, query: str) -> DataFrame:
    """Page (id, def_name, label, description) with matched_on: its own columns that have a term, a text's path, the name alone, or the index."""
    wanted = [(words, prefix) for words, prefix in phrases(query)]

    def has(c: str, identifier: bool = False) -> Column:
        found = tokens(for_index(F.coalesce(F.col(c), F.lit("")), identifier))
        out = F.lit(False)
        for words, prefix in wanted:
            last = words[-1]
            out = out | F.exists(found, _starts(last) if prefix else _equals(last))
        return out

    own = F.concat_ws("+", F.when(has("def_name", True), "def_name"), F.when(has("label"), "label"), F.when(has("description"), "description"))
    texts = s.translations.where(has("translated"))
    owned = texts.where("def_id is not null").groupBy(F.col("def_id").alias("id")).agg(F.min("path").alias("text_path"))
    named = texts.groupBy("def_name").agg(F.count("*").alias("n_texts"))
    out = page.join(owned, "id", "left").join(named, "def_name", "left")
    how = F.when(own != "", own).when(F.col("text_path").isNotNull(), F.col("text_path")).when(F.col("n_texts") > 0, "same def_name").otherwise("indexed text")
    return out.withColumn("matched_on", how).drop("text_path", "n_texts")


def _starts(word: str):
    return lambda t: t.startswith(word)


def _equals(word: str):
    return lambda t: t == word
