"""From raw tables to a snapshot: noise, owners, the text index, and values that a type shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, is_noise
from lodestone.functions.text import for_index, tokens
from lodestone.model import SAME, SCHEMA_VERSION, facts_of, write_table

SHARED_LEAST = 8
"""Entities that must have a value before it can count as shared by their type."""
SHARED_BUCKETS = 256
"""Hashes by which a path's values are counted to find those that most entities may have."""

DEF_COLUMNS = (("def_name", True), ("label", False), ("description", False), ("translated", False))
KEYED_COLUMNS = (("key", True), ("translated", False), ("original", False))


def without_noise(field_values: DataFrame) -> DataFrame:
    """field_values but for bookkeeping fields."""
    return field_values.where(~is_noise("path"))


def with_folds(xml_nodes: DataFrame) -> DataFrame:
    """xml_nodes with the folded forms of their names."""
    return xml_nodes.withColumns({f"{c}_fold": afold(c) for c in ("name", "parent_name", "def_name")})


def shared_values(facts: DataFrame, defs: DataFrame, least: int = SHARED_LEAST) -> DataFrame:
    """def_type, path, value, defs: values other than defaults that most entities of a type have.

    A path's values are first counted by SHARED_BUCKETS hashes: a value that most entities have
    makes its bucket as full. Entities are told apart for the values of such buckets alone, so
    the shuffles carry a few rows for each path, and these values. A path has at most one such
    bucket for every half of its entities, so they are few and broadcast.
    """
    totals = defs.groupBy("def_type").agg(F.count("*").alias("n_type"))
    set_ = facts.where(F.col("is_default") != SAME).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(SHARED_BUCKETS)))
    full = set_.groupBy("def_type", "path", "bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    full = full.join(F.broadcast(totals), "def_type").where(2 * F.col("n") > F.col("n_type")).select("def_type", "path", "bucket")
    found = set_.join(F.broadcast(full), ["def_type", "path", "bucket"], "left_semi").groupBy("def_type", "path", "value").agg(F.countDistinct("def_id").alias("defs")).where(F.col("defs") >= least)
    return found.join(F.broadcast(totals), "def_type").where(2 * F.col("defs") > F.col("n_type")).select("def_type", "path", "value", "defs")


def resolve_owners(injections: DataFrame, defs: DataFrame) -> DataFrame:
    """injections with def_id: the one entity of that name, or of several the one of that type; else null.

    Candidates are counted for each name and for each name and type, so a name that many
    entities and texts have makes no pairs.
    """
    names = defs.groupBy("def_name").agg(F.count("*").alias("n_name"), F.min("id").alias("id_name"))
    typed = defs.groupBy("def_name", "def_type").agg(F.count("*").alias("n_typed"), F.min("id").alias("id_typed"))
    owner = F.when(F.col("n_name") == 1, F.col("id_name")).when(F.col("n_typed") == 1, F.col("id_typed"))
    plain = injections.drop("def_id")
    return plain.join(names, "def_name", "left").join(typed, ["def_name", "def_type"], "left").withColumn("def_id", owner).drop("n_name", "id_name", "n_typed", "id_typed")


def indexed_text(defs: DataFrame, translations: DataFrame) -> DataFrame:
    """id, text: an entity's distinct translations joined by spaces; texts without owner go to every entity of their name."""
    owned = translations.where("def_id is not null and translated is not null").select(F.col("def_id").alias("id"), "translated")
    lost = translations.where("def_id is null and translated is not null").select("def_name", "translated").distinct()
    spread = lost.join(defs.select("id", "def_name"), "def_name").select("id", "translated")
    return owned.union(spread).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("translated")), " ").alias("translated"))


def postings(rows: DataFrame, id_col: str, columns: tuple[tuple[str, bool], ...]) -> DataFrame:
    """doc_id, term, hits, places, length: a row for each document and term.

    hits has the term's number of occurrences in each column, places where they are (column
    times 2**40 plus position), length the document's tokens in all columns. A document without
    tokens has none. All tokens of a document stand in its row, so they are grouped there, a
    batch of documents at once, and nothing is shuffled.
    """
    parts = [tokens(for_index(F.coalesce(F.col(c), F.lit("")), identifier)) for c, identifier in columns]
    flat = rows.select(F.col(id_col).alias("doc_id"), F.concat(*parts).alias("terms"), F.array(*[F.size(p) for p in parts]).alias("sizes"))
    n = len(columns)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat_terms = lists.flatten().dictionary_encode()
            if not len(flat_terms):
                continue
            term = flat_terms.indices.to_numpy()
            sizes = np.stack(batch.column(2).to_pylist()).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), sizes.sum(1))
            each = sizes.reshape(-1)
            column = np.repeat(np.tile(np.arange(n), batch.num_rows), each)
            place = np.arange(len(term)) - np.repeat(np.cumsum(each) - each, each)
            order = np.lexsort((place, column, term, doc))
            term, doc, column, place = term[order], doc[order], column[order], (column << 40 | place)[order]
            start = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(doc) != 0)))
            hits = np.stack([np.add.reduceat((column == k).astype(np.int64), start) for k in range(n)], axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(doc[start])),
                "length": pa.array(sizes.sum(1)[doc[start]]),
                "term": flat_terms.dictionary.take(pa.array(term[start])),
                "hits": pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * n, pa.int32()), pa.array(hits.reshape(-1))),
                "places": pa.ListArray.from_arrays(pa.array(np.append(start, len(place)), pa.int32()), pa.array(place)),
            })

    return flat.mapInArrow(grouped, f"doc_id {rows.schema[id_col].dataType.simpleString()}, length long, term string, hits array<long>, places array<long>")


def index_size(index: DataFrame, documents: int) -> dict[str, str]:
    """How many documents an index has, and how many tokens on average, those without tokens included."""
    total = index.agg(F.sum(F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return {"docs": str(documents), "mean": repr(total / documents if documents else 0.0)}


def publish(meta: dict[str, str], tables: dict[str, DataFrame], path: str) -> None:
    """Writes a snapshot from the raw tables (defs, field_values, translations, keyed, xml_nodes, mods).

    What later tables are built from is read back from where it was written, so each source is
    read once. meta comes last: a snapshot without it is known to be unfinished.
    """
    spark = tables["defs"].sparkSession
    defs = write_table(tables["defs"].withColumn("name_fold", afold("def_name")), path, "defs")
    raw = tables["translations"]
    translations = write_table(raw if "def_id" in raw.columns else resolve_owners(raw, defs), path, "translations")
    keyed = write_table(tables["keyed"].where("key <> ''"), path, "keyed")
    facts = write_table(facts_of(without_noise(tables["field_values"]), defs), path, "facts")
    write_table(shared_values(facts, defs), path, "shared_values")
    write_table(with_folds(tables["xml_nodes"]), path, "xml_nodes")
    write_table(tables["mods"], path, "mods")
    index = write_table(postings(defs.join(indexed_text(defs, translations), "id", "left"), "id", DEF_COLUMNS), path, "postings")
    keyed_index = write_table(postings(keyed, "id", KEYED_COLUMNS), path, "keyed_postings")
    for name, made, documents in (("postings", index, defs.count()), ("keyed_postings", keyed_index, keyed.count())):
        meta = meta | {f"{name}_{k}": v for k, v in index_size(made, documents).items()}
    write_table(spark.createDataFrame(sorted((meta | {"schema_version": SCHEMA_VERSION}).items()), "key string, value string"), path, "meta")
