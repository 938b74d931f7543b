"""The snapshot: its tables, their schemas, how it is written and opened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, leaf, shape

SCHEMA_VERSION = "2"

# The states of a field's value against its default.
DIFFERS, SAME, UNKNOWN = 0, 1, 2

SCHEMAS = {
    "meta": "key string, value string",
    "defs": "id long, def_type string, def_name string, label string, description string, source_mod string, source_file string, generated boolean, class string, fields_truncated int",
    "field_values": "def_id long, seq int, path string, value string, is_default byte",
    "translations": "def_id long, def_type string, def_name string, path string, translated string, original string, language string, source_mod string, origin string",
    "keyed": "id long, key string, translated string, original string, language string, source_file string, source_line int, source_mod string, placeholder boolean, origin string",
    "xml_nodes": "id long, def_type string, name string, parent_name string, abstract boolean, def_name string, label string, source_mod string, source_file string, patch_ops int",
    "mods": "ordinal int, package_id string, name string, version string",
}


class SnapshotError(Exception):
    """A snapshot that can't be opened or imported."""


@dataclass
class Snapshot:
    """A snapshot's tables, not read until an operator asks for them.

    facts is field_values with its entity's columns beside each value (def_type, def_name,
    source_mod, generated, class, fields_truncated) and the folded forms that filters compare.
    It is what nearly every query reads, so none of them joins values with entities: the extra
    columns repeat and cost next to nothing in a columnar file.
    """

    meta: DataFrame
    defs: DataFrame
    facts: DataFrame
    translations: DataFrame
    keyed: DataFrame
    xml_nodes: DataFrame
    shared_values: DataFrame
    mods: DataFrame
    postings: DataFrame
    keyed_postings: DataFrame
    path: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.defs.sparkSession


PARTS = 32
"""Files over which the rows of one leaf or term are dealt at most."""
BLOOM, BLOOM_VALUES = {"facts": ("value_fold", "def_id"), "translations": ("def_id",)}, 200_000
"""Columns with a Bloom filter in every row group, and the different values it is made for."""

TABLES = ("meta", "defs", "facts", "translations", "keyed", "xml_nodes", "shared_values", "mods", "postings", "keyed_postings")


def facts_of(field_values: DataFrame, defs: DataFrame) -> DataFrame:
    """field_values with the columns of their entities and the folded forms."""
    about = defs.select(F.col("id").alias("def_id"), "def_type", "def_name", "source_mod", "generated", "class", "fields_truncated")
    out = field_values.withColumn("leaf", leaf("path"))
    out = out.withColumns({"leaf_fold": afold("leaf"), "path_fold": afold("path"), "value_fold": afold("value"), "shape": shape("path")})
    return out.join(about, "def_id")


def write_table(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes a snapshot's table and reads it again.

    facts are dealt out by leaf and sorted by it: a query that names a field reads the row
    groups of that field and skips the others. One that names a value alone, or an entity, is
    served by Bloom filters. Postings are dealt out and sorted by term. A leaf or a term that
    many rows have goes to PARTS files. Dealing by hash runs what is written once; by range it
    would run twice, to find the ranges first.
    """
    if name == "facts":
        df = df.repartition("leaf_fold", F.pmod("def_id", F.lit(PARTS))).sortWithinPartitions("leaf_fold", "def_id", "seq")
    elif name in ("postings", "keyed_postings"):
        df = df.repartition("term", F.pmod("doc_id", F.lit(PARTS))).sortWithinPartitions("term", "doc_id")
    writer = df.write
    for column in BLOOM.get(name, ()):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_VALUES))
    writer.parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The snapshot at path. One without meta, or of another schema version, is refused."""
    try:
        meta = spark.read.parquet(f"{path}/meta")
    except Exception as e:
        raise SnapshotError(f"{path} is no finished snapshot") from e
    version = {r.key: r.value for r in meta.collect()}.get("schema_version")
    if version != SCHEMA_VERSION:
        raise SnapshotError(f"{path} has schema version {version}; this engine reads {SCHEMA_VERSION}. Import it again.")
    return Snapshot(meta, *(spark.read.parquet(f"{path}/{name}") for name in TABLES[1:]), path=path)
