"""Exports: gzip or plain JSON lines, checked for completeness before anything is published."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import Snapshot, SnapshotError, open_snapshot
from lodestone.operators.catalog import list_fingerprint
from lodestone.shared import stored
from lodestone.sources.build import publish

FORMAT_VERSION = 4

RECORDS = {
    "def": "def_type string, def_name string, label string, description string, source_mod string, source_file string, generated boolean, class string, fields array<array<string>>, fields_truncated int",
    "definj": "def_type string, def_name string, path string, translated string, original string",
    "keyed": "key string, translated string, original string, source_file string, source_line int, placeholder boolean",
    "xmlnode": "def_type string, name string, parent_name string, abstract boolean, def_name string, label string, source_mod string, source_file string, patch_ops int",
}


@dataclass
class ExportMeta:
    """The first record: the environment of the export."""

    exporter_version: str
    exported_at_utc: str
    game_version: str
    language: str
    mods: list[tuple[str, str, str]]
    limits: dict
    raw: str

    def at_least(self, version: str) -> bool:
        """Whether the exporter is of this version or a later one."""
        numbers = lambda v: [int(x) for x in v.split(".") if x.isdigit()]
        return numbers(self.exporter_version) >= numbers(version)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, kind, at: the lines of an export that aren't blank, in order.

    A gzip file is one partition; a plain one may be several, which are numbered in their order.
    The numbers become ids in several tables, so they are stored with the lines, once.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return stored(lines.where(F.trim("value") != "").withColumn("kind", F.get_json_object("value", "$.kind")), "lines")


def parse_meta(line: str) -> ExportMeta:
    """S3: the environment; exports of another format are refused."""
    try:
        x = json.loads(line)
    except ValueError as e:
        raise SnapshotError("the first line is no JSON") from e
    if x.get("kind") != "meta":
        raise SnapshotError("the first record isn't meta: data comes before it, or this is no export")
    version = x.get("format_version")
    if version != FORMAT_VERSION:
        advice = "export again with a newer exporter" if isinstance(version, int) and version < FORMAT_VERSION else "a newer engine is needed"
        raise SnapshotError(f"format version {version}, not {FORMAT_VERSION}: {advice}")
    mods = [(m["package_id"], m.get("name"), m.get("version")) for m in x.get("mods", [])]
    return ExportMeta(x.get("exporter_version", ""), x.get("exported_at_utc", ""), x.get("game_version", ""), x.get("language", ""), mods, x.get("limits") or {}, line)


def check_complete(lines: DataFrame) -> ExportMeta:
    """Meta first, one end marker at the very end, and as many records as it declares."""
    first = lines.orderBy("at").select("value").first()
    if first is None:
        raise SnapshotError("the export is empty")
    meta = parse_meta(first.value)
    seen = lines.agg(F.count("*").alias("n"), F.max("at").alias("last"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("end"), F.max(F.when(F.col("kind") == "end", F.col("value"))).alias("marker"), F.count_if(F.col("kind") == "meta").alias("metas")).first()
    if seen.end is None or seen.end != seen.last:
        raise SnapshotError("the export has no end marker: it was cut off")
    declared = json.loads(seen.marker).get("records")
    if declared != seen.n:
        raise SnapshotError(f"the export has {seen.n} records and declares {declared}")
    return meta


def peek(spark: SparkSession, path: str) -> ExportMeta:
    """S3: the environment of an export, from its first line alone."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        raise SnapshotError("the export is empty")
    return parse_meta(first.value)


def parse(lines: DataFrame, meta: ExportMeta) -> dict[str, DataFrame]:
    """The raw tables of an export. Ids follow the order of the records."""
    spark = lines.sparkSession

    def of(kind: str) -> DataFrame:
        return lines.where(F.col("kind") == kind).select(F.col("at").alias("id"), F.from_json("value", RECORDS[kind]).alias("r")).select("id", "r.*")

    defs = of("def")
    values = defs.select(F.col("id").alias("def_id"), F.posexplode("fields").alias("seq", "f")).select("def_id", "seq", F.col("f")[0].alias("path"), F.col("f")[1].alias("value"), F.col("f")[2].cast("byte").alias("is_default"))
    language, empty = F.lit(meta.language), lambda c: F.when(F.col(c) != "", F.col(c))
    return {
        "defs": defs.drop("fields").select("id", "def_type", "def_name", "label", "description", "source_mod", "source_file", F.coalesce("generated", F.lit(False)).alias("generated"), "class", F.coalesce("fields_truncated", F.lit(0)).alias("fields_truncated")),
        "field_values": values,
        "translations": of("definj").select("def_type", "def_name", "path", "translated", empty("original").alias("original"), language.alias("language"), F.lit(None).cast("string").alias("source_mod"), F.lit("runtime").alias("origin")),
        "keyed": of("keyed").where("key <> ''").select("id", "key", "translated", empty("original").alias("original"), language.alias("language"), "source_file", "source_line", F.lit(None).cast("string").alias("source_mod"), F.coalesce("placeholder", F.lit(False)).alias("placeholder"), F.lit("runtime").alias("origin")),
        "xml_nodes": of("xmlnode").select("id", "def_type", "name", "parent_name", F.coalesce("abstract", F.lit(False)).alias("abstract"), "def_name", "label", "source_mod", "source_file", F.coalesce("patch_ops", F.lit(0)).alias("patch_ops")),
        "mods": spark.createDataFrame([(i, *m) for i, m in enumerate(meta.mods)], "ordinal int, package_id string, name string, version string"),
    }


def import_export(spark: SparkSession, source: str, target: str, harvested: dict[str, DataFrame] | None = None, content: dict[str, str] | None = None) -> Snapshot:
    """Imports an export: checks it, adds harvested texts, and publishes the snapshot at target.

    Tables are written to a folder beside target that takes its name last of all, so that what
    stands at target is whole. content: the mods' content fingerprints; without it they count as
    not measured.
    """
    lines = read_lines(spark, source)
    meta = check_complete(lines)
    raw = parse(lines, meta)
    for name, more in (harvested or {}).items():
        raw[name] = raw[name].unionByName(more, allowMissingColumns=True)
    facts = {"export_meta_json": meta.raw, "source_file": source, "language": meta.language, "game_version": meta.game_version, "imported_from_records": str(lines.count())}
    facts["list_fingerprint"] = list_fingerprint(m[0] for m in meta.mods)
    if content is not None:
        facts["content_fingerprint"] = json.dumps(content, sort_keys=True)
    unfinished = target.rstrip("/") + ".partial"
    jvm = spark._jvm.org.apache.hadoop.fs
    place, final = jvm.Path(unfinished), jvm.Path(target)
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(place, True)
    try:
        publish(facts, raw, unfinished)
        store.delete(final, True)
        if not store.rename(place, final):
            raise SnapshotError(f"{target} can't be published")
    finally:
        store.delete(place, True)
    return open_snapshot(spark, target)
