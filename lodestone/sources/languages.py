"""Language files of mods: UI texts by key and texts bound to entities."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYED, INJECTED = "Keyed", "DefInjected"


def package_id(folder: str) -> str:
    """The package id of a mod's About.xml, else the folder's name."""
    about = os.path.join(folder, "About", "About.xml")
    try:
        found = next((e.text for e in ET.parse(about).getroot().iter() if e.tag.lower() == "packageid" and e.text), None)
    except (OSError, ET.ParseError):
        found = None
    return (found or os.path.basename(folder.rstrip("/"))).strip()


def language_files(folder: str, language: str) -> list[tuple[str, str, str]]:
    """(kind, type, path) of a mod's language files: in its Languages folder and those one level down."""
    homes = [folder, *(e.path for e in os.scandir(folder) if e.is_dir())] if os.path.isdir(folder) else []
    out = []
    for home in homes:
        for kind in (KEYED, INJECTED):
            top = os.path.join(home, "Languages", language, kind)
            for at, _, names in sorted(os.walk(top)):
                kinds = os.path.relpath(at, top).split(os.sep)[0]
                out += [(kind, kinds if kind == INJECTED else "", os.path.join(at, n)) for n in sorted(names) if n.lower().endswith(".xml")]
    return list(dict.fromkeys(out))


def entries(xml: str) -> list[tuple[str, str]]:
    """Key and text of a language file's elements; a written \\n is a line break. A damaged file has none."""
    try:
        root = ET.fromstring(re.sub(r"^﻿", "", xml))
    except ET.ParseError:
        return []
    return [(e.tag, ("".join(e.itertext()) if not len(e) else " | ".join((c.text or "").strip() for c in e)).strip().replace("\\n", "\n")) for e in root]


def harvest(spark: SparkSession, mods: dict[str, str], language: str, listed: set[str]) -> dict[str, DataFrame]:
    """translations and keyed rows of the mods (id: folder); origin says whether the mod is in the list.

    The driver lists the files; executors read and parse them.
    """
    low = {i.lower() for i in listed}
    files = [(mod, kind, def_type, path) for mod, folder in sorted(mods.items()) for kind, def_type, path in language_files(folder, language)]
    wanted = spark.createDataFrame([(m, k, t, "file:" + os.path.abspath(p)) for m, k, t, p in files], "mod string, kind string, def_type string, path string")
    text = spark.read.format("binaryFile").load([p for *_, p in files]).select(F.col("path"), F.col("content").cast("string").alias("xml")) if files else spark.createDataFrame([], "path string, xml string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("mod", "kind", "def_type", "file", "key", "text", "line")}
            for mod, kind, def_type, path, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, (key, value) in enumerate(entries(xml or "")):
                    for name, x in zip(out, (mod, kind, def_type, path, key, value, i + 1), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "line" else pa.string()) for k, v in out.items()})

    found = wanted.join(text, "path").select("mod", "kind", "def_type", "path", "xml").mapInArrow(rows, "mod string, kind string, def_type string, file string, key string, text string, line int")
    origin = F.when(F.lower("mod").isin(*low) if low else F.lit(False), "harvested").otherwise("harvested_outside")
    injected = found.where(F.col("kind") == INJECTED).where(F.col("key").contains("."))
    return {
        "translations": injected.select("def_type", F.substring_index("key", ".", 1).alias("def_name"), F.expr("substring(key, instr(key, '.') + 1)").alias("path"), F.col("text").alias("translated"), F.lit(None).cast("string").alias("original"), F.lit(language).alias("language"), F.col("mod").alias("source_mod"), origin.alias("origin")),
        "keyed": found.where((F.col("kind") == KEYED) & (F.col("key") != "")).select(F.xxhash64("file", "line").bitwiseOR(F.lit(-(1 << 63))).alias("id"), "key", F.col("text").alias("translated"), F.lit(None).cast("string").alias("original"), F.lit(language).alias("language"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), F.col("mod").alias("source_mod"), (F.col("text") == "TODO").alias("placeholder"), origin.alias("origin")),
    }
