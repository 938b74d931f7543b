"""Nested DataFrames as (entity, path, value) triples: what an export does to live objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.shared import stored

# The exporter's limits.
MAX_DEPTH, MAX_VALUES, MAX_LENGTH, MAX_ITEMS = 6, 5000, 400, 200
"""Depth of nesting (leaves don't count), values of an entity, characters of a value, items of a collection."""

CELL = "array<struct<path:string,value:string,lost:int>>"


def _cells(c: Column, kind: T.DataType, path: Column, depth: int) -> Column:
    """path, value, lost of everything below a column. Nulls give nothing; what a limit cuts off counts as lost."""
    none = F.expr(f"cast(array() as {CELL})")

    def cell(value: Column, lost: Column) -> Column:
        return F.array(F.struct(path.alias("path"), value.cast("string").alias("value"), lost.cast("int").alias("lost")))

    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and depth >= MAX_DEPTH:
        return F.when(c.isNotNull(), cell(F.lit(None), F.lit(1))).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [_cells(c[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), depth + 1) for f in kind]
        return F.when(c.isNotNull(), F.concat(*parts)).otherwise(none) if parts else none
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _cells(F.map_entries(c), T.ArrayType(entry), path, depth)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(F.slice(c, 1, MAX_ITEMS), lambda x, i: _cells(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1))
        over = F.when(F.size(c) > MAX_ITEMS, cell(F.lit(None), F.size(c) - MAX_ITEMS)).otherwise(none)
        return F.when(c.isNotNull(), F.concat(F.flatten(inner), over)).otherwise(none)
    text = c.cast("string")
    return F.when(c.isNotNull(), cell(F.substring(text, 1, MAX_LENGTH), (F.length(text) > MAX_LENGTH).cast("int"))).otherwise(none)


def flatten(df: DataFrame, def_type: str, name_col: str, defaults: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """defs and field_values of a nested DataFrame: an entity for each row, a field for each leaf value that isn't null.

    Structs give a.b, arrays and maps a[i] (a map's entries are key and value). fields_truncated
    is at least the number of values that the limits cut off. defaults: values by leaf path that
    count as default; fields without one are unknown. Rows are stored with their ids, which both
    results share.
    """
    from lodestone.functions.paths import shape

    rows = df.withColumn("__id", F.monotonically_increasing_id())
    parts = [_cells(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), 0) for f in df.schema if f.name != name_col]
    rows = rows.select(F.col("__id").alias("id"), F.col(f"`{name_col}`").cast("string").alias("def_name"), F.concat(*parts).alias("cells"))
    rows = stored(rows, "cells").withColumn("kept", F.filter("cells", lambda x: x["value"].isNotNull()))
    lost = F.aggregate("cells", F.lit(0), lambda a, x: a + x["lost"]) + F.greatest(F.size("kept") - MAX_VALUES, F.lit(0))
    none = F.lit(None).cast("string")
    defs = rows.select("id", F.lit(def_type).alias("def_type"), "def_name", none.alias("label"), none.alias("description"), none.alias("source_mod"), none.alias("source_file"), F.lit(False).alias("generated"), F.lit(def_type).alias("class"), lost.alias("fields_truncated"))
    values = rows.select(F.col("id").alias("def_id"), F.posexplode(F.slice("kept", 1, MAX_VALUES)).alias("seq", "c")).select("def_id", "seq", "c.path", "c.value")
    state = F.lit(2)
    for path, value in (defaults or {}).items():
        state = F.when(shape("path") == path, F.when(F.col("value") == value, 1).otherwise(0)).otherwise(state)
    return defs, values.withColumn("is_default", state.cast("byte"))


def patch_mentions(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with patch_ops: how often patches (column xml) name each in an @Name="..." test."""
    names = patches.select(F.explode(F.regexp_extract_all("xml", F.lit(r"@Name\s*=\s*[\"']([^\"']+)[\"']"), 1)).alias("name")).groupBy("name").agg(F.count("*").cast("int").alias("__n"))
    return nodes.drop("patch_ops").join(names, "name", "left").withColumn("patch_ops", F.coalesce("__n", F.lit(0))).drop("__n")
