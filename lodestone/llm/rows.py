"""Row numbers, bounded membership filters and connected components, for operators that come back to a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, shared_dir, two_columns, written

FILTER_BITS = 26
"""log2 of the bits of a membership filter: 8 MB, whatever the number of members."""


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text: every row with a number of its own, stored with it in the shared folder.

    The number is given once, when the table is written; whoever comes back reads it. Nothing
    rests on how a later scan splits its files, which changes as executors come and go.
    """
    return written(two_columns(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "rows")


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """docs as written to the shared folder, with a stored number for every row in the column `name`."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, made longer until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


HOT, LEAST_HOT = 1_000, 1_000
"""A key is hot if it has one in HOT of all rows, and LEAST_HOT at least: there are never more than HOT such keys."""


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with table by key, a hot key dealt over many tasks.

    table: one row for each key, and in the column `size` how many of the `total` rows have it.
    The hot keys, HOT at most, are broadcast; their rows get a part by their content's hash, and
    the table's row is repeated for each part. Rows with a null key are dealt out alike.
    """
    parts = F.when((F.col("size") >= LEAST_HOT) & (F.col("size") * HOT >= total), F.ceil(F.col("size") * HOT / F.lit(max(total, 1))).cast("long"))
    hot = table.withColumn("__parts", parts).where(F.col("__parts") > 1).select(F.col(key).alias("__hot"), "__parts")
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = dealt.withColumn("__part", F.when(F.col(key).isNull(), mixed).otherwise(F.coalesce(F.pmod(mixed, F.col("__parts")), F.lit(0)))).drop("__hot", "__parts")
    copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts - 1, F.lit(0))))).drop("size")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


def member_filter(members: DataFrame, column: str = "row") -> np.ndarray:
    """A bitmap with a bit for the hash of each member: a Bloom filter of one hash and fixed size.

    However many members there are, the driver gets 8 MB at most. Beyond a few hundred million
    members it lets most rows through, and what follows it (always an exact join) costs more.
    """
    bit = F.expr(f"xxhash64({column}) & {(1 << FILTER_BITS) - 1}")
    words = members.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def split_by(rows: DataFrame, bitmap: np.ndarray, column: str = "row") -> tuple[DataFrame, DataFrame]:
    """The rows that may be members, and those that certainly aren't."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    tested = rows.withColumn("__bit", F.expr(f"xxhash64({column}) & {(1 << FILTER_BITS) - 1}"))

    def kept(member: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                bit = batch.column(batch.num_columns - 1).to_numpy()
                found = (sent.value[bit >> 6] >> (bit & 63)) & 1 == int(member)
                yield batch.filter(pa.array(found)).select(list(range(batch.num_columns - 1)))

        return tested.mapInArrow(run, rows.schema)

    return kept(True), kept(False)


FEW = 1 << 18
"""Members that may be broadcast as they are (2 MB of numbers); more are told by a membership filter."""


def maybe_members(rows: DataFrame, members: DataFrame, column: str = "row") -> DataFrame:
    """The rows that may be members: just those if they are few, which is counted, else those that the filter lets through."""
    members = written(members.select(column), "members")
    if members.count() <= FEW:
        return rows.join(F.broadcast(members), column, "left_semi")
    return split_by(rows, member_filter(members, column), column)[0]


def without_members(rows: DataFrame, members: DataFrame, column: str = "row") -> DataFrame:
    """The rows that are no members, exactly: few members, which is counted, are broadcast; else the rows that the filter can't tell are joined, and no others are shuffled."""
    members = written(members.select(column), "members")
    if members.count() <= FEW:
        return rows.join(F.broadcast(members), column, "left_anti")
    maybe, others = split_by(rows, member_filter(members, column), column)
    return others.unionAll(maybe.join(members, column, "left_anti").select(*rows.columns))


FEW_LINKS = 1 << 18
"""Links whose components one task finds (4 MB of numbers); more are taken in steps over the cluster."""


def components_at_once(edges: DataFrame) -> DataFrame:
    """components() of at most FEW_LINKS different edges (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = top(u), top(v)
                above[max(u, v)] = min(u, v)
        if above:
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(above), pa.int64()), "root": pa.array(map(top, list(above)), pa.int64())})

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (a, b), with the smallest node that it can reach.

    Up to FEW_LINKS, which is counted, one task finds them. Beyond, alternating large and small
    stars: each step hangs nodes under smaller ones, in joins and aggregations on nodes alone,
    until nothing changes; the number of steps grows with the logarithm of a component's size.
    Each step is cut from its lineage in the shared folder.
    """
    shared_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    state, total = None, edges.count()
    if total <= FEW_LINKS:
        return components_at_once(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("size"))
        large = spread_join(both.where("v > u"), least, "u", total, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = spread_join(large, down, "u", total, "inner").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = small.checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, total = now, now[0]
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))
