"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_AZ = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
"""bytes.translate table that lower-cases A-Z and nothing else."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

SLICE_BYTES = 8 << 20
"""Text bytes that one Python step holds as numpy arrays at once."""


BATCH_ROWS = 1_000
"""Rows of a batch that Spark hands to Python."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where neither the setting nor a checkpoint folder exists, a temporary one is made on a local
    master only: on a cluster the executors could not see it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet to the shared folder and read again. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python BATCH_ROWS at a time, so that a worker holds few of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def forget() -> None:
    """Frees what an earlier operator has left in a worker that Spark uses again: vocabularies and their caches."""
    bpe = sys.modules.get("lodestone.llm.bpe")
    if bpe and bpe.load.cache_info().currsize:
        bpe.load.cache_clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def id_field(df: DataFrame, id_col: str) -> str:
    """DDL type of the id column."""
    return df.schema[id_col].dataType.simpleString()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold about `limit` bytes, or are a single long text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str | None]:
    """The texts of a batch as Python strings."""
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    """The ids of a batch, whatever their type and nulls."""
    return batch.column(batch.schema.get_field_index(name))


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n different rows whose keys have the lowest hashes, or all if there are fewer.

    A first count of the different hashes sets a bound on the hash that lets through hardly more
    than n different rows, so that however many partitions there are, few rows meet in the last
    sort. Copies of a row don't count; where too few pass, the bound is doubled.
    """
    h = F.xxhash64(key)
    hashes = written(rows.select(h.alias("h")).distinct(), "hashes")
    total = hashes.count()
    if total > 2 * n:
        share = (1.5 * n + 100) / total
        while share < 1:
            bound = int(-(1 << 63) + share * (1 << 64))
            if hashes.where(F.col("h") < bound).count() >= n:
                rows = rows.where(h < bound)
                break
            share *= 2
    return rows.distinct().orderBy(h, key).limit(n)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word."""
    found = map(xxhash.xxh3_64_intdigest, words, repeat(seed)) if seed else map(xxhash.xxh3_64_intdigest, words)
    return np.fromiter(found, np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, so that it loses nothing."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for every `width` consecutive entries of h; built by doubling, so log2(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, step = None, 0, h, 1
    while True:
        if width & step:
            part = power[done : done + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(step))
            done += step
        if done == width:
            return out[:n] if out is not h else h[:n].copy()
        power = mix(power[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + power[step:] + np.uint64(step)) if len(power) > step else power[:0]
        step *= 2


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def record(columns: dict, schema: pa.Schema | None = None) -> pa.RecordBatch:
    """A batch of named columns."""
    return pa.RecordBatch.from_pydict(columns, schema=schema)
