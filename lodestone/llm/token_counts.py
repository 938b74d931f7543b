"""Token counts at every prefix of a text (prefix dynamic programming)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import bounded_batches, id_field, ids, record, slices, texts, two_columns


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), steps: for every row of docs, the exact token count at every prefix.

    steps holds a signed byte for each byte of the text: the change of the count there, so the
    running sum at a byte that closes a character is the count of that prefix (see counts_at,
    longest_prefix). vocabulary: path of a byte-level BPE file for the library tokenizers; its
    special strings inside texts count as one token.

    A null text counts as empty, with no steps. Null ids and repeated rows are kept, one row
    each; an empty table gives an empty one. Other columns are not read.
    """

    return prefixes(docs, vocabulary, id_col, text_col).select("doc_id", "n_bytes", "steps")


def prefixes(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, if kept, steps: prefix_table() with the count at the last prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for batch in slices(batches):
            steps = [model.steps(t) if t else b"" for t in texts(batch)]
            out = {"doc_id": ids(batch), "n_bytes": pa.array([len(s) for s in steps], pa.int64()), "n_tokens": pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64())}
            yield record(out | ({"steps": pa.array(steps, pa.binary())} if keep_steps else {}))

    return two_columns(docs, id_col, text_col).mapInArrow(rows, f"doc_id {id_field(docs, id_col)}, n_bytes long, n_tokens long" + ", steps binary" * keep_steps)


def counts_at(steps: bytes) -> np.ndarray:
    """The token count after each byte of a text."""
    return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


def longest_prefix(steps: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters that takes at most `budget` tokens.

    Bytes inside a character repeat the count before it, so a cut must fall on a byte whose
    successor opens a character; callers that cut text decode with errors="ignore".
    """
    fits = np.flatnonzero(counts_at(steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def totals(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: the count at the last prefix of every row; nulls and repeats as in prefix_table."""
    return prefixes(docs, vocabulary, id_col, text_col, False).withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the longest prefix of whole characters that takes at most `budget` tokens.

    All rows and columns are kept; null and empty texts stay as they are. A text is encoded once,
    whatever the budget.
    """
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for batch in slices(batches, text_col):
            new = [t and t.encode()[: longest_prefix(model.steps(t), budget)].decode(errors="ignore") for t in texts(batch, text_col)]
            yield batch.set_column(at, text_col, pa.array(new, batch.schema.field(at).type))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)


def within_budget(prefixed: DataFrame, budgets: list[int]) -> DataFrame:
    """The rows of a prefix_table with `cuts`: for each budget, the bytes of the longest prefix that fits it.

    Many budgets are answered from the stored counts, without the texts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [[longest_prefix(s, b) for b in budgets] for s in texts(batch, "steps")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.list_(pa.int64()))], names=[*batch.schema.names, "cuts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prefixed.schema)
    return prefixed.mapInArrow(rows, f"{fields}, cuts array<long>")
