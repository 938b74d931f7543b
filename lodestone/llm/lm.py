"""Cross-entropy difference: two n-gram models over one vocabulary, and the losses between them.

Pairs of tokens are counted exactly, in a table that grows with the corpus and stays distributed.
Texts are coded once and kept in chunks of neighbouring rows; a chunk asks for the counts of its
different pairs only, and these come back to it by a join.

The two models are matched: same order, vocabulary and smoothing, both with a boundary symbol
before and after each text, and neither counts a text while it scores it. They are not matched
in size: the background is the whole corpus. A document's copies do count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import id_field, record, slices, texts, two_columns, written
from lodestone.llm.rows import member_filter, split_by

CHUNK = 1 << 20
"""Tokens after which a chunk of texts ends."""
SLICE = 2 << 20
"""Text bytes that are coded at once."""
STEP = 1 << 18
"""Bytes of codes that are scored at once."""
PULL = 30.0
"""Pairs that the single-token model counts for after every token."""


def cells_of(codes: np.ndarray, before: np.ndarray, n_tokens: int) -> np.ndarray:
    """A number of its own for each token's pair with the token before it."""
    return before.astype(np.int64) << 32 | codes.astype(np.int64)


def kind_of(n_tokens: int) -> str:
    """The type in which tokens are kept."""
    return "<u2" if n_tokens <= 1 << 16 else "<u4"


def joined(parts: list[bytes], n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts in one array, the token before each, and the texts' lengths.

    A text that has tokens ends in the boundary n_tokens, which also stands before its first.
    """
    kind = np.dtype(kind_of(n_tokens))
    lengths = np.array([len(p) // kind.itemsize for p in parts], np.int64)
    lengths += lengths > 0
    own = np.ones(int(lengths.sum()), bool)
    own[np.cumsum(lengths)[lengths > 0] - 1] = False
    codes = np.full(len(own), n_tokens, np.int64)
    codes[own] = np.frombuffer(b"".join(parts), kind)
    return codes, np.append(n_tokens, codes[:-1])[: len(codes)], lengths


def own_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each code occurs in its own text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    _, place, n = np.unique(text << 32 | codes, return_inverse=True, return_counts=True)
    return n[place]


def coded(docs: DataFrame, vocabulary: str, n_tokens: int, id_type: str) -> DataFrame:
    """row, chunk, doc_id, codes: the tokens of every row, written to the shared folder.

    row numbers the rows in their order; a chunk is a run of rows and has its first row's number.
    """
    kind, most = np.dtype(kind_of(n_tokens)), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        chunk, held = None, 0
        for batch in slices(batches, limit=SLICE):
            parts = [np.frombuffer(model.ids(t), "<u4").astype(kind).tobytes() if t else b"" for t in texts(batch)]
            chunks = []
            for row, part in zip(batch.column(0).to_pylist(), parts, strict=True):
                if chunk is None or held >= most:
                    chunk, held = row, 0
                chunks.append(chunk)
                held += len(part) // kind.itemsize
            yield record({"row": batch.column(0), "chunk": pa.array(chunks, pa.int64()), "doc_id": batch.column(1), "codes": pa.array(parts, pa.binary())})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(rows.mapInArrow(run, f"row long, chunk long, doc_id {id_type}, codes binary"), "codes")


def pair_counts(rows: DataFrame, n_tokens: int) -> DataFrame:
    """chunk, pair, n: how often each different pair occurs in runs of rows of a chunk (of a task, if rows have no chunk)."""
    by_chunk = "chunk" in rows.columns
    wide = np.dtype(kind_of(n_tokens)).itemsize * CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            codes, before, _ = joined(held, n_tokens)
            pair, n = np.unique(cells_of(codes, before, n_tokens), return_counts=True)
            return record({"chunk": pa.array(np.full(len(pair), at, np.int64)), "pair": pa.array(pair), "n": pa.array(n.astype(np.int64))})

        held, size, at = [], 0, 0
        for batch in batches:
            chunks = batch.column(1).to_pylist() if by_chunk else [0] * batch.num_rows
            for part, chunk in zip(batch.column(0).to_pylist(), chunks, strict=True):
                if size and (chunk != at or not by_chunk and size >= wide):
                    yield counted()
                    held, size = [], 0
                at = chunk
                if part:
                    held.append(part)
                    size += len(part)
        if size:
            yield counted()

    return rows.select("codes", *["chunk"] * by_chunk).mapInArrow(run, "chunk long, pair long, n long")


class Bigrams:
    """Token pairs, smoothed by single tokens, those by equal shares; the boundary is a token like any other."""

    def __init__(self, found: np.ndarray):
        """found: how often each token occurs, and last, how many texts have tokens."""
        self.found = found.astype(np.float64)
        self.total = float(self.found.sum())

    def losses(self, codes: np.ndarray, before: np.ndarray, pairs: np.ndarray, less: tuple = (0, 0, 0, 0)) -> np.ndarray:
        """Bits that each token takes; pairs: how often the token's pair occurs.

        less: what is to be taken off the counts of the token, of the one before it, of the pair
        and of all tokens.
        """
        own, own_before, own_pair, own_total = less
        single = (self.found[codes] - own + 1) / (self.total - own_total + len(self.found))
        return np.log2(self.found[before] - own_before + PULL) - np.log2(pairs - own_pair + PULL * single)


def singles(table: DataFrame, n_tokens: int) -> list[np.ndarray]:
    """How often each token occurs, and texts with tokens, by the background's and the target's pairs.

    Every token is the second of one pair. The driver gets a row for each token at most.
    """
    tokens = table.groupBy(F.col("pair").bitwiseAND((1 << 32) - 1).alias("token")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    found = tokens.toArrow()
    out = []
    for name in ("n", "n_target"):
        out.append(np.zeros(n_tokens + 1, np.int64))
        out[-1][found.column("token").to_numpy()] = found.column(name).to_numpy()
    return out


def scores(docs: DataFrame, target: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of docs, in the order of docs.

    target: a column id_col with the ids of the rows that are as wanted. Its model counts
    their texts, the background's all texts; both count all they have, over the vocabulary's
    tokens and the boundary. While a row is scored its own text is taken off both (off the
    target's if it is target). Losses are mean bits a token, the boundary after the text
    included; score is the target's less the background's: the lower, the more like the target.
    A text without tokens (null, empty) has no losses or score.
    Null ids are never target. Repeated rows are kept, one row each, and all count; an empty
    table gives an empty one. Other columns are not read.
    """
    id_type = id_field(docs, id_col)
    model = bpe.load(vocabulary)
    n_tokens = max(*model.ranks.values(), *model.special.values()) + 1
    rows = coded(two_columns(docs, id_col, text_col), vocabulary, n_tokens, id_type)
    wanted = target.select(F.col(f"`{id_col}`").alias("doc_id")).where("doc_id is not null").distinct()
    maybe, _ = split_by(rows.select("codes", "doc_id", "chunk", "row"), member_filter(wanted, "doc_id"), "doc_id")
    marks = maybe.select("doc_id", "chunk", "row").join(wanted, "doc_id", "left_semi").select("chunk", (-1 - F.col("row")).alias("pair"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_target"))
    asked = written(pair_counts(rows, n_tokens), "asked")
    liked = pair_counts(maybe.select("codes", "doc_id").join(wanted, "doc_id", "left_semi"), n_tokens).groupBy("pair").agg(F.sum("n").alias("n_target"))
    table = asked.groupBy("pair").agg(F.sum("n").alias("n")).join(liked, "pair", "left")
    table = written(table.select("pair", "n", F.coalesce("n_target", F.lit(0)).cast("long").alias("n_target")), "pairs")
    background, wished = (Bigrams(c) for c in singles(table, n_tokens))
    sent = docs.sparkSession.sparkContext.broadcast((wished, background))
    schema = f"row long, doc_id {id_type}, n_tokens long, target_loss double, background_loss double"

    def score(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        bpe.load.cache_clear()  # the worker has coded its texts
        pairs, first = np.unique(answers.column("pair").to_numpy(), return_index=True)
        counts = [answers.column(name).to_numpy()[first].astype(np.float64) for name in ("n_target", "n")]
        rows, parts = texts_of.column("row").to_numpy(), texts_of.column("codes").to_pylist()
        # Negative pairs name the target's rows.
        shares = (np.isin(-1 - rows, pairs[: np.searchsorted(pairs, 0)]).astype(np.int64), np.ones(len(rows), np.int64))
        part_of = np.cumsum([len(p) for p in parts]) // STEP
        lengths, means = [], ([], [])
        for step in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(part_of)) + 1):
            codes, before, n = joined([parts[i] for i in step], n_tokens)
            at = np.searchsorted(pairs, cells_of(codes, before, n_tokens))
            some = n > 0
            starts = (np.cumsum(n) - n)[some]
            lengths.append(n)
            own, own_pair, own_total = own_counts(codes, n), own_counts(at, n), np.repeat(n, n)
            own_before = np.append(1, own[:-1])[: len(own)]  # a token is as often before another as it occurs; a boundary once
            for m, count, share, out in zip(sent.value, counts, shares, means, strict=True):
                mean = np.zeros(len(n))
                if len(starts):
                    counted = np.repeat(share[step], n)
                    less = tuple(x * counted for x in (own, own_before, own_pair, own_total))
                    mean[some] = np.add.reduceat(m.losses(codes, before, count[at], less), starts) / n[some]
                out.append(mean)
        n = np.concatenate(lengths)
        target_loss, background_loss = (pa.array(np.concatenate(m), pa.float64(), mask=n == 0) for m in means)
        return pa.table({"row": texts_of.column("row"), "doc_id": texts_of.column("doc_id"), "n_tokens": pa.array(n - (n > 0)), "target_loss": target_loss, "background_loss": background_loss})

    answers = asked.select("chunk", "pair").join(table, "pair").select("chunk", "pair", "n", "n_target").union(marks)
    out = written(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema), "losses")
    return out.orderBy("row").drop("row").withColumn("score", F.col("target_loss") - F.col("background_loss"))
