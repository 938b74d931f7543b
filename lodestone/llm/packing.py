"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are range-sorted by length over the cluster, and placed there by their rank. The
rounds themselves work on counts, of at most `capacity` lengths and `capacity` gaps whatever the
number of documents, and so run in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import id_field, ids, record, shared_dir, slices, texts, two_columns, written
from lodestone.llm.rows import free_name

CAPACITY = 2048
BAND = 1.05
"""Lengths within this factor of the longest that waits are placed together."""
END = 0
"""The id that ends every document."""


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept): every row of docs as token pieces.

    A row's ids are those of its text, then END. Up to `capacity` of them make one piece; more
    are cut so that every piece but the first is full. start counts the row's ids before the
    piece; ids_crc32 is over its ids as little-endian unsigned 32-bit integers, and ids holds
    those bytes. A null or empty text is END alone. Null ids and repeated rows make pieces of
    their own; an empty table makes none. Other columns are not read.
    """
    end = np.array([END], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for batch in slices(batches):
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for k, text in enumerate(texts(batch)):
                codes = (model.ids(text) if text else b"") + end
                n = len(codes) // 4
                a, i = 0, 0
                while a < n:
                    b = a + ((n - a) % capacity or capacity)
                    part = codes[4 * a : 4 * b]
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        held.append(part)
                    a, i = b, i + 1
            out = {"doc_id": ids(batch).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield record(out | ({"ids": pa.array(held, pa.binary())} if keep_ids else {}))

    schema = f"doc_id {id_field(docs, id_col)}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return two_columns(docs, id_col, text_col).mapInArrow(rows, schema)


def successor_sweep(wanted: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """length, gap, sequences: which gaps a round gives to which lengths. Both lists are sorted: (length, pieces), (gap, sequences).

    Every length asks for its successors, the closest gaps at or above it, each of which it
    fills with as many pieces as fit. Several ask for one gap: the longest length, which ranks
    first, gets what it needs of it, and the next one what is left, or its next successor. No
    sequence is given twice in a round.
    """
    out, free = [], [n for _, n in gaps]
    values = [g for g, _ in gaps]
    onward = list(range(len(values) + 1))  # from a gap to the next one that may have sequences left

    def at(i: int) -> int:
        while i < len(values) and not free[i]:
            onward[i] = max(onward[i], i + 1)
            i = onward[i]
        return i

    for length, left in reversed(wanted):
        i = at(bisect_left(values, length))
        while i < len(values) and left:
            each = values[i] // length
            n = min(free[i], -(-left // each))
            out.append((length, values[i], n))
            free[i] -= n
            left -= min(left, n * each)
            i = at(i)
    return out


def rounds(classes: list[tuple[int, int]], capacity: int, band: float = BAND) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Bulk-synchronous best fit: the plan (length, first rank, first sequence, pieces a sequence, offset), and the rounds it took.

    classes: (length, pieces of it), one for each length. Pieces of one length differ in nothing
    but their rank, and so do sequences with one gap: the tables of a round are counts of
    lengths and of gaps. A round matches all of them by one successor sweep, places the pieces
    by rank, and moves the sequences to their new gaps. The longest pieces come first, within a
    factor `band` of each other; shorter ones wait until the longer ones are placed. When a
    round places nothing, as many new sequences are opened as the waiting ones fill at least.
    """
    left, rank = dict(sorted(classes)), dict.fromkeys((k for k, _ in classes), 0)
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    plan, opened, taken, least = [], 0, 0, capacity + 1

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            runs.setdefault(gap, []).append((first, n))

    while left:
        if (longest := max(left)) < least:
            least = min(longest, int(longest / band) + 1)
        active = sorted((k, n) for k, n in left.items() if k >= least)
        matched = successor_sweep(active, sorted((g, sum(n for _, n in held)) for g, held in runs.items()))
        taken += 1
        if not matched:
            n = max(-(-sum(k * n for k, n in active) // capacity), sum(n for k, n in active if 2 * k > capacity))
            put(capacity, opened, n)
            opened += n
            continue
        moved = []
        for length, gap, wanted in matched:
            each, held = gap // length, runs[gap]
            while wanted:
                first, n = held.pop()
                if n > wanted:
                    held.append((first + wanted, n - wanted))
                    n = wanted
                wanted -= n
                full = min(n, left[length] // each)
                rest = min(each, left[length] - full * each) if full < n else 0
                for start, m, pieces in ((first, full, each), (first + full, int(rest > 0), rest)):
                    if m:
                        plan.append((length, rank[length], start, pieces, capacity - gap))
                        rank[length] += m * pieces
                        left[length] -= m * pieces
                        moved.append((gap - pieces * length, start, m))
            if not held:
                del runs[gap]
            if not left[length]:
                del left[length]
        for gap, first, n in moved:
            put(gap, first, n)
    return plan, taken


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset: pieces placed in as few sequences of `capacity` as best fit finds.

    parts: a table with a column length from 1 to capacity; all its columns are kept (those
    named sequence_id and offset are replaced). Offsets in a sequence are gapless from 0.

    The pieces are range-sorted by length (ties by their place in the input, so a length that
    a third of the rows have is dealt over many tasks) and kept in the shared folder. From each
    partition the driver gets one count for each length in it: partitions plus capacity rows at
    most. The plan that it sends back has a few entries for each length.
    """
    shared_dir(parts.sparkSession)
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    place, number = free_name(parts, "place"), free_name(parts, "part")
    ranged = (
        written(parts.select(*kept), "pieces")
        .withColumn(place, F.monotonically_increasing_id())
        .repartitionByRange(F.col("length").desc(), place)
        .sortWithinPartitions(F.col("length").desc(), place)
        .drop(place)
        .checkpoint()
        .withColumn(number, F.spark_partition_id())
    )
    counts = ranged.groupBy(number, "length").count().toPandas().sort_values(number)
    before = counts.groupby("length")["count"].cumsum() - counts["count"]
    base = {(p, n): b for p, n, b in zip(counts[number].tolist(), counts["length"].tolist(), before.tolist(), strict=True)}
    plan, _ = rounds([(int(k), int(n)) for k, n in counts.groupby("length")["count"].sum().items()], capacity)
    order = sorted(plan)
    sent = parts.sparkSession.sparkContext.broadcast((base, np.array(order, np.int64).reshape(-1, 5)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, plan = sent.value
        steps = plan[:, 0] * (1 << 44) + plan[:, 1]
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            part = int(batch.column(batch.schema.get_field_index(number))[0].as_py())
            edge = np.flatnonzero(np.diff(length, prepend=-1))
            rank = np.arange(len(length), dtype=np.int64) - np.repeat(edge, np.diff(np.append(edge, len(length))))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(length)], strict=True):
                n = int(length[a])
                rank[a:b] += base[part, n] + seen.get(n, 0)
                seen[n] = seen.get(n, 0) + b - a
            _, first_rank, first, each, offset = plan[np.searchsorted(steps, length * (1 << 44) + rank, side="right") - 1].T
            nth = rank - first_rank
            keep = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(first + nth // each), pa.array(offset + nth % each * length)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in kept)
    return ranged.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, from pieces with their ids kept.

    ids holds the sequence's ids as little-endian unsigned 32-bit integers; doc_ids the ids of
    its documents, in their order.
    """
    part = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most `capacity` pieces
    return packed.groupBy("sequence_id").agg(part.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
