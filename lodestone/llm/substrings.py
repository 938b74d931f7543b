"""Exact repeated passages: fixed-block anchors, probed by every rolling window, extended to whole repeats.

Any repeat of `width` words covers a whole block of about half as many words, whichever row's
blocks are laid out from word 0 on. So the non-overlapping blocks of all rows are the index, and
each row's rolling windows of a block's size are the probes. A hit is extended on both sides:
the windows of `width` words that hold it are compared by two independent 64-bit hashes of all
their words, and neighbouring ones that repeat add up to maximal repeats. A block's 64-bit hash
that happens to meet another's only adds windows to compare.

Probes travel packed: a chunk of texts sends a bucket one row with its hashes and places, not a
row for each window. What repeats inside a chunk is sent once, so a passage that a third of all
rows share adds one entry for each chunk, not for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_field, ids, record, slices, spans_of, texts, window_hashes, word_hashes, written
from lodestone.llm.rows import member_filter, numbered, split_by

WIDTH = 35
BUCKET_BYTES = 6 << 20
"""Text whose windows meet in one bucket, about."""

REQUEST = "bucket long, chunk long, hashes binary, places binary, flags binary, checks binary"
REPLY = "chunk long, places binary, rows binary, starts binary"
SEED = 0x5EED
"""Of the words' second hash."""
ONE, MANY = 1, 2
ANCHOR = 4


def words_of(text: str | None) -> list[bytes]:
    """What stands between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def planes(x: np.ndarray) -> bytes:
    """Little-endian integers, first bytes first: sorted ones compress better so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def bucket_bits(docs: DataFrame, text_col: str = "text") -> int:
    """log2 of the number of buckets: so many that each gets a bounded share of the windows."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return int(np.ceil(np.log2(max(32, size / BUCKET_BYTES))))


def requests(rows: DataFrame, windows: Callable, bits: int, kind: type) -> DataFrame:
    """What each chunk asks of each bucket, and one row with what it knows itself (bucket: -1 - chunk).

    windows: gives for a batch the number of places of each row, and of all places that matter
    the place, hash, a second hash (or none), and whether it is an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        top, wide = np.uint64(64 - bits), np.uint64(64 - bits - 8 * np.dtype(kind).itemsize) if bits + 8 * np.dtype(kind).itemsize < 64 else np.uint64(0)
        for batch in slices(batches):
            chunk += 1
            sizes, place, h, check, anchor = windows(batch)
            order = np.argsort(h) if check is None else np.lexsort((check, h))
            h = h[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            if check is not None:
                check = check[order]
                first[1:] |= check[1:] != check[:-1]
            heads = np.flatnonzero(first)
            times = np.diff(np.append(heads, len(h)))
            flags = np.where(times > 1, MANY, ONE).astype(np.uint8)
            if len(heads):
                flags |= np.where(np.logical_or.reduceat(anchor[order], heads), ANCHOR, 0).astype(np.uint8)
            # A hash that repeats in the chunk needs no answer.
            own = order[np.repeat(times > 1, times)] if len(heads) else order
            places = np.where(times == 1, place[order[heads]] if len(heads) else 0, 0).astype(np.uint32)
            unique = h[heads]
            low = (unique >> wide).astype(kind)
            at = np.searchsorted(unique >> top, np.arange((1 << bits) + 1, dtype=np.uint64)) if len(unique) else np.zeros((1 << bits) + 1, np.int64)
            used = np.flatnonzero(np.diff(at))
            out = {"bucket": [-1 - chunk], "chunk": [chunk], "hashes": [np.asarray(ids(batch, "row").to_numpy(), np.int64).tobytes()], "places": [np.sort(place[own]).astype(np.uint32).tobytes()], "flags": [np.asarray(sizes, np.int64).tobytes()], "checks": [b""]}
            for b in used.tolist():
                cut = slice(at[b], at[b + 1])
                for key, value in zip(out, (b, chunk, planes(low[cut]), planes(places[cut]), flags[cut].tobytes(), b"" if check is None else check[heads[cut]].tobytes()), strict=True):
                    out[key].append(value)
            yield record({k: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for k, v in out.items()})

    return rows.mapInArrow(run, REQUEST)


def answers(asked: DataFrame, kind: type, anchored: bool) -> DataFrame:
    """row, starts: the places of each row whose window occurs again (and is somewhere an anchor, if anchored)."""

    def meet(table: pa.Table) -> pa.Table:
        bucket, chunk, hashes, places, flags, checks = (table.column(c).to_pylist() for c in ("bucket", "chunk", "hashes", "places", "flags", "checks"))
        if bucket[0] < 0:
            return pa.table({"chunk": pa.array(chunk, pa.int64()), "places": pa.array(places, pa.binary()), "rows": pa.array(hashes, pa.binary()), "starts": pa.array(flags, pa.binary())})
        h = np.concatenate([from_planes(x, kind) for x in hashes])
        flag = np.concatenate([np.frombuffer(x, np.uint8) for x in flags])
        check = np.frombuffer(b"".join(checks), np.uint64)
        order = np.lexsort((check, h)) if len(check) else np.argsort(h, kind="stable")
        s = h[order]
        new = np.append(True, s[1:] != s[:-1])
        if len(check):
            new[1:] |= check[order[1:]] != check[order[:-1]]
        head = np.flatnonzero(new)
        hit = np.add.reduceat((flag[order] & 3).astype(np.int64), head) > 1
        if anchored:
            hit &= np.bitwise_or.reduceat(flag[order], head) & ANCHOR > 0
        found = np.zeros(len(h), bool)
        found[order] = np.repeat(hit, np.diff(np.append(head, len(s))))
        found &= flag & 3 == ONE
        out_chunk, out = [], []
        at = 0
        for c, p in zip(chunk, places, strict=True):
            place = from_planes(p, np.uint32)
            mine = place[found[at : at + len(place)]]
            at += len(place)
            if len(mine):
                out_chunk.append(c)
                out.append(mine.tobytes())
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "places": pa.array(out, pa.binary()), "rows": pa.nulls(len(out), pa.binary()), "starts": pa.nulls(len(out), pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows, starts = table.column("rows").to_pylist(), table.column("starts").to_pylist()
        own = next(i for i, r in enumerate(rows) if r is not None)
        row, size = np.frombuffer(rows[own], np.int64), np.frombuffer(starts[own], np.int64)
        place = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()])).astype(np.int64)
        base = np.append(0, np.cumsum(size))
        at = np.searchsorted(place, base)
        used = np.flatnonzero(np.diff(at))
        return pa.table({"row": pa.array(row[used]), "starts": pa.array([(place[at[i] : at[i + 1]] - base[i]).astype(np.uint32).tobytes() for i in used], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(meet, REPLY).groupBy("chunk").applyInArrow(gather, "row long, starts binary")


def repeats(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, starts: where windows of `width` words begin whose words also begin somewhere else (uint32, packed).

    rows: a numbered table. Repeats are told by 128 bits, of two hashes that share nothing.
    """
    block = (width + 1) // 2
    bits = bucket_bits(rows)

    def probes(batch: pa.RecordBatch):
        sizes, place, h, base = [], [], [], 0
        for text in texts(batch):
            words = words_of(text)
            if len(words) >= width:
                w = window_hashes(word_hashes(words), block)
                place.append(np.arange(base, base + len(w)))
                h.append(w)
                sizes.append(len(w))
                base += len(w)
            else:
                sizes.append(0)
        if not h:
            return sizes, np.empty(0, np.int64), np.empty(0, np.uint64), None, np.empty(0, bool)
        within = np.concatenate([np.arange(len(w)) for w in h])
        return sizes, np.concatenate(place), np.concatenate(h), None, within % block == 0

    hits = written(answers(requests(rows, probes, bits, np.uint32), np.uint32, True), "anchors")
    maybe, _ = split_by(rows.select("row", "text"), member_filter(hits))
    near = maybe.join(hits, "row")

    def extended(batch: pa.RecordBatch):
        sizes, place, h, check, base = [], [], [], [], 0
        for text, packed in zip(texts(batch), texts(batch, "starts"), strict=True):
            words = words_of(text)
            n = len(words) - width + 1
            hit = np.zeros(len(words) + 1, bool)
            hit[np.frombuffer(packed, np.uint32)] = True
            after = np.append(0, np.cumsum(hit))
            start = np.flatnonzero(after[np.minimum(np.arange(n) + width - block + 1, len(after) - 1)] > after[:n])
            place.append(base + start)
            h.append(window_hashes(word_hashes(words), width)[start])
            check.append(window_hashes(word_hashes(words, SEED), width)[start])
            sizes.append(n)
            base += n
        return sizes, np.concatenate(place), np.concatenate(h), np.concatenate(check), np.ones(sum(map(len, h)), bool)

    return written(answers(requests(near, extended, bits, np.uint64), np.uint64, False), "repeats")


def removed(text: str | None, starts: bytes | None, width: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them lie in a window that begins at one of the starts."""
    words = words_of(text)
    edge = np.zeros(len(words) + 1, np.int64)
    if starts:
        at = np.frombuffer(starts, np.uint32)
        edge[at] += 1
        np.add.at(edge, at.astype(np.int64) + width, -1)
    return words, np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept (its text, if keep_text), kept_sha256 for every row of docs.

    Every word that a repeated window of `width` words covers is removed, at all places where
    the window stands; windows are judged on the input. Words are unchanged runs of what isn't
    ASCII white space. spans are the removed (first, end) words; kept joins the other words by
    one space. Null and empty texts have no words. Repeated rows repeat each other's windows, so
    both lose them. Null ids are kept; an empty table gives an empty one. Other columns are not
    read. The rows without repeats don't travel: they are digested where they are read.
    """
    rows = numbered(docs, id_col, text_col)
    found = repeats(rows, width)
    maybe, clean = split_by(rows.select("row", "doc_id", "text"), member_filter(found))
    schema = f"doc_id {id_field(rows, 'doc_id')}, n_words long, n_removed long, spans array<struct<first:long,end:long>>" + ", kept string" * keep_text + ", kept_sha256 string"
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, lost, spans, kept = [], [], [], []
            for text, starts in zip(texts(batch), texts(batch, "starts"), strict=True):
                words, gone = removed(text, starts, width)
                n.append(len(words))
                lost.append(int(gone.sum()))
                spans.append([{"first": a, "end": b} for a, b in spans_of(gone)] if lost[-1] else [])
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if lost[-1] else words))
            out = {"doc_id": ids(batch), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "spans": pa.array(spans, span)}
            if keep_text:
                out["kept"] = pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())
            yield record(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    joined = maybe.join(found, "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, schema).union(clean.select("doc_id", "text", F.lit(None).cast("binary").alias("starts")).mapInArrow(run, schema))
