"""Benchmark decontamination: a generalised suffix automaton of test items, streamed over documents."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, id_field, ids, record, slices, spans_of, texts, two_columns, written

WINDOW = 10
"""Consecutive item words that count as an occurrence; a shorter item counts whole."""

BLOCK_BYTES = 4 << 20
"""Item text in one automaton, about; a larger benchmark makes several, which each task takes in turn."""
HELD_BYTES = 16 << 20
"""Text that a task holds while it takes several automata in turn."""

# Lower-cases A-Z; every other ASCII character that is no letter or digit becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over the items' words, with the items of every window.

    Each state stands for the word sequences with the same end places; `link` leads to the
    state of the longest suffix outside it, and `length` is its longest sequence.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for _, words in items:
            coded.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            self._add(coded[-1])
        self.full: dict[int, set[int]] = {}  # state that holds a whole window -> items
        self.short: dict[int, dict[int, set[int]]] = {}  # state -> length of a short item -> items
        sizes = {min(len(c), window) for c in coded if c}
        self.least = min(sizes, default=window)
        for k, codes in enumerate(coded):
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    self.full.setdefault(self._state_of(state, window), set()).add(k)
            if 0 < len(codes) < window:
                self.short.setdefault(self._state_of(state, len(codes)), {}).setdefault(len(codes), set()).add(k)
        pairs = {a * (len(self.vocabulary) + 1) + b for codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _state_of(self, state: int, n: int) -> int:
        """The state that holds the last n words of what led to `state`."""
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state

    def _add(self, codes: list[int]) -> None:
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the sequences that p reaches by c; q keeps the longer ones."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        state, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (start, end) and items, tracking the longest match at every word."""
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        hits, found = [], set()
        for at, c in enumerate(codes, 1):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c not in following[state]:
                continue
            state = following[state][c]
            matched += 1
            if matched >= window:
                hits.append((at - window, at))
                found |= self.full[self._state_of(state, window)]
            if self.short:
                up = state
                while up:
                    for n, items in self.short.get(up, {}).items():
                        if n <= matched:
                            hits.append((at - n, at))
                            found |= items
                    up = link[up]
        return hits, found

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur.

        Only runs of words of which every neighbouring pair is in some item are streamed:
        no occurrence crosses another pair.
        """
        mask = np.zeros(len(words), bool)
        found: set[int] = set()
        if len(words) < self.least or not self.vocabulary:
            return mask, found
        get = self.vocabulary.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = codes > 0
        together = known[:-1] & known[1:]
        at = np.flatnonzero(together)
        if len(at):
            keys = codes[at] * (len(self.vocabulary) + 1) + codes[at + 1]
            where = np.searchsorted(self.pairs, keys)
            together[at] = self.pairs[np.minimum(where, len(self.pairs) - 1)] == keys if len(self.pairs) else False
        runs = [(a, b + 1) for a, b in spans_of(together)]
        if self.least == 1:
            inside = np.zeros(len(words), bool)
            for a, b in runs:
                inside[a:b] = True
            runs += spans_of(known & ~inside)
        for a, b in runs:
            if b - a >= self.least:
                spans, items = self.stream(codes[a:b].tolist())
                for x, y in spans:
                    mask[a + x : a + y] = True
                found |= items
        return mask, found


class Items:
    """The automata of a benchmark, each over items of about BLOCK_BYTES, as broadcasts.

    Items are dealt to blocks by their hash, and a block's automaton is built on an executor and
    written to the shared folder; the driver sees one of them at a time. One automaton stays
    loaded in a worker. Of several, a worker holds one at a time and takes each in turn over
    HELD_BYTES of documents, so memory doesn't grow with the benchmark.
    """

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        spark = benchmark.sparkSession
        rows = two_columns(benchmark, id_col, text_col)
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-size // block_bytes))

        def built(table: pa.Table) -> pa.Table:
            found = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=str)
            automaton = Automaton([(name, words_of(text)) for name, text in found], window)
            return pa.table({"block": table.column("block").slice(0, 1), "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})

        dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"))
        stored = written(dealt.groupBy("block").applyInArrow(built, "block long, automaton binary"), "automata")
        names = [r.block for r in stored.select("block").orderBy("block").collect()]
        self.blocks: list[tuple[str, Broadcast]] = [(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(stored.where(F.col("block") == b).first().automaton))) for b in names]

    def automata(self) -> Iterator[Automaton]:
        for name, block in self.blocks:
            if _loaded.get("name") != name:
                _loaded.clear()
                _loaded.update(name=name, automaton=pickle.loads(block.value))
            yield _loaded["automaton"]

    def gathered(self, batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
        """Batches as they are to be scanned: as they come for one automaton, HELD_BYTES of text at a time for several."""
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, text_col):
            if len(self.blocks) < 2:
                yield batch
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)


_loaded: dict = {}


def scan(words_of_rows: list[list[bytes]], items: Items) -> tuple[list[np.ndarray], list[set]]:
    """Hit masks and item ids of a batch of rows."""
    masks = [np.zeros(len(w), bool) for w in words_of_rows]
    found: list[set] = [set() for _ in words_of_rows]
    for automaton in items.automata():
        for k, words in enumerate(words_of_rows):
            mask, items_hit = automaton.hits(words)
            if items_hit:
                masks[k] |= mask
                found[k] |= {automaton.names[i] for i in items_hit}
    return masks, found


def contamination(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated: which items' windows occur in each row, and in how many words.

    items: the ids of the items with an occurring window, as strings, sorted; the window is
    that of `items`. Null and empty texts have no words and no hits; so have items without
    words. Repeated items are all listed; an item whose id is null marks words and is not
    listed. Repeated rows and null doc_ids are kept, one row each. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items.gathered(batches):
            split = [words_of(t) for t in texts(batch)]
            masks, found = scan(split, items)
            hit = [int(m.sum()) for m in masks]
            yield record({
                "doc_id": ids(batch),
                "n_words": pa.array(map(len, split), pa.int64()),
                "n_hit": pa.array(hit, pa.int64()),
                "items": pa.array([sorted(str(x) for x in f if x is not None) for f in found], pa.list_(pa.string())),
                "contaminated": pa.array([n > 0 for n in hit], pa.bool_()),
            })

    return two_columns(docs, id_col, text_col).mapInArrow(rows, f"doc_id {id_field(docs, id_col)}, n_words long, n_hit long, items array<string>, contaminated boolean")


def digests(found: DataFrame) -> DataFrame:
    """The items of contamination() as their number and a SHA-256 digest."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def without(text: str, mask: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbouring ones."""
    flat = "".join(chr(WORD_BYTES[ord(c)]) if ord(c) < 128 else c for c in text)
    places, at = [], 0  # of the words in the text, by code points
    for w in flat.split(" "):
        if w:
            places.append((at, at + len(w)))
        at += len(w) + 1
    kept, at = [], 0
    for a, b in spans_of(mask):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def cut(old: list[str | None], items: Items, max_coverage: float) -> tuple[list[str | None], list[bool]]:
    """The texts without hit spans, and whether hits cover more than max_coverage of each one's words.

    Cutting can bring words together that make a new window, so it goes on until none is left.
    """
    new, bad = list(old), [False] * len(old)
    pending, first = [i for i, t in enumerate(old) if t], True
    while pending:
        masks, _ = scan([words_of(new[i]) for i in pending], items)
        changed = []
        for i, mask in zip(pending, masks, strict=True):
            if first and mask.any() and mask.mean() > max_coverage:
                bad[i] = True
            elif mask.any():
                new[i] = without(new[i], mask)
                changed.append(i)
        pending, first = changed, False
    return new, bad


def remove(docs: DataFrame, items: Items, text_col: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """docs without the spans of text_col that repeat benchmark windows.

    A row of which more than max_coverage of the words are hit is dropped. All columns are
    kept; only text_col changes. Null texts stay null, empty ones empty; repeated rows and null
    ids are cut alike, one row each. An empty table, or an empty benchmark, changes nothing.
    """
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items.gathered(batches, text_col):
            new, bad = cut(batch.column(at).to_pylist(), items, max_coverage)
            out = batch.set_column(at, text_col, pa.array(new, batch.schema.field(at).type))
            yield out.filter(pa.array([not x for x in bad], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)
