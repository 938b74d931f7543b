"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn with shallow trees of one feature, then round the best
pairs with trees of two; all trees of a feature (pair) add up to one lookup table. A score is
the sum of the tables' entries at a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, bounded_sample, id_field, ids, record, slices, texts, two_columns
from lodestone.llm.features import Counts

FEATURES = (
    "words", "word_length", "capitals", "digits", "marks", "symbols", "exclamations", "other_bytes", "line_words",
    "dup_lines", "repeat_words", "distinct_words", "commonest_word", "echoes", "commas", "periods", "bars", "byte_entropy",
)

SAMPLE = 20_000
"""Labelled rows to fit on at most: those whose ids have the lowest hashes."""


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null one counts as empty."""
    c = Counts(text)
    n, size = max(1, c.n_words), max(1, len(c.data))
    byte = np.bincount(np.frombuffer(c.data, np.uint8), minlength=256)
    share = byte[byte > 0] / size
    most, distinct, echoes = 0, 0, 0
    if c.n_words:
        _, found = np.unique(c.hashes, return_counts=True)
        most, distinct = int(found.max()), len(found)
        echoes = int((c.hashes[1:] == c.hashes[:-1]).sum())
    marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    return [
        np.log1p(c.n_words), c.word_chars / n, byte[65:91].sum() / size, byte[48:58].sum() / size, marks / size, c.n_symbols / size, byte[33] / n, byte[128:].sum() / size, np.log1p(n / max(1, c.n_lines)),
        c.n_dup_lines / max(1, c.n_lines), c.n_repeat_words / n, distinct / n, most / n, echoes / n, byte[44] / n, byte[46] / n, byte[124] / n, float(-(share * np.log2(share)).sum()),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of every row, as an array of doubles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record({"doc_id": ids(batch), "features": pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))})

    return two_columns(docs, id_col, text_col).mapInArrow(rows, f"doc_id {id_field(docs, id_col)}, features array<double>")


@dataclass
class Model:
    """intercept + sum of tables[i][bin of feature i] + sum of pairs[i, j][bin of i, bin of j]."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        if not len(x):
            return np.empty(0)
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree_1(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a tree of up to `leaves` leaves over one feature's bins, from gradient and weight sums."""
    cuts, out = [0, len(g)], np.zeros(len(g))
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gains = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                if gains.max() > best[0]:
                    best = (gains.max(), int(k[gains.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _tree_2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of two features' bins into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = (cg[-1, -1], ch[-1, -1])
    quadrants = []
    for c, t in ((cg, total[0]), (ch, total[1])):
        a, left, top = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        quadrants.append((a, left - a, top - a, t - left - top + a))
    gains = sum(_gain(x, y) for x, y in zip(*quadrants, strict=True)) - _gain(*total)
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    step = np.zeros_like(g)
    places = ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
    for where, x, y in zip(places, *quadrants, strict=True):
        step[where] = x[i, j] / (y[i, j] + 1.0)
    return float(gains[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, n_bins: int = 32, rate: float = 0.1, leaves: int = 3) -> Model:
    """The model of features x and labels y (0 or 1). Without rows, or with one label only, a constant."""
    width = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for i in range(width)]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges], {})
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    sizes = [len(e) + 1 for e in edges]
    z = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for i in range(width):
            g, h = residual()
            step = rate * _tree_1(np.bincount(b[:, i], g, sizes[i]), np.bincount(b[:, i], h, sizes[i]), leaves)
            model.tables[i] += step
            z += step[b[:, i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = residual()
        cell = b[:, i] * sizes[j] + b[:, j]
        return tuple(np.bincount(cell, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (g, h))

    gains = sorted(((_tree_2(*grid(i, j))[0], i, j) for i, j in combinations(range(width), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = rate * _tree_2(*grid(i, j))[1]
            model.pairs[i, j] += step
            z += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model learned from at most `sample` labelled rows that aren't held out.

    Of an id with several labels the lowest counts; null ids and labels are left out, and labels
    of ids without a document. Of an id with several documents all count, up to four times the
    sample: those whose features have the lowest hashes. An empty table, or labels of one class,
    give a constant.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", sample)
    rows = two_columns(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    got = measure(rows, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("features", "label").orderBy(F.xxhash64("features"), "features", "label").limit(4 * sample).toArrow()
    x = np.array(got.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y)) if len(x) else []
    return fit(x[order], y[order])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row: score is the probability of label 1 (0 to 1).

    Null and empty texts are scored by the features of an empty text. Repeated rows and null ids
    are kept, one row each; an empty table gives an empty one. Only id and text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in texts(batch)], float)
            yield record({"doc_id": ids(batch), "score": pa.array(sent.value.score(x))})

    out = two_columns(docs, id_col, text_col).mapInArrow(rows, f"doc_id {id_field(docs, id_col)}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores `least` or more, with all their columns.

    A null text scores as an empty one. Repeated rows and null ids are judged alike, one row
    each, texts of any length whole; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            score = sent.value.score(np.array([features(t) for t in texts(batch, text_col)], float))
            yield batch.filter(pa.array(score >= least))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)
