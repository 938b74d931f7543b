"""Quality rules: counts of each text, and language-specific bands of n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model over characters (code points),
one for every value of the language. Spark counts the n-grams of all texts, derives the lower
orders from the highest, and turns counts into probabilities with joins and windows; the tables
grow with the corpus and stay distributed. What is looked up is the model as arrays sorted by
hash: in one broadcast where its size has been checked, else by a join with each chunk of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, id_field, ids, mix, record, slices, texts, written
from lodestone.llm.features import Counts
from lodestone.llm.rows import spread_join

ORDER = 4
START, NUL = 0x10FFFF, 0x10FFFE
"""Code points that stand before a text, and for the code point 0."""
BROADCAST = 1 << 21
"""N-grams of all languages that may be broadcast (12 bytes each); a larger model is joined."""
HELD, STEP = 1 << 19, 1 << 20
"""Different n-grams that a task sums up before it hands them on, and text bytes that it codes at once."""
CHUNK = 16 << 20
"""Code points whose different n-grams are asked for together, where the model is joined."""

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPREAD = 1.25
"""Interquartile ranges between a language's median perplexity and either end of its band."""
SHORT = 2.5
"""Bits by which a band widens for short texts, over the root of their code points."""


def tongue(lang: Column) -> Column:
    """The language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def coded(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, ORDER - 1 times START before each, and the places of the texts' own."""
    lead = chr(START) * (ORDER - 1)
    codes = np.frombuffer("".join([lead + t for t in found]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes == 0, np.uint32(NUL), codes)
    sizes = np.array([len(t) for t in found], np.int64)
    own = np.arange(int(sizes.sum())) + np.repeat((ORDER - 1) * np.arange(1, len(sizes) + 1), sizes)
    return codes, own


def hashes(codes: np.ndarray, own: np.ndarray, key: str) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each place, different for each language."""
    if not len(own):
        return np.empty(0, np.uint64)
    n, c = len(codes) - ORDER + 1, codes.astype(np.uint64)
    h = np.uint64(xxhash.xxh3_64_intdigest(key))
    for first in range(0, ORDER, 3):  # three code points are 63 bits
        packed = c[first : first + n].copy()
        for k in range(1, min(3, ORDER - first)):
            packed |= c[first + k : first + k + n] << np.uint64(21 * k)
        packed += h
        h = mix(packed)
    return h[own - ORDER + 1]


class Lookup:
    """Values by hash: arrays sorted by hash, and where the hashes with the same first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys: sorted and different."""
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - bits)
        self.begin = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes that are all among the keys."""
        at = self.begin[h >> self.shift]
        rest = np.flatnonzero(self.keys[at] != h)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] != h[rest]]
        return self.values[at]


def by_language(batch: pa.RecordBatch) -> dict[str, list[int]]:
    """The rows of each language that have text."""
    out: dict[str, list[int]] = {}
    for i, (key, text) in enumerate(zip(texts(batch, "tongue"), texts(batch), strict=True)):
        if text:
            out.setdefault(key, []).append(i)
    return out


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """tongue, gram, n: how often each n-gram of ORDER characters occurs in all texts of a language."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        held: list[tuple[np.ndarray, ...]] = []  # hash, code points, language, count

        def summed() -> tuple[np.ndarray, ...]:
            h, gram, lang, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            start = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
            first = order[start]
            return h[first], gram[first], lang[first], np.add.reduceat(n[order], start)

        def handed() -> pa.RecordBatch:
            _, gram, lang, n = held[0]
            text = np.ascontiguousarray(gram).view(f"<U{ORDER}").reshape(-1)
            return record({"tongue": pa.array(keys, pa.string()).take(pa.array(lang)), "gram": pa.array(text, pa.string()), "n": pa.array(n)})

        for batch in slices(batches, limit=STEP):
            text = texts(batch)
            for key, at in by_language(batch).items():
                if key not in keys:
                    keys.append(key)
                codes, own = coded([text[i] for i in at])
                h, first, n = np.unique(hashes(codes, own, key), return_index=True, return_counts=True)
                gram = np.stack([codes[own[first] - ORDER + 1 + k] for k in range(ORDER)], axis=1)
                held.append((h, gram, np.full(len(h), keys.index(key), np.int32), n.astype(np.int64)))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [summed()]
                if 2 * len(held[0][0]) > HELD:
                    yield handed()
                    held.clear()
                    keys.clear()
        if held:
            held[:] = [summed()]
            yield handed()

    counted = docs.select(F.col(f"`{text_col}`").alias("text"), tongue(docs[f"`{lang_col}`"]).alias("tongue")).mapInArrow(rows, "tongue string, gram string, n long")
    return counted.groupBy("tongue", "gram").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """tongue, d1, d2, d3, symbols, size: what is taken off n-grams seen once, twice and more often; grams: tongue, gram, n."""
    seen = [F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    bounded = [F.least(F.greatest(x, F.lit(0.1)), F.lit(k - 0.1)).alias(f"d{k}") for k, x in enumerate(d, 1)]
    return grams.groupBy("tongue").agg(*seen, F.count("*").alias("size")).select("tongue", *bounded, F.col("size").alias("symbols"), "size")


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """tongue, gram, p for every n-gram of `order` characters: the probability of its last one after the others.

    An n-gram below the highest order counts the different characters before it. Each order's
    discounted share is topped up by the next lower order's probability; below single
    characters stand equal shares for those seen and for one unseen. A window holds the
    characters that follow one context: at most as many as there are characters.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("tongue", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    lower = None
    for k in range(1, order + 1):
        less = written(discounts(levels[k]), "discounts")
        grams = spread_join(levels[k], less, "tongue", levels[k].count(), "inner")
        after = Window.partitionBy("tongue", F.expr(f"substring(gram, 1, {k - 1})"))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = grams.withColumn("off", off).withColumn("all", F.sum("n").over(after)).withColumn("spare", F.sum("off").over(after) / F.col("all"))
        if lower is None:
            grams = grams.withColumn("below", 1 / (F.col("symbols") + 1))
        else:
            grams = grams.withColumn("rest", F.expr("substring(gram, 2)")).join(lower.select("tongue", F.col("gram").alias("rest"), F.col("p").alias("below")), ["tongue", "rest"])
        lower = grams.select("tongue", "gram", ((F.col("n") - F.col("off")) / F.col("all") + F.col("spare") * F.col("below")).alias("p"))
    return lower


def hashed(model: DataFrame) -> DataFrame:
    """h, bits: a model's n-grams by their hash, and the bits that each costs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.empty(batch.num_rows, np.int64)
            gram = np.array(texts(batch, "gram"), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
            key = np.array(texts(batch, "tongue"), object)
            for name in set(key.tolist()):
                mine = np.flatnonzero(key == name)
                h[mine] = hashes(gram[mine].reshape(-1), np.arange(len(mine)) * ORDER + ORDER - 1, name).view(np.int64)
            p = batch.column(batch.schema.get_field_index("p")).to_numpy()
            yield record({"h": pa.array(h), "bits": pa.array(-np.log2(p))})

    return model.mapInArrow(rows, "h long, bits double")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(batch: pa.RecordBatch, bits: Lookup) -> dict:
    """The columns of measure() for rows of doc_id, text and tongue; bits: those of n-grams by their hashes."""
    text = texts(batch)
    mean: list[float | None] = [None] * len(text)
    for key, rows in by_language(batch).items():
        codes, own = coded([text[i] for i in rows])
        cost = bits[hashes(codes, own, key)]
        sizes = np.array([len(text[i]) for i in rows], np.int64)
        for i, x in zip(rows, (np.add.reduceat(cost, np.cumsum(sizes) - sizes, dtype=np.float64) / sizes).tolist(), strict=True):
            mean[i] = x
    found = [Counts(t) for t in text]
    return {
        "doc_id": ids(batch),
        "tongue": ids(batch, "tongue"),
        **{k: pa.array([getattr(c, k) for c in found], pa.int64()) for k in COUNTS},
        "n_chars": pa.array([c.n_chars for c in found], pa.int64()),
        "bits": pa.array(mean, pa.float64()),
    }


def measure(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, tongue, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, bits of every row.

    model: h and bits, from the n-grams of docs itself, so that it has every n-gram asked for.
    bits: mean bits a character under the row's language model; null without characters.
    """
    bounded_batches(docs.sparkSession)
    kind = id_field(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), tongue(docs[f"`{lang_col}`"]).alias("tongue"))
    schema = f"doc_id {kind}, tongue string, {', '.join(f'{k} long' for k in COUNTS)}, n_chars long, bits double"
    if model.count() > BROADCAST:
        return written(joined(rows, model, schema), "perplexity")
    table = model.toArrow()
    order = np.argsort(table.column("h").to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast((table.column("h").to_numpy().view(np.uint64)[order], table.column("bits").to_numpy().astype(np.float32)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Lookup(*sent.value)
        for batch in slices(batches, limit=STEP):
            yield record(measured(batch, bits))

    return written(rows.mapInArrow(run, schema), "perplexity")


def joined(rows: DataFrame, model: DataFrame, schema: str) -> DataFrame:
    """measure() for a model of any size: each chunk of texts asks for its different n-grams by a join."""
    most = CHUNK
    kind = id_field(rows, "doc_id")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, 0
        for batch in slices(batches):
            chunks = []
            for row, text in zip(ids(batch, "row").to_pylist(), texts(batch), strict=True):
                if chunk is None or held >= most:
                    chunk, held = row, 0
                chunks.append(chunk)
                held += len(text or "")
            yield record({"chunk": pa.array(chunks, pa.int64()), "doc_id": ids(batch), "text": ids(batch, "text"), "tongue": ids(batch, "tongue")})

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint64)
        for batch in slices(batches, limit=STEP):
            text, chunk = texts(batch), ids(batch, "chunk").to_numpy()
            found = by_language(batch)
            for c in dict.fromkeys(chunk.tolist()):
                if at is not None and c != at and len(held):
                    yield record({"chunk": pa.array(np.full(len(held), at)), "h": pa.array(held.view(np.int64))})
                    held = np.empty(0, np.uint64)
                at = c
                for key, rows_of in found.items():
                    own = [text[i] for i in rows_of if chunk[i] == c]
                    if own:
                        held = np.union1d(held, hashes(*coded(own), key))
        if len(held):
            yield record({"chunk": pa.array(np.full(len(held), at)), "h": pa.array(held.view(np.int64))})

    def answered(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        keys, first = np.unique(answers.column("h").to_numpy().view(np.uint64), return_index=True)
        bits = Lookup(keys, answers.column("bits").to_numpy()[first].astype(np.float32))
        parts = [measured(b, bits) for b in slices(iter(texts_of.select(["doc_id", "text", "tongue"]).to_batches()), limit=STEP)]
        return pa.concat_tables([pa.table(p) for p in parts])

    chunks = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(dealt, f"chunk long, doc_id {kind}, text string, tongue string"), "chunks")
    answers = chunks.mapInArrow(asked, "chunk long, h long").join(model, "h").select("chunk", "h", "bits")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spread: float = SPREAD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, lower, upper, kept.

    Model, counts and bands are of all rows. A row is kept unless it fails the base rules or its
    perplexity (2 ** bits) lies outside its language's band: the median, and `spread`
    interquartile ranges to either side, wider for short texts. Null and empty texts have no
    words and fail. Null languages form one of their own, and so does every other value. Repeated
    rows and null ids are kept, one row each; an empty table gives an empty one. Other columns
    are not read.
    """
    counts = written(count_ngrams(docs, text_col, lang_col), "ngrams")
    model = written(hashed(kneser_ney(counts)), "model")
    found = measure(docs, model, id_col, text_col, lang_col)
    long_enough = F.when((F.col("n_words") >= MIN_WORDS) & F.col("bits").isNotNull(), F.col("bits"))
    bands = found.groupBy("tongue").agg(F.percentile_approx(long_enough, [0.25, 0.5, 0.75], 10_000).alias("q"), F.count("*").alias("size"))
    bands = bands.select("tongue", "size", F.col("q")[1].alias("middle"), (spread * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.01))).alias("reach"))
    reach = F.col("reach") + SHORT / F.sqrt(F.greatest("n_chars", F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        spread_join(found, written(bands, "bands"), "tongue", found.count())
        .withColumn("base_failed", failed)
        .withColumn("lower", F.col("middle") - reach)
        .withColumn("upper", F.col("middle") + reach)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(True)))
        .select("doc_id", *COUNTS, "base_failed", "bits", "lower", "upper", "kept")
    )
