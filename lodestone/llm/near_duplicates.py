"""MinHash near-duplicates with odd sketches, links confirmed on full shingle sets.

Texts with the same set of shingles are one class. A class's MinHash samples make its bands,
and all of them, folded into a parity bitmap, its odd sketch: the population count of two
sketches' XOR says how many samples differ. Classes that share a band are candidates; those
whose sketches differ too much are dropped; the rest are compared by their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER_AZ, bounded_batches, forget, id_field, ids, mix, record, slices, texts, window_hashes, word_hashes, written
from lodestone.llm.rows import components, free_name, maybe_members, numbered, spread_join, with_row, without_members

WIDTH, PERCENT = 5, 80
"""Words of a shingle, and the least similarity, unless a caller says otherwise."""

SAMPLES = 240
SKETCH_WORDS = 16
"""An odd sketch has 64 times as many bits."""
MISS = 1e-7
"""Chance that a pair of just the least similarity shares no band, or that its sketches are too far apart."""

TOGETHER = 4_096
"""Classes of a band that one task compares with all others of the band."""

SETS_TOGETHER = 256
"""Classes of a band in a part; two parts' full sets are compared in one task."""
COLUMNS_TOGETHER = 1 << 13
"""Different shingles whose places in all sets of a task are held at once."""

SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)


def bands(percent: int) -> tuple[int, int]:
    """How many bands of how many samples: the longest bands that miss a link with at most the chance MISS."""
    j = percent / 100
    best = (SAMPLES, 1)
    for size in range(1, 9):
        n = math.ceil(math.log(MISS) / math.log(1 - j**size)) if j < 1 else 1
        if n * size <= SAMPLES:
            best = (n, size)
    return best


def most_apart(percent: int) -> int:
    """Bits in which the sketches of a pair of just the least similarity differ at most, but for the chance MISS."""
    p = 1 - percent / 100
    tail, k = 0.0, SAMPLES
    while k > 0 and (tail := tail + math.exp(math.lgamma(SAMPLES + 1) - math.lgamma(k + 1) - math.lgamma(SAMPLES - k + 1) + k * math.log(p) + (SAMPLES - k) * math.log(1 - p))) < MISS:
        k -= 1
    return 2 * k  # every sample that differs changes two bits at most


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles: `width` words each, or all words where there are fewer.

    A-Z are lower-cased; words are what stands between ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))) + np.uint64(min(width, len(words))))


def sketch(s: np.ndarray, n_bands: int, size: int) -> tuple[list[int], bytes]:
    """Band hashes and odd sketch of a set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 1024):
        np.minimum(low, ((s[a : a + 1024, None] ^ SEEDS[0]) * SEEDS[1]).min(0), out=low)
    low = mix(low)
    band = [xxhash.xxh3_64_intdigest(low[i * size : (i + 1) * size].tobytes(), i) >> 1 for i in range(n_bands)]
    bits = (mix(low + SEEDS[0]) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    parity = np.bincount(bits, minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
    return band, np.packbits(parity).tobytes()


def sketches(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, n, key (128-bit hash of the set), bands, sketch (array of longs) of numbered rows."""
    n_bands, size = bands(percent)
    kind = id_field(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            n, key, band, odd = [], [], [], []
            for text in texts(batch):
                s = shingles(text, width)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                b, o = sketch(s, n_bands, size) if len(s) else ([], b"")
                band.append(b)
                odd.append(np.frombuffer(o, np.int64).tolist())
            yield record({"row": ids(batch, "row"), "doc_id": ids(batch), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "bands": pa.array(band, pa.list_(pa.int64())), "sketch": pa.array(odd, pa.list_(pa.int64()))})

    return rows.mapInArrow(run, f"row long, doc_id {kind}, n long, key binary, bands array<long>, sketch array<long>")


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """row, shingles: the hashes of each row's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            found = [shingles(t, width).view(np.int64) for t in texts(batch)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield record({"row": ids(batch, "row"), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))})

    return rows.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def confirm(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of rows whose full sets are similar enough."""
    pairs = written(pairs, "pairs")
    of_a = pairs.groupBy("a").agg(F.count("*").alias("size"))
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("row")
    maybe = maybe_members(rows.select("row", "text"), wanted)
    side = lambda name: maybe.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}"))
    both = spread_join(pairs.join(side("b"), "b"), side("a").join(of_a, "a"), "a", pairs.count(), "inner").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kept: tuple[int, np.ndarray] | None = None
        for whole in batches:
            for batch in slices(iter([whole]), "text_b"):
                a, b, one, other = (batch.column(i).to_pylist() for i in range(4))
                out = []
                for k in range(len(a)):
                    if kept is None or kept[0] != a[k]:
                        kept = (a[k], shingles(one[k], width))
                    x, y = kept[1], shingles(other[k], width)
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        out.append(k)
                yield batch.select([0, 1]).take(pa.array(out, pa.int64()))

    return written(both.mapInArrow(run, "a long, b long"), "links")


def meetings(still: DataFrame, split: DataFrame, total: int) -> DataFrame:
    """node, n, root, band, place, parts: what is to be compared with what, from the entries of split bands.

    Copies of one text share most of their bands. Bands in which the same component has most
    entries become one, with each class once, unless that makes more comparisons than they do
    apart; any two classes of a band stay together. A band so made has a negative number, and
    its pairs count whatever other bands they share.
    """
    apart = split.groupBy("top").agg(F.sum("members").alias("size"), F.sum(F.col("members").cast("double") * F.col("members")).alias("apart"))
    once = still.select("top", "node").distinct().groupBy("top").agg(F.count("*").alias("together"))
    merged = apart.join(once, "top").where(F.col("together").cast("double") * F.col("together") <= F.col("apart")).select("top", "together", "size")
    flagged = spread_join(still, written(merged, "merged"), "top", total)
    own = F.col("together").isNotNull()
    band, place, size = F.when(own, -1 - F.col("top")).otherwise(F.col("band")), F.when(own, -1).otherwise(F.col("place")), F.coalesce("together", "members")
    return flagged.select("node", "n", "root", band.alias("band"), place.alias("place"), F.ceil(size / TOGETHER).cast("int").alias("parts")).distinct()


def shared_counts(sets: list[np.ndarray], n_first: int) -> np.ndarray:
    """How many hashes each of the first n_first sets has in common with each of the others."""
    sizes = np.array([len(s) for s in sets])
    found, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.cumsum(times > 1) - 1  # what only one set has is shared with none
    own, kept = np.repeat(np.arange(len(sets)), sizes), times[place] > 1
    own, place = own[kept], several[place[kept]]
    order = np.argsort(place, kind="stable")
    own, place = own[order], place[order]
    out = np.zeros((n_first, len(sets) - n_first), np.int64)
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS_TOGETHER):
        i, j = np.searchsorted(place, (a, a + COLUMNS_TOGETHER))
        has = np.zeros((len(sets), COLUMNS_TOGETHER), np.float32)
        has[own[i:j], place[i:j] - a] = 1
        out += (has[:n_first] @ has[n_first:].T).astype(np.int64)
    return out


def linked_in_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the linked nodes of different roots among rows (node, n, root, band, place, bands, sketch, parts, shingles), in the first band that two share.

    A band's rows are dealt by hash over its parts, and each two parts meet in one group, a tile.
    So a task holds the sets of two parts at once, however many rows a band has, and no join has
    a skewed key to be split by what chance has put in its files.
    """
    part, limit = F.pmod(F.hash("node"), F.col("parts")), most_apart(percent)
    dealt = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.col("band").alias("of"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "n", "root", "place", "bands", "sketch", "shingles", "part")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        column = {name: table.column(name).to_numpy() for name in ("node", "n", "root", "place", "part")}
        lists = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        band, odd = lists("bands"), lists("sketch")
        first = np.flatnonzero(column["part"] == low)
        second = first if low == high else np.flatnonzero(column["part"] == high)
        x, y = first[:, None], second[None, :]
        n, root, place = column["n"], column["root"], int(column["place"][0])
        open_ = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        if low == high:
            open_ &= x < y
        apart = np.zeros(open_.shape, np.int64)
        for k in range(odd.shape[1]):
            apart += np.bitwise_count(odd[x, k].view(np.uint64) ^ odd[y, k].view(np.uint64))
        open_ &= apart <= limit
        for k in range(place):
            open_ &= band[x, k] != band[y, k]
        one, other = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        a = b = np.empty(0, np.int64)
        if len(one):
            ends = table.column("shingles").combine_chunks()
            sets = [ends[int(k)].values.to_numpy() for k in (*first[one], *second[other])]
            both = n[first[one]][:, None] + n[second[other]][None, :]
            linked = open_[np.ix_(one, other)] & ((100 + percent) * shared_counts(sets, len(one)) >= percent * both)
            i, j = np.nonzero(linked)
            a, b = column["node"][first[one[i]]], column["node"][second[other[j]]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("of", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, root, doc_id, n_shingles, component_id, kept for every row of docs.

    row numbers the rows; root is the number of a component's first one.

    Rows are linked if 100 * shared shingles >= percent * all shingles of the two sets. A
    component_id is the smallest id in reach of links; kept says that it is the row's own.
    Null texts and texts without words have no shingles and are linked with nothing: each is
    its own component. Repeated rows are linked; if they repeat the smallest id, all of those
    are kept. A row whose id is null is never kept unless nothing else is in its component; then
    component_id is null. An empty table gives an empty one. Other columns are not read.

    Candidates come in two rounds, neither of which emits the pairs of a group. First every class
    that shares a band meets the band's hub, the class that meets most others over all its bands.
    Then, in the bands that still hold several components, merged by meetings(), classes of different ones are compared inside groups: the first step, a join by sketches, leaves
    the classes that have a near one; the second carries their full sets to tiles of their bands, and leaves links. A band
    that many classes share without being linked costs comparisons in proportion to its pairs, of
    which Spark deals a large band over several tasks.
    """
    return duplicates_among(numbered(docs, id_col, text_col), width, percent)


def duplicates_among(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """near_duplicates() of a numbered table."""
    bounded_batches(rows.sparkSession)
    found = written(sketches(rows, width, percent), "sketches")
    kind, total = id_field(rows, "doc_id"), found.count()
    classes = found.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("size"))
    classes = written(classes, "classes")
    # Bands and sketches are most of what is kept of a row, so they are not shuffled to tell a class's first row from its copies, nor to be asked for by a few.
    worded = found.where("key is not null")
    copies = worded.select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti")
    nodes = without_members(worded, copies).select(F.col("row").alias("node"), "n", "bands", "sketch")
    banded = nodes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    n_bands = bands(percent)[0]
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = written(spread_join(maybe_members(banded, sizes, "band"), sizes.withColumn("members", F.col("size")), "band", total * n_bands, "inner"), "shared")
    # The class that meets most others over all its bands stands in the middle of its copies: as a band's hub it links most of them.
    fame = shared.groupBy("node").agg(F.sum("members").alias("fame"))
    hubs = shared.join(fame, "node").groupBy("band").agg(F.max_by(F.struct("node", "n"), F.struct("fame", -F.col("node"))).alias("hub"), F.count("*").alias("size")).select("band", F.col("hub.node").alias("first"), F.col("hub.n").alias("first_n"), "size")
    grouped = written(spread_join(shared.drop("members"), written(hubs, "hubs"), "band", total * n_bands, "inner"), "bands")
    sketch_of = written(maybe_members(nodes.select("node", "sketch"), grouped.select("node").distinct(), "node"), "odd")
    alike = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    apart = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SKETCH_WORDS))
    near = f"{apart} <= {most_apart(percent)}"

    star = grouped.where("node <> first").where(f"100 * least(n, first_n) >= {percent} * greatest(n, first_n)").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = written(star, "star")
    hubs = star.groupBy("a").agg(F.count("*").alias("size")).join(sketch_of.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    star = spread_join(star.join(sketch_of.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b"), hubs, "a", total, "inner")
    star = star.select("a", "b", F.struct("sa").alias("p"), F.struct("sb").alias("q")).where(" + ".join(f"bit_count(p.sa[{i}] ^ q.sb[{i}])" for i in range(SKETCH_WORDS)) + f" <= {most_apart(percent)}").select("a", "b")
    links = confirm(star, rows, width, percent)
    roots = written(components(links), "roots")
    rooted = grouped.join(roots, "node", "left").select("node", "n", "band", "first", "place", F.coalesce("root", "node").alias("root"))
    held = rooted.groupBy("band", "root").agg(F.count("*").alias("size"))
    split = held.groupBy("band").agg(F.sum("size").alias("members"), F.max_by("root", F.struct("size", -F.col("root"))).alias("top"), F.count("*").alias("roots")).where("roots > 1 and members > 2")
    split = written(split.select("band", "top", "members"), "split")
    still = written(spread_join(rooted, split.withColumn("size", F.col("members")), "band", total * n_bands, "inner").where("node <> first"), "still")
    still = written(meetings(still, split, total * n_bands), "meetings")
    open_nodes = written(maybe_members(nodes.select("node", "bands", "sketch"), still.select("node").distinct(), "node"), "open")
    # Plain columns keep the join's condition small enough to be compiled.
    flat = [F.coalesce(F.col(name)[i], F.lit(0)).alias(f"{name[0]}{i}") for name, n in (("sketch", SKETCH_WORDS), ("bands", n_bands)) for i in range(n)]

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One side of a large band is dealt over parts, and the other goes to each of them."""
        open_ = rows.join(open_nodes, "node").select("node", "n", "band", "root", "place", "parts", *flat)
        return open_.withColumn("part", F.pmod(F.hash("node"), "parts")).alias("x"), open_.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")

    # A pair counts in its first common band only. Sets travel for those entries alone that have a near one in their band by sketch; only entries, then links leave the joins.
    seen = " and ".join(f"(x.place <= {i} or x.b{i} <> y.b{i})" for i in range(n_bands))
    pair = f"x.band = y.band and x.part = y.part and x.root <> y.root and {alike} and {near} and {seen}"
    one, other = sides(still)
    near_ones = written(one.join(other, F.expr(pair), "left_semi").select("node", "band"), "near")
    wanted = near_ones.select(F.col("node").alias("row")).distinct()
    sets = full_sets(maybe_members(rows.select("row", "text"), wanted).join(wanted, "row"), width)
    # The near ones of a band are counted anew: full sets cost more than sketches, so fewer of them make a tile.
    each = near_ones.groupBy("band").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / SETS_TOGETHER).cast("int"))
    near_ones = spread_join(near_ones, each, "band", total * n_bands, "inner")
    open_ = still.drop("parts").join(near_ones, ["node", "band"]).join(open_nodes, "node").join(sets.withColumnRenamed("row", "node"), "node")
    links = links.union(written(linked_in_tiles(open_, percent), "links"))
    # Rows meet their component by way of their class alone, and a hot class or component is dealt over many tasks.
    placed = classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    least = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")), "least")
    placed = spread_join(placed.select("key", "root", F.col("size").alias("members")), least, "root", total).select("key", "root", "component_id", F.col("members").alias("size"))
    out = spread_join(found.select("row", "doc_id", "key", F.col("n").alias("n_shingles")), written(placed, "components"), "key", total)
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("row", F.coalesce("root", "row").alias("root"), "doc_id", "n_shingles", own.cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the first of those with the smallest id (nulls last). All columns are kept."""
    row = free_name(docs, "row")
    held = with_row(docs, row)
    found = duplicates_among(held.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), width, percent)
    first = found.where("kept").groupBy("root").agg(F.min("row").alias(row)).select(row)
    return held.join(first, row, "left_semi").drop(row)
