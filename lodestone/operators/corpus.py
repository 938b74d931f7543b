"""A corpus of source files: enumeration, regular-expression search with context, reading, outlines."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.outline import outline
from lodestone.functions.paths import afold, fold

PER_FILE, LIMIT, WINDOW, MAX_LINES = 20, 25, 150, 2000
FIRST_TREES = ("vanilla", "core")
KEY_CALL = r'"([A-Za-z0-9_.]+)"\s*\.\s*Translate'


def read_files(spark: SparkSession, root: str, pattern: str = "*.cs") -> DataFrame:
    """tree, file, text of the files below root: a tree is a first-level folder ('' for files at the root). Hidden trees are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    rest = F.regexp_replace(F.url_decode("path"), "^.*?" + re.escape(root.rstrip("/").rpartition("/")[2]) + "/", "")
    out = files.select(F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise("").alias("tree"), rest.alias("file"), "text")
    return out.where(~F.col("tree").startswith("."))


def tree_order(tree: Column | str = "tree") -> Column:
    """The game's own trees first, files at the root last."""
    t = F.lower(tree)
    return F.when(t.isin(*FIRST_TREES), 0).when(t == "", 2).otherwise(1)


def trees(files: DataFrame) -> DataFrame:
    """The trees with their numbers of files."""
    return files.groupBy("tree").agg(F.count("*").alias("files"))


def lines(files: DataFrame) -> DataFrame:
    """tree, file, line (from 1), text."""
    return files.select("tree", "file", F.posexplode(F.split("text", "\r?\n"))).select("tree", "file", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? don't; without a slash it is a file name at any depth."""
    text = glob.replace("\\", "/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", text))
    return f"(?i)^{out}$" if "/" in text else f"(?i)(^|/){out}$"


def search(files: DataFrame, pattern: str, ignore_case: bool = False, glob: str | None = None) -> DataFrame:
    """Tree, file, line, text of every matching line. Counts over it are exact whatever is shown."""
    rows = files.where(F.col("file").rlike(glob_regex(glob))) if glob else files
    return lines(rows).where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))


def shown(matches: DataFrame, per_file: int = PER_FILE, limit: int | None = LIMIT) -> DataFrame:
    """The first lines of each file, and of those the first in the order of files."""
    ranked = matches.withColumn("nth", F.row_number().over(Window.partitionBy("tree", "file").orderBy("line"))).where(F.col("nth") <= per_file).drop("nth")
    ranked = ranked.orderBy(tree_order(), "tree", "file", "line")
    return ranked if limit is None else ranked.limit(limit)


def match_counts(matches: DataFrame) -> DataFrame:
    """Lines and files that match, in one row."""
    return matches.agg(F.count("*").alias("lines"), F.countDistinct("tree", "file").alias("files"))


def context(matches: DataFrame, k: int) -> DataFrame:
    """C4: tree, file, line, window: the lines within k of a match; windows that touch or overlap are one.

    A window starts where a match is more than 2k + 1 lines after the last one of its file.
    Lines past the end of a file are for the reader's join to leave out.
    """
    by_file = Window.partitionBy("tree", "file").orderBy("line")
    gap = F.col("line") - F.lag("line").over(by_file)
    opened = matches.select("tree", "file", "line").distinct().withColumn("opens", F.coalesce((gap > 2 * k + 1).cast("int"), F.lit(1)))
    windows = opened.withColumn("window", F.sum("opens").over(by_file)).groupBy("tree", "file", "window").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return windows.select("tree", "file", "window", F.explode(F.sequence(F.greatest(F.col("first") - k, F.lit(1)), F.col("last") + k)).alias("line"))


def with_context(files: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """C4: tree, file, window, line, text, hit: the matching lines and those within k of one."""
    around = context(matches, k)
    hits = matches.select("tree", "file", "line", F.lit(True).alias("hit"))
    own = files.join(matches.select("tree", "file").distinct(), ["tree", "file"], "left_semi")
    return lines(own).join(around, ["tree", "file", "line"]).join(hits, ["tree", "file", "line"], "left").select("tree", "file", "window", "line", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def bounded(files: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first `most` files in the order of trees, and whether there are more, so that counts are lower bounds."""
    first = files.orderBy(tree_order(), "tree", "file").limit(most)
    return first, files.count() > most


def pattern_hints(pattern: str) -> list[str]:
    """What a pattern that finds nothing may have meant."""
    out = []
    if re.search(r"&(lt|gt|amp|quot);", pattern):
        out.append(f"the pattern is HTML-escaped; try {html.unescape(pattern)}")
    if found := re.search(r"(\w+)(<[\w, .]+>|`\d)", pattern):
        out.append(f"arguments of generics may be written otherwise or be gone; try {found[1]}")
    if re.search(r"(?<!\\)[()\[\]{}+*?]", pattern) and not re.search(r"\\|\.\*|\.\+|\[", pattern):
        out.append(f"the pattern is a regular expression; for the text itself try {re.escape(pattern)}")
    return out


def glob_hint(glob: str) -> str | None:
    """Why a glob may fit no file."""
    if "/" in glob and not glob.startswith("*"):
        return f"a glob with a slash starts at the root; try **/{glob}"
    return None if "*" in glob or "?" in glob or glob.endswith(".cs") else f"a glob names whole files; try *{glob}*"


def resolve_keys(matches: DataFrame, keyed: DataFrame) -> DataFrame:
    """Key, n, translated: the UI texts that matching lines ask for; translated is null for unknown keys."""
    calls = matches.select(F.explode(F.regexp_extract_all("text", F.lit(KEY_CALL), 1)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    known = keyed.where("origin = 'runtime'").groupBy("key").agg(F.min("translated").alias("translated"))
    return calls.join(known, "key", "left")


def assembled(matches: DataFrame) -> DataFrame:
    """How many matching lines ask for a text whose key isn't written out."""
    return matches.agg(F.count_if(F.col("text").rlike(r"\.\s*Translate\b") & ~F.col("text").rlike(KEY_CALL)).alias("n"))


def resolve_file(files: DataFrame, name: str) -> DataFrame:
    """The files of a name: an equal path, else paths that end so, with or without .cs; A-Z folded. Several are for the caller to tell apart."""
    want = fold(name.replace("\\", "/"))
    path = afold("file")
    ranks = F.when(path == want, 0).when(path.endswith("/" + want), 1).when((path == want + ".cs") | path.endswith("/" + want + ".cs"), 2)
    found = files.select("tree", "file").withColumn("rank", ranks).where("rank is not null")
    best = found.agg(F.min("rank").alias("best"))
    return found.join(F.broadcast(best), F.col("rank") == F.col("best")).select("tree", "file")  # best is one row


def line_range(text: str | None) -> tuple[int, int | None]:
    """First and last line of `a-b`, `a+n`, `a` or `all` (None: to the end)."""
    if text is None:
        return 1, WINDOW
    if text == "all":
        return 1, None
    if m := re.fullmatch(r"(\d+)-(\d+)", text):
        return int(m[1]), int(m[2])
    if m := re.fullmatch(r"(\d+)\+(\d+)", text):
        return int(m[1]), int(m[1]) + int(m[2]) - 1
    if text.isdigit():
        return int(text), int(text) + WINDOW - 1
    raise ValueError(f"lines: {text!r} is no range")


def read_lines(files: DataFrame, file: str, wanted: str | None = None) -> DataFrame:
    """The lines of a file, MAX_LINES at most."""
    first, last = line_range(wanted)
    last = min(last or first + MAX_LINES - 1, first + MAX_LINES - 1)
    return lines(files.where(F.col("file") == file)).where(F.col("line").between(first, last))


OUTLINE = "tree string, file string, kind string, name string, owner string, generics string, base string, first int, last int"


def outlines(files: DataFrame) -> DataFrame:
    """The declarations of every file: kind, name, owner, generics, base class, and first and last line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("tree", "file", "kind", "name", "owner", "generics", "base", "first", "last")}
            for tree, file, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for d in outline(text or ""):
                    for key, value in zip(out, (tree, file, d.kind, d.name, d.owner, d.generics, d.base, d.first, d.last), strict=True):
                        out[key].append(value)
            types = {"first": pa.int32(), "last": pa.int32()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.string())) for k, v in out.items()})

    return files.select("tree", "file", "text").mapInArrow(rows, OUTLINE)


def member(files: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    """The lines of every declaration of a name, within an owner if given."""
    found = outlines(files).where(F.col("name") == name)
    if owner:
        found = found.where(F.col("owner") == owner)
    return lines(files).join(found.select("tree", "file", "kind", "owner", "first", "last"), ["tree", "file"]).where("line between first and last").select("tree", "file", "kind", "owner", "line", "text")


def in_source(files: DataFrame, type_name: str) -> DataFrame:
    """C11: the files named after a type."""
    return files.where(afold("file").rlike(rf"(^|/){re.escape(fold(type_name))}\.cs$")).select("tree", "file")
