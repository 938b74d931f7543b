"""Expressions over names, field paths and values.

Path grammar: segments joined by dots; a segment is a name followed by any number of [index].
"""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that say nothing about an entity.
NOISE_LEAVES = ("debugRandomId", "defNameHash", "shortHash", "index", "ignoreConfigErrors", "ignoreIllegalLabelCharacterConfigError")
NOISE_ROOT = "modContentPack."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def afold(c: Column | str) -> Column:
    """Lower-cases A-Z only, as SQL's NOCASE and LIKE do; other letters keep their case."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def fold(text: str) -> str:
    """afold for a plain string."""
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like_escape(text: str) -> str:
    """Text as a LIKE pattern that matches just itself (escape character: backslash)."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def leaf(path: Column | str) -> Column:
    """The last segment without its trailing indexes."""
    return F.substring_index(F.regexp_replace(col(path), r"(\[[^\]]*\])+$", ""), ".", -1)


def leaf_of(path: str) -> str:
    return re.sub(r"(\[[^\]]*\])+$", "", path).rsplit(".", 1)[-1]


def shape(path: Column | str) -> Column:
    """The path with every index emptied: a[7].b becomes a[].b."""
    return F.regexp_replace(col(path), r"\[[^\]]*\]", "[]")


def shape_of(path: str) -> str:
    return re.sub(r"\[[^\]]*\]", "[]", path)


def container_prefix(path: Column | str) -> Column:
    """What ends with the last `].`, or an empty string."""
    return F.regexp_extract(col(path), r"^(.*\]\.)", 1)


def index_prefixes(path: Column | str) -> Column:
    """Every prefix that ends with a closing bracket, shortest first."""
    p = col(path)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.substring(p, i, F.lit(1)) == "]")
    return F.transform(ends, lambda i: F.substring(p, F.lit(1), i))


def is_noise(path: Column | str) -> Column:
    """Bookkeeping fields, by leaf or root; case counts."""
    return col(path).startswith(NOISE_ROOT) | leaf(path).isin(*NOISE_LEAVES)


def literal(text: str) -> str:
    """Text as a Java regular expression that matches just itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def whole_segments(path: Column | str, filters: list[str]) -> Column:
    """Whether any filter is a whole run of segments of the path, indexes aside; case-insensitive for ASCII."""
    return reduce(or_, [afold(path).rlike(rf"(^|\.){literal(fold(f))}($|\.|\[)") for f in filters], F.lit(False))


def inner_segment(path: Column | str, name: str) -> Column:
    """Whether name is a segment of the path with something below it."""
    return afold(path).rlike(rf"(^|\.){literal(fold(name))}(\[[^\]]*\])*\.")


def is_whole_segment(path: str, query: str) -> bool:
    """As whole_segments, for one path: an index counts only if the query's segment has one."""
    have, want = path.lower().split("."), query.lower().split(".")
    bare = lambda s: re.sub(r"(\[[^\]]*\])+$", "", s)
    same = lambda h, w: h == w or ("[" not in w and bare(h) == w)
    return any(all(same(h, w) for h, w in zip(have[i:], want, strict=False)) for i in range(len(have) - len(want) + 1))


def tail(name: Column | str) -> Column:
    """The last dotted part."""
    return F.substring_index(col(name), ".", -1)


def class_like(text: str) -> bool:
    """Whether text looks like a class name: dotted parts, each opening with a capital."""
    return bool(re.fullmatch(r"[A-Z]\w*(\.[A-Z]\w*)*", text)) and ("." in text or any(c.isupper() for c in text[1:]))


def same_type(left: Column | str, right: Column | str) -> Column:
    """Type names that agree in their last dotted part, A-Z folded."""
    return afold(tail(left)) == afold(tail(right))


def default_text(state: Column | str) -> Column:
    """The three states of a default: differs, same, unknown."""
    return F.when(col(state) == 0, "no").when(col(state) == 1, "yes").otherwise("unknown")


def declared_in(generated: Column | str, source_file: Column | str) -> Column:
    """Where an entity is declared."""
    return F.when(col(generated), "generated by code").otherwise(F.coalesce(col(source_file), F.lit("unknown file")))
