"""What a query asks for, as Spark columns over facts and defs."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.paths import afold, fold, like_escape


class ValueMatch(Enum):
    """How a value answers a text: contains it, equals it, or equals it or ends with a dot and it. A-Z folded."""

    SUBSTRING = "substring"
    EXACT = "exact"
    IDENTIFIER = "identifier"


@dataclass(frozen=True)
class PathQuery:
    """A field path. exact: the whole path ([] stands for any index, and may cross segments).

    Else a bare name is a leaf, and what has a dot or bracket is the path's end, wherever a
    segment begins.
    """

    text: str
    exact: bool = False

    def condition(self) -> Column:
        text = fold(self.text)
        if self.exact:
            if "[]" in text:
                return F.col("path_fold").like(like_escape(text).replace("[]", "[%]"))
            return F.col("path_fold") == text
        if "." in text or "[" in text:
            return F.col("path_fold").endswith(text)
        return F.col("leaf_fold") == text


def value_condition(text: str, match: ValueMatch) -> Column:
    value, wanted = F.col("value_fold"), fold(text)
    if match is ValueMatch.SUBSTRING:
        return value.contains(wanted)
    if match is ValueMatch.EXACT:
        return value == wanted
    return (value == wanted) | value.endswith("." + wanted)


def type_condition(def_type: str) -> Column:
    return afold("def_type") == fold(def_type)


def types_condition(types: list[str]) -> Column:
    """One of several types. Unlike a single type's, this comparison heeds case."""
    return F.col("def_type").isin(*types)


def class_condition(name: str) -> Column:
    """The class, in full or by its last dotted parts."""
    return (afold("class") == fold(name)) | afold("class").endswith("." + fold(name))


def any_contains(column: str, filters: list[str]) -> Column:
    """Whether a folded column contains any of the filters."""
    return reduce(or_, [F.col(column).contains(fold(f)) for f in filters])
