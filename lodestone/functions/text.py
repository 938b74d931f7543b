"""Text for the index and for queries: identifier parts, CJK pairs, terms, and fuzzy scores."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.paths import col

# The ranges whose characters are indexed in pairs (Ext-A, Unified, Compatibility, kana).
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
IDENTIFIER_MARKS = r"_\-. "
STRIPPED = '"*:()^-+,\''
"""What is dropped from a query's terms."""

# Letters with a diacritic and the letters that they are searched as, by canonical decomposition.
ACCENTED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.combining(d[1])}


def strip_accents(c: Column | str) -> Column:
    return F.translate(col(c), "".join(ACCENTED), "".join(ACCENTED.values()))


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(f"[{CJK}]")


def identifier_words(c: Column | str) -> Column:
    """The text, then its parts at marks and at small-to-capital boundaries; parts of one character are left out."""
    parts = F.split(F.regexp_replace(col(c), rf"(?<=[^\p{{Lu}}{IDENTIFIER_MARKS}])(?=\p{{Lu}})", " "), rf"[{IDENTIFIER_MARKS}]+")
    return F.trim(F.concat_ws(" ", col(c), F.array_join(F.filter(parts, lambda x: F.length(x) > 1), " ")))


def with_cjk_pairs(c: Column | str) -> Column:
    """The text, then every two neighbouring CJK characters."""
    t = col(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    joined = F.concat(t, F.array_join(F.transform(F.filter(pairs, lambda b: b.rlike(f"^[{CJK}]{{2}}$")), lambda b: F.concat(F.lit(" "), b)), ""))
    return F.when(has_cjk(t), joined).otherwise(t)


def for_index(c: Column | str, identifier: bool = False) -> Column:
    """A column's text as it is indexed."""
    return with_cjk_pairs(identifier_words(c) if identifier else c)


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics."""
    return F.regexp_extract_all(strip_accents(F.lower(col(c))), F.lit(r"([\p{L}\p{N}]+)"))


def plain_tokens(text: str) -> list[str]:
    """tokens() of one string."""
    return re.findall(r"[^\W_]+", "".join(ACCENTED.get(c, c) for c in text.lower()))


def phrases(query: str) -> list[tuple[list[str], bool]]:
    """A query's phrases, all of which must match: tokens, and whether the last is a prefix.

    Terms stand between white space. A term is a prefix; one of two CJK characters or more is
    its neighbouring pairs, in full. Terms that nothing is left of don't take part.
    """
    out: list[tuple[list[str], bool]] = []
    for term in query.split():
        term = "".join(c for c in term if c not in STRIPPED)
        if len(term) >= 2 and re.fullmatch(f"[{CJK}]+", term):
            out += [([term[i : i + 2]], False) for i in range(len(term) - 1)]
        elif found := plain_tokens(term):
            out.append((found, True))
    return out


def effective_terms(query: str) -> list[str]:
    """The terms of a query that take part."""
    return [t for t in ("".join(c for c in term if c not in STRIPPED) for term in query.split()) if plain_tokens(t)]


def is_compound(query: str) -> bool:
    """One token with an underscore or a capital inside."""
    return len(query) > 2 and not re.search(r"\s", query) and ("_" in query or any(c.isupper() for c in query[1:]))


def without_kind(query: str) -> str:
    """The query without a leading kind such as `class:`."""
    kind, mark, rest = query.partition(":")
    return rest.strip() if mark and kind.lower() in {"class", "def", "field", "member", "method", "property", "type"} else query


def split_words(c: Column | str) -> Column:
    """The words of an identifier: at marks, before a capital after a small letter, and before an acronym's last capital if a small letter follows."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), r"(?<=\p{Ll})(?=\p{Lu})", " "), r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(spaced, r"[_.\-\s]+"), lambda w: F.length(w) > 0)


FUZZY_LEAST = 60.0


def fuzzy_score(name: Column | str, query: str) -> Column:
    """How well a name answers a misspelt query, 0 to 100; null for an empty query or name.

    Equal 100; begins with the query 90; at most two edits that are few for the query's length
    up to 95; the query opens the initials of the name's words 85 (75 if long); it opens a word
    80; at most three edits and three quarters alike up to 70; three fifths alike up to 55;
    contained 30 to 50, by where and how much of the name it is.
    """
    c = col(name)
    n, q, size = F.lower(c), F.lit(query.lower()), len(query)
    edits = F.levenshtein(n, q)
    alike = 1 - edits / F.greatest(F.length(n), F.lit(size))
    words = F.transform(split_words(c), F.lower)
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    place = F.instr(n, query.lower()) - 1
    contained = F.least(50 - place * 20.0 / F.length(n) + size * 10.0 / F.length(n), F.lit(50.0))
    score = (
        F.when(n == q, 100.0)
        .when(n.startswith(query.lower()), 90.0)
        .when((edits <= 2) & (edits <= size * (0.5 if size <= 4 else 0.3)), F.least(95.0 - 5.0 * edits + F.when(F.abs(F.length(n) - size) <= 1, 3.0).otherwise(0.0), F.lit(95.0)))
        .when(initials.startswith(query.lower()), 85.0 if size <= 5 else 75.0)
        .when(F.exists(words, lambda w: w.startswith(query.lower())), 80.0)
        .when((edits <= 3) & (alike >= 0.75), 70.0 * alike)
        .when(alike >= 0.6, 55.0 * alike)
        .when(place >= 0, F.greatest(contained, F.lit(30.0)))
        .otherwise(0.0)
    )
    return F.when((F.length(n) > 0) & F.lit(size > 0), score)
