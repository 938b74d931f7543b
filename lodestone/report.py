"""Reports: notices, tables and items in order, as text or JSON."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from enum import Enum

CELL = 72
"""Display columns of a cell in text."""


class Kind(Enum):
    """Why a notice is there."""

    TRUNCATION = "truncation"
    COUNT = "count"
    FILTER = "filter"
    STALENESS = "staleness"
    SNAPSHOT = "snapshot_choice"
    BOUNDARY = "boundary"
    ADVISORY = "advisory"
    CLAMP = "clamp"
    NEXT = "next_step"


@dataclass
class Notice:
    kind: Kind
    text: str
    shown: int | None = None
    total: int | None = None


@dataclass
class Block:
    key: str
    columns: list[str]
    rows: list[tuple]


PLURALS = {"entity": "entities", "child": "children", "match": "matches"}


def counted(n: int, noun: str) -> str:
    return f"{n} {noun if n == 1 else PLURALS.get(noun, noun + 's')}"


def page_notice(shown: int, total: int, noun: str, at_least: bool = False) -> Notice:
    """Complete, the first of more, or at least so many."""
    text = counted(total, noun)
    if at_least:
        return Notice(Kind.TRUNCATION, f"at least {text}", shown, total)
    if shown < total:
        return Notice(Kind.TRUNCATION, f"{text}, showing the first {shown}", shown, total)
    return Notice(Kind.COUNT, text, shown, total)


def name_list(names: list[str], most: int = 3) -> str:
    """The first names, and how many more."""
    more = len(names) - most
    return ", ".join(names) if more <= 0 else ", ".join(names[:most]) + f" and {more} more"


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cell(value: object, most: int = CELL) -> str:
    text = "" if value is None else "yes" if value is True else "no" if value is False else str(value).replace("\r", "").replace("\n", "\\n")
    if width(text) <= most:
        return text
    out = ""
    for c in text:
        if width(out + c) > most - 1:
            break
        out += c
    return out + "…"


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(" ", "_").lower()


@dataclass
class Report:
    """What a command answers. Keys that were promised are there even if nothing was found."""

    entries: list[Notice | Block] = field(default_factory=list)
    promised: list[str] = field(default_factory=list)
    deferred: list[tuple[Notice, set[str]]] = field(default_factory=list)
    touched: set[str] = field(default_factory=set)

    def note(self, kind: Kind, text: str, shown: int | None = None, total: int | None = None) -> None:
        self.entries.append(Notice(kind, text, shown, total))

    def add(self, entry: Notice | Block) -> None:
        if isinstance(entry, Block) and any(isinstance(e, Block) and e.key == entry.key for e in self.entries):
            raise ValueError(f"two blocks are called {entry.key}")
        self.entries.append(entry)

    def table(self, key: str, df, columns: list[str] | None = None, mods: str | None = None) -> int:
        """A page's rows, returns their number. What is asked for without a limit comes whole."""
        rows = df.collect()
        names = columns or df.columns
        self.add(Block(key, names, [tuple(r[c] for c in names) for r in rows]))
        if mods and mods in df.columns:
            self.touched |= {r[mods] for r in rows if r[mods]}
        return len(rows)

    def item(self, key: str, **values: object) -> None:
        """M2: one of a collection of items that are alike; together they are one block, in their order."""
        block = next((e for e in self.entries if isinstance(e, Block) and e.key == key), None)
        if block is None:
            self.entries.append(block := Block(key, list(values), []))
        if list(values) != block.columns:
            raise ValueError(f"an item of {key} has {', '.join(values)}, not {', '.join(block.columns)}")
        block.rows.append(tuple(values.values()))

    def defer(self, notice: Notice, mods: set[str]) -> None:
        """A notice about some mods: a footnote, unless the result touches one of them or none is known."""
        self.deferred.append((notice, mods))

    def settle(self) -> None:
        front = [n for n, mods in self.deferred if not mods or not self.touched or mods & self.touched]
        back = [n for n, _ in self.deferred if n not in front]
        self.entries = [*front, *self.entries, *back]
        self.deferred = []

    @property
    def found(self) -> bool:
        return any(isinstance(e, Block) and e.rows for e in self.entries)

    def text(self) -> str:
        """Tables by display width; columns that never change are named once, but never the first."""
        self.settle()
        out: list[str] = []
        for e in self.entries:
            if isinstance(e, Notice):
                out.append(e.text)
                continue
            cells = [[cell(v) for v in row] for row in e.rows]
            same = [i for i in range(1, len(e.columns)) if len(cells) > 1 and len({r[i] for r in cells}) == 1]
            out += [f"{e.columns[i]}: {cells[0][i]}" for i in same]
            kept = [i for i in range(len(e.columns)) if i not in same]
            lines = [[e.columns[i] for i in kept], *([r[i] for i in kept] for r in cells)]
            wide = [max(width(line[k]) for line in lines) for k in range(len(kept))]
            out += ["  ".join(v + " " * (w - width(v)) for v, w in zip(line, wide, strict=True)).rstrip() for line in lines]
        return "\n".join(out)

    def json(self) -> str:
        self.settle()
        found: dict = {key: [] for key in self.promised}
        for e in self.entries:
            if isinstance(e, Block):
                found[snake(e.key)] = [dict(zip(map(snake, e.columns), row, strict=True)) for row in e.rows]
        notes = [{"kind": e.kind.value, "text": e.text} | {k: v for k, v in (("shown", e.shown), ("total", e.total)) if v is not None} for e in self.entries if isinstance(e, Notice)]
        return json.dumps(found | {"notes": notes}, ensure_ascii=False, default=str)
