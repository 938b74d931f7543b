"""Declarations of a C#-like source text, by matching braces outside comments and literals."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Comments and literals are blanked before braces are matched; line breaks stay.
SKIPPED = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""+.*?"""+|\$?@\$?"(?:[^"]|"")*(?:"|\Z)|\$?"(?:\\.|[^"\\\n])*(?:"|$)|\'(?:\\.[^\'\n]*|[^\'\\\n])\'|^[ \t]*#[^\n]*', re.S | re.M)
TYPE = re.compile(r"\b(class|struct|interface|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)\s*(<[^{}()]*?>(?=\s*(?:[:({]|where\b|$)))?")
SPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*$")
CALLABLE = re.compile(r"(?:([\w.<>\[\],?\s()*]+?)\s+)?(~?[A-Za-z_]\w*|operator\s*\S+)\s*(<[^<>(){}]*>)?\s*\($", re.S)
NAMED = re.compile(r"([\w.<>\[\],?() ]+?)\s+(this|[A-Za-z_][\w.]*)\s*(\[[^\]]*\])?\s*$")
STATEMENTS = {"if", "for", "foreach", "while", "switch", "using", "lock", "fixed", "catch", "return", "new", "throw", "await", "when", "nameof", "typeof", "base", "this", "sizeof", "default", "checked", "unchecked", "else", "do", "try", "in", "is", "as", "not"}
MODIFIERS = {"public", "private", "protected", "internal", "static", "readonly", "sealed", "abstract", "virtual", "override", "async", "unsafe", "extern", "partial", "new", "const", "volatile", "event", "required", "ref", "file"}


@dataclass
class Declaration:
    kind: str
    name: str
    owner: str | None
    generics: str | None
    base: str | None
    first: int
    last: int


def blanked(text: str) -> str:
    """The text with comments and literals as spaces, every line break in place."""
    return SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def base_class(header: str) -> str | None:
    """The first base of a type's header that isn't named like an interface."""
    depth, at = 0, None
    for i, c in enumerate(header):
        depth += (c in "<(") - (c in ">)")
        if c == ":" and depth == 0:
            at = i
            break
    if at is None:
        return None
    first, depth = "", 0
    for c in re.split(r"\bwhere\b|[{;]", header[at + 1 :])[0]:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            break
        first += c
    name = first.split("(")[0].strip()
    return None if not name or re.match(r"(\w+\.)*I[A-Z]", name) else name


def _parens(header: str) -> int:
    """Where the last top-level parameter list opens, or -1."""
    end = header.rfind(")")
    depth = 0
    for i in range(end, -1, -1):
        depth += (header[i] == ")") - (header[i] == "(")
        if depth == 0 and header[i] == "(":
            return i
    return -1


def classify(header: str, owner: str | None, owner_is_type: bool, braces: bool) -> tuple[str, str, str | None, str | None] | None:
    """Kind, name, generics and base of what a header declares; None for statements."""
    text = re.sub(r"^(\s*\[(?:[^\[\]]|\[[^\]]*\])*\])+", "", header).strip()
    if m := SPACE.search(text):
        return "namespace", m[1], None, None
    if m := TYPE.search(re.split(r"\bwhere\b", text)[0] if not TYPE.search(text) else text):
        return m[1].split()[0], m[2], m[3], base_class(text[m.end() :])
    if not owner_is_type:
        return None
    outer = text
    while (inner := re.sub(r"\([^()]*\)", lambda m: "\0" * len(m[0]), outer)) != outer:
        outer = inner
    end = re.search(r"\bwhere\b|=>|(?<![=!<>])=(?!=)", outer)
    head = (text[: end.start()] if end else text).rstrip()
    head = re.sub(r"\)\s*:\s*(?:base|this)\s*\(.*$", ")", head, flags=re.S)
    opened = _parens(head) if head.endswith(")") else -1
    if opened >= 0 and (m := CALLABLE.search(head[: opened + 1])):
        name = m[2]
        before = set((m[1] or "").split())
        if name in STATEMENTS or before & {"return", "new", "throw", "await"} - MODIFIERS:
            return None
        if name == owner or name == f"~{owner}":
            return "constructor", name, m[3], None
        return ("method", name, m[3], None) if before - MODIFIERS or name.startswith("operator") else None
    if m := NAMED.search(head):
        words = m[1].split()
        if m[2] not in STATEMENTS and not (set(words) & (STATEMENTS - MODIFIERS)) and set(words) - MODIFIERS:
            return ("event" if "event" in words else "property" if braces or "=>" in header else "field"), m[2], None, None
    return None


def outline(text: str) -> list[Declaration]:
    """Every namespace, type, constructor, method, property, event and field, in order."""
    code = blanked(text)
    line_at = [0]
    for c in code:
        line_at.append(line_at[-1] + (c == "\n"))
    out: list[Declaration] = []
    stack: list[Declaration | None] = []
    start, parens = 0, 0

    def owner() -> tuple[str | None, bool]:
        for d in reversed(stack):
            if d is None:
                return None, False
            return d.name, d.kind in ("class", "struct", "interface", "record")
        return None, False

    def add(header: str, begin: int, end: int, braces: bool) -> Declaration | None:
        name, is_type = owner()
        found = classify(header, name, is_type, braces) if header.strip() else None
        if found is None:
            return None
        skip = len(header) - len(header.lstrip())
        types = [d.name for d in stack if d is not None and d.kind in ("class", "struct", "interface", "record")]
        d = Declaration(found[0], found[1], ".".join(types) or None, found[2], found[3], line_at[begin + skip] + 1, line_at[min(end, len(line_at) - 1)] + 1)
        out.append(d)
        return d

    for i, c in enumerate(code):
        if c in "([":
            parens += 1
        elif c in ")]":
            parens = max(0, parens - 1)
        elif c == "{":
            inside = stack and (stack[-1] is None or stack[-1].kind in ("method", "constructor", "property", "event", "field", "enum"))
            header = code[start:i]
            stack.append(None if inside or "=" in re.sub(r"[=!<>]=|=>", "", re.sub(r"\(.*\)", "", header, flags=re.S)) else add(header, start, i, True))
            start = i + 1
        elif c == "}":
            if stack and (d := stack.pop()) is not None:
                d.last = line_at[i] + 1
            start, parens = i + 1, 0
        elif c == ";" and parens == 0:
            header = code[start:i]
            if header.strip():
                if m := SPACE.search(header.strip()):
                    out.append(Declaration("namespace", m[1], None, None, None, line_at[i] + 1, line_at[-1] + 1))
                elif stack and stack[-1] is not None and stack[-1].kind in ("class", "struct", "interface", "record"):
                    add(header, start, i, False)
                elif TYPE.search(header) and (not stack or stack[-1] is not None and stack[-1].kind == "namespace"):
                    add(header, start, i, False)
            start = i + 1
    return out
