"""Byte-level BPE over a public vocabulary file, with a bounded cache of space-led segments.

A text without doubled white space is cut at its spaces. A space between two characters that
are not white space always opens a piece of the byte-level pattern, so segments encode on their
own, and what a segment encodes to is remembered in a cache of bounded size. Every other text
(doubled, odd or outer white space, special strings) is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
import tiktoken

CACHE, CACHE_BYTES = 150_000, 40 << 20
"""Segments in each of a cache's two generations, and about how many bytes they take."""
LONGEST = 200
"""Code points of the longest segment that is remembered: in unspaced scripts a segment is a paragraph."""

PAIRS = 2_000_000
"""Token pairs of which it is remembered whether they keep apart."""

# The published split pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.!?;:]*)").fullmatch
"""A segment of letters, then marks: two pieces of the pattern."""


class Odd(Exception):
    """A segment that can't be encoded on its own."""


class Generations(dict):
    """A cache whose older half goes when the newer half is full, by entries or by bytes."""

    def __init__(self, make, size: int = CACHE, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.size, self.most, self.held, self.old = make, size, most, 0, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size or self.held >= self.most:
            self.old = self.copy()
            self.clear()
            self.held = 0
        self[key] = value
        self.held += 200 + 4 * len(key) + len(value)  # an entry's objects, a wide key, its value
        return value


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Ids and prefix counts of a byte-level BPE vocabulary file (tokenizers' .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.special = special
        # A special string without its first character can't start one, so its first two show every one.
        self.marks = sorted({s[:2] for s in special})
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.one = self.encoding._core_bpe.encode_single_piece
        self.pieces = regex.compile(PATTERN).findall
        #: Tokens that encode to themselves; no other one can end an encoding.
        self.tokens = {t: i for t, i in self.ranks.items() if self.one(t) == [i]}
        self.finder = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            self.finder.add_word(token.decode("latin-1"), (i, len(token)))
        self.finder.make_automaton()
        self.id_cache = Generations(self._ids_of_segment)
        self.step_cache = Generations(self._steps_of_segment)
        self.piece_cache = Generations(self._steps_of_piece)
        self.pairs: dict[int, bool] = {}
        self.tail = np.zeros(1, "<u4").tobytes()

    # Ids

    def whole_ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, encoded in one go."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def _ids_of_segment(self, segment: str) -> bytes:
        if not segment or segment[0].isspace() or segment[-1].isspace():
            raise Odd
        if plain := PLAIN(segment):
            body, marks = plain.groups()
            if marks:
                return self.id_cache[body] + array("I", self.one(marks.encode())).tobytes()
            return array("I", self.one(b" " + body.encode())).tobytes()
        return array("I", self.encoding.encode_ordinary(" " + segment)).tobytes()

    def ids(self, text: str) -> bytes:
        """As whole_ids, by way of the cache."""
        if any(m in text for m in self.marks):
            return self.whole_ids(text)
        first, *rest = text.split(" ")
        if first[-1:].isspace() or not first:
            return self.whole_ids(text)
        try:
            return self.whole_ids(first) + b"".join(map(self.id_cache.__getitem__, rest))
        except Odd:
            return self.whole_ids(text)

    # Prefix counts

    def _apart(self, left: int, right: int, both: bytes) -> bool:
        """Whether the two tokens stay as they are when they meet; both: their bytes."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = holds = self.one(both) == [left, right]
        return holds

    def _steps_of_piece(self, piece: str) -> bytes:
        """Prefix dynamic programming over one piece of the pattern.

        last[k] is the last token of the encoding of the first k bytes. It is the one token
        that ends there, encodes to itself and keeps apart from last[k - its length]; so
        count[k] = count[k - its length] + 1. Returned: for each byte the change of the count
        at the end of the character that it closes, as int8 (0 inside a character).
        """
        data, apart = piece.encode(), self.pairs.get
        n = len(data)
        count, last, begin = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end, (token, length) in self.finder.iter(data.decode("latin-1")):
            k = end + 1
            if begin[k] >= 0:
                continue
            start = k - length
            if start:
                left = last[start]
                holds = apart(left << 32 | token)
                if holds is None:
                    holds = self._apart(left, token, data[begin[start] : k])
                if not holds:
                    continue
            last[k], begin[k], count[k] = token, start, count[start] + 1
        if len(piece) == n:
            return bytes([(b - a) & 0xFF for a, b in zip(count, count[1:], strict=False)])
        out, before = bytearray(n), 0
        for k in range(1, n + 1):
            if k == n or data[k] & 0xC0 != 0x80:
                out[k - 1] = (count[k] - before) & 0xFF
                before = count[k]
        return bytes(out)

    def _steps_of_segment(self, segment: str) -> bytes:
        if plain := PLAIN(segment):
            body, marks = plain.groups()
            return self.step_cache[body] + self.piece_cache[marks] if marks else self._steps_of_piece(" " + body)
        if not segment or segment[0].isspace() or segment[-1].isspace() or any(a.isspace() and b.isspace() for a, b in zip(segment, segment[1:], strict=False)):
            raise Odd
        return b"".join(map(self.piece_cache.__getitem__, self.pieces(" " + segment)))

    def count(self, text: str) -> int:
        """Tokens of a text, without the cache."""
        return len(self.encoding.encode(text, allowed_special="all"))

    def _whole_steps(self, text: str, counted: int = 0) -> bytes:
        """Steps of a text with doubled white space but without special strings.

        counted: the count before the text.
        """
        out, before, at = bytearray(), counted, counted
        previous = ""
        for piece in self.pieces(text):
            steps = np.frombuffer(self.piece_cache[piece], np.int8).astype(np.int64)
            counts = at + np.cumsum(steps)
            end = int(counts[-1])
            if previous.isspace() and piece[0].isspace():
                # The run before and this first character are one piece until more follows.
                width = len(piece[0].encode())
                joined = np.frombuffer(self.piece_cache[previous + piece[0]], np.int8)
                counts[width - 1] = start + int(joined.sum(dtype=np.int64))
            start = at
            out += np.diff(counts, prepend=before).astype(np.int8).tobytes() if len(counts) else b""
            before, at, previous = int(counts[-1]), end, piece
        return bytes(out)

    def steps(self, text: str) -> bytes:
        """Changes of the exact token count at each byte: np.cumsum of them is the count of every prefix.

        A byte inside a character repeats the count before that character.
        """
        if not any(s in text for s in self.special):
            if text.isspace() or not text:
                return self._whole_steps(text)
            first, *rest = text.split(" ")
            try:
                if not first or any(a.isspace() and b.isspace() for a, b in zip(first, first[1:], strict=False)) or first[-1].isspace():
                    raise Odd
                return b"".join(map(self.piece_cache.__getitem__, self.pieces(first))) + b"".join(map(self.step_cache.__getitem__, rest))
            except Odd:
                return self._whole_steps(text)
        return self._special_steps(text)

    def _special_steps(self, text: str) -> bytes:
        """Steps of a text with special strings: plain runs, and each special string cut at every prefix."""
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        out, at, plain = bytearray(), 0, ""
        for part in cut.split(text):
            if part not in self.special:
                steps = self._whole_steps(part)
                out += steps
                at += int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))
                plain = part
                continue
            base, before = at - self.count(plain), at
            for i, c in enumerate(part, 1):
                now = at + 1 if i == len(part) else base + self.count(plain + part[:i])
                out += bytes(len(c.encode()) - 1) + ((now - before) & 0xFF).to_bytes(1, "little")
                before = now
            at, plain = at + 1, ""
        return bytes(out)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary of a file, once for each Python worker."""
    return Bpe(path)
