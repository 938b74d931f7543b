"""Counts over a text's bytes, words and lines."""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(h: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of `width` words that occurs twice or more in h."""
    mask = np.zeros(len(h), bool)
    w = window_hashes(h, width)
    if len(w) < 2:
        return mask
    order = np.argsort(w, kind="stable")
    same = np.zeros(len(w), bool)
    equal = w[order[1:]] == w[order[:-1]]
    same[order[1:]] = equal
    same[order[:-1]] |= equal
    starts = np.flatnonzero(same)
    if len(starts):
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        mask = np.cumsum(edge)[:-1] > 0
    return mask


class Counts:
    """What the rules and features need of one text (a null one counts as empty)."""

    def __init__(self, text: str | None):
        self.data = text.encode("utf-8", "surrogatepass") if text else b""
        self.n_chars = len(text or "")
        self.words = self.data.split()
        self.hashes = word_hashes(self.words)
        self.n_words = len(self.words)
        self.word_chars = self.n_chars - (len(self.data) - len(self.data.translate(None, SPACE)))
        self.n_symbols = len(self.data) - len(self.data.translate(None, SYMBOLS))
        lines = [x for x in self.data.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = int(repeated_words(self.hashes, 5).sum())
