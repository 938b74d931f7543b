"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are a text's tokens with a digit or an @. Neighbouring tokens are linked in a
chain; a token is also linked with the next one, however far, that repeats it or resembles it
(same last digits, same name before an @). Loopy belief propagation passes messages along both,
so evidence at one mention bears on the others. A label's spans are added where the field is
sure and no pattern's span is. Beside the patterns' kinds the field knows secrets: what is
assigned to a name such as token or password teaches it how they look.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, bounded_sample, id_field, ids, record, slices, texts, two_columns

# The kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
LABELS = ("other", *KINDS, SECRET)
NAMES = LABELS[1:]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would also start at the run, so only runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
SEED = re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d)[ ]{0,2}[=:][ ]{0,2}[\"']?([A-Za-z0-9_+/-]{16,})")
"""What teaches the field secrets; it finds them by itself, after other names too."""
OUTER = ".,;:!?\"'<>[]{}#$%&*|="
BEFORE = re.compile(r"(\S+)\s*[=:]?\s*[\"'(]?$")

SAMPLE, SAMPLE_BYTES = 2_000, 40_000_000
"""Texts to fit on at most, and bytes of them all after which no further one is taken; chosen by hash, whatever their length."""
SURE = 0.95
ROUNDS = 8


def luhn(digits: str) -> bool:
    total = sum(ord(d) - 48 for d in digits[::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[ord(d) - 48] for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Left-most matches in linear time: each @ with the whole run before it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns alone, sorted; places are code points."""
    out = []
    if not text:
        return out
    out += [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def tokens_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens with a digit or @, without outer marks."""
    out = []
    for m in TOKEN.finditer(text or ""):
        raw = m[0]
        token = raw.strip(OUTER)
        if token:
            start = m.start() + raw.find(token)
            out.append((start, start + len(token), token))
    return out


SIZES = np.array([1, 2, 3, 4, 7, 8, 10, 14, 17, 20])


def shape(token: str) -> list[int]:
    """Features of a token, as the numbers of those that hold."""
    d = digits_of(token)
    letters = any(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    out = [int(np.searchsorted(SIZES, len(d), side="right")), 11 + min(dots, 4), 16 + min(dashes, 3), 20 + letters]
    out.append(22 + ("@" in token) + ("@" in token and "." in token.partition("@")[2].strip(".")))
    out.append(25 + token.startswith("+"))
    out.append(27 + (token[:1] == "(" and token[-1:] == ")"))
    out.append(29 + (14 <= len(d) <= 19 and not letters and luhn(d)))
    out.append(31 + (dots == 3 and not letters and len(d) + 3 == len(token) and all(token.split(".")) and octets(token)))
    out.append(33 + ("=" in token or "_" in token or "/" in token))
    return out


CONTEXTS = 64
HIDDEN = 36 + CONTEXTS
WIDTH = HIDDEN + 1
"""Features of a token's shape, of the word before it (by hash), and one that says that both are hidden."""


def known(text: str, start: int, token: str) -> list[int]:
    """Features of a token in its text: its shape, and the word before it, with whether something is assigned."""
    found = BEFORE.search(text, max(0, start - 40), start)
    word = found[0].strip().lower() if found else ""
    # The hash doesn't depend on the process.
    return [*shape(token), 36 + zlib.crc32(word.rstrip("\"'( ").encode("utf-8", "surrogatepass")) % CONTEXTS]


@dataclass
class Field:
    """Log potentials: unary (features x labels), chain and skip (labels x labels; skip is symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def nodes(self, features: list[list[int]]) -> np.ndarray:
        z = np.zeros((len(features), len(LABELS)))
        for i, f in enumerate(features):
            z[i] = self.unary[f].sum(0)
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True) if len(features) else z


def edges_of(text: str, tokens: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links between tokens with only white space and marks between them, skip links between repeats and likenesses."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 3 and not text[tokens[i][1] : tokens[i + 1][0]].strip(OUTER + " \t")]
    skip, last = [], {}
    for i, (_, _, token) in enumerate(tokens):
        d, name = digits_of(token), token.partition("@")[0].lower() if "@" in token else ""
        keys = {token.lower()} | ({d[-7:]} if len(d) >= 7 else set()) | ({name + "@"} if name else set())
        for j in {last[k] for k in keys if k in last}:
            skip.append((j, i))
        last.update((k, i) for k in keys)
    return chain, skip


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy belief propagation over any number of texts' graphs at once.

    edges: (from, to); kind: the potential of each edge. Every edge carries messages both ways.
    """
    n, k = unary.shape
    if not len(edges):
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
    source = np.concatenate((edges[:, 0], edges[:, 1]))
    target = np.concatenate((edges[:, 1], edges[:, 0]))
    m = len(edges)
    opposite = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
    pot = np.concatenate((potentials[kind], potentials[kind].transpose(0, 2, 1)))
    message = np.zeros((2 * m, k))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, message)
        out = total[source] - message[opposite]
        new = np.logaddexp.reduce(out[:, :, None] + pot, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = unary.copy()
    np.add.at(total, target, message)
    return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def labels_of(text: str, tokens: list[tuple[int, int, str]]) -> list[int]:
    """What the patterns, and for secrets the seed, say of each token."""
    spans = [(a, k + 1, b) for a, k, b in base_spans(text)] + [(m.start(1), len(KINDS) + 1, m.end(1)) for m in SEED.finditer(text)]
    return [next((k for s, k, e in spans if s < b and a < e), 0) for a, b, _ in tokens]


def fit(sample: list[str], steps: int = 250, seed: int = 7) -> Field:
    """A field whose unary, chain and skip weights are learned together, by pseudo-likelihood.

    Each token's label is to follow from its features and its neighbours' labels. The labels are
    what the patterns and the seed find. Every text counts twice: as it is, and with the features
    of half of its tokens hidden at random, so that there only the neighbours along the chain and
    the skip links can tell; that is what teaches the links' weights.
    """
    features, labels, links = [], [], ([], [])
    rng = np.random.default_rng(seed)
    for text in sorted(sample):
        tokens = tokens_of(text)
        found, seen = edges_of(text, tokens), labels_of(text, tokens)
        for hide in (False, True):
            base = len(labels)
            gone = rng.random(len(tokens)) < 0.5 * hide
            features += [[HIDDEN] if g else known(text, a, t) for (a, _, t), g in zip(tokens, gone, strict=True)]
            labels += seen
            for held, edges in zip(links, found, strict=True):
                held += [(base + i, base + j) for i, j in edges]
    n, k = len(labels), len(LABELS)
    if not n:
        only_other = np.zeros((WIDTH, k))
        only_other[:, 0] = 1.0
        return Field(only_other, np.zeros((k, k)), np.zeros((k, k)))
    x = np.zeros((n, WIDTH), np.float32)
    for i, f in enumerate(features):
        x[i, f] = 1
    y = np.eye(k, dtype=np.float32)[labels]
    chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in links)
    left, right, near = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)  # labels of the neighbours, summed
    np.add.at(left, chain[:, 1], y[chain[:, 0]])
    np.add.at(right, chain[:, 0], y[chain[:, 1]])
    np.add.at(near, skip[:, 1], y[skip[:, 0]])
    np.add.at(near, skip[:, 0], y[skip[:, 1]])
    w, c, s = np.zeros((WIDTH, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    w[:, 0] = 0.05  # what nothing speaks for is no personal data
    moments = [[np.zeros_like(m), np.zeros_like(m)] for m in (w, c, s)]
    for step in range(1, steps + 1):
        z = x @ w + left @ c + right @ c.T + near @ s
        r = (y - np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))) / n
        g = near.T @ r
        grads = (x.T @ r - 1e-5 * w, left.T @ r + r.T @ right - 1e-5 * c, (g + g.T) / 2 - 1e-5 * s)
        for m, grad, (one, two) in zip((w, c, s), grads, moments, strict=True):
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            m += 0.05 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(float), c.astype(float), s.astype(float))


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Field:
    """A field fitted on at most `sample` texts that have a digit or an @, fewer where these together reach `size` bytes."""
    text = F.col(f"`{text_col}`")
    known = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    chosen, held = [], 0
    for r in bounded_sample(known.select("h", F.octet_length("text").alias("bytes")), "h", sample).collect():
        if held >= size:
            break
        chosen.append(r.h)
        held += r.bytes
    return fit([r.text for r in known.where(F.col("h").isin(chosen)).select("text").distinct().collect()] if chosen else [])


def added_spans(batch_texts: list[str | None], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text that overlap none of its base spans."""
    held, flat, edges, kind, bounds = [], [], [], [], [0]
    for text in batch_texts:
        tokens = tokens_of(text)
        chain, skip = edges_of(text or "", tokens)
        at = len(flat)
        flat += [known(text, a, t) for a, _, t in tokens]
        edges += [(at + i, at + j) for i, j in [*chain, *skip]]
        kind += [0] * len(chain) + [1] * len(skip)
        held.append((tokens, set(chain)))
        bounds.append(len(flat))
    if not flat:
        return [[] for _ in batch_texts]
    p = beliefs(field.nodes(flat), np.array(edges, np.int64).reshape(-1, 2), np.stack((field.chain, field.skip)), np.array(kind, np.int64))
    label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    out = []
    for text, (tokens, chain), spans, at in zip(batch_texts, held, base, bounds, strict=False):
        found: list[list[int]] = []  # start, kind, end, last token
        for i, (a, b, _) in enumerate(tokens):
            k = int(label[at + i]) - 1
            if k < 0:
                continue
            # A card's or a phone's tokens in a row are one span; a card ends where it has the digits of one.
            more = k in (2, 3) and found and found[-1][1] == k and found[-1][3] == i - 1 and (i - 1, i) in chain
            if more and not (k == 2 and len(digits_of(text[found[-1][0] : found[-1][2]])) >= 14):
                found[-1][2:] = [b, i]
            else:
                found.append([a, k, b, i])
        fits = {0: lambda t: "@" in t, 1: lambda t: t.count(".") >= 3, 2: lambda t: 14 <= len(digits_of(t)) <= 19, 3: lambda t: 7 <= len(digits_of(t)) <= 15, 4: lambda t: len(t) >= 16}
        out.append([(a, k, b) for a, k, b, _ in found if fits[k](text[a:b]) and not any(s < b and a < e for s, _, e in spans)])
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs.

    The numbers and the digest are of the patterns' spans, `kind:start:end` by start and kind,
    joined by commas; spans has the field's too, which may be of the kind secret. Places are code points, the end exclusive.
    Null and empty texts have none. Repeated rows and null ids are kept, one row each; an empty
    table gives an empty one. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = texts(batch)
            base = [base_spans(t) for t in text]
            more = added_spans(text, base, sent.value)
            yield record({
                "doc_id": ids(batch),
                **{f"n_{name}": pa.array([sum(k == i for _, k, _ in b) for b in base], pa.int64()) for i, name in enumerate(KINDS)},
                "base_sha256": pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([listed(b + m) for b, m in zip(base, more, strict=True)], pa.string()),
            })

    return two_columns(docs, id_col, text_col).mapInArrow(rows, f"doc_id {id_field(docs, id_col)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping ones, as its first kind in angle brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{NAMES[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with all spans of text_col masked.

    All rows and columns are kept, repeated rows and null ids too; null texts stay null, empty
    ones empty, and texts of any length are masked whole. An empty table gives an empty one.
    """
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            text = batch.column(at).to_pylist()
            base = [base_spans(t) for t in text]
            more = added_spans(text, base, sent.value)
            new = [masked(t, b + m) if b or m else t for t, b, m in zip(text, base, more, strict=True)]
            yield batch.set_column(at, text_col, pa.array(new, batch.schema.field(at).type))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)
