"""Secrets in texts: fixed patterns, and windows of high entropy within strings of each character class.

Candidate strings are runs of the characters that keys are written in. Within them each class of
characters (hexadecimal; one case and digits; any) has runs of its own, over which a window slides.
Its Shannon entropy is kept by counts: a step adds one character and takes one away, so the sum of
c * log2 c changes by two table entries. Windows over the class's bound that hold the kinds of
characters it asks for are joined to spans, unless what is allowed (UUIDs, digests that say so, links,
placeholders, strings of a list) covers them. The sums are scaled integers, so a window's verdict is
the same wherever it is computed.

Texts are scanned whole, each by itself: repeated rows give equal rows, a null text is empty, an empty
table gives no rows, and other columns are left alone; one with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, col, fresh

#: Kinds of spans in the order in which those of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns over UTF-8 bytes, where ignoring case means ASCII letters only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
#: Runs are maximal and hold no second start that could be longer, so the least length can be in the pattern.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGNED = 6
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Two to this power is 1 in the integer sums of c * log2 c.
BITS = 32
_KIND_OF = np.zeros(256, dtype=np.uint8)
for _bit, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")):
    _KIND_OF[list(_chars)] = 1 << _bit
LOWER, UPPER, DIGIT = 1, 2, 4


@dataclass(frozen=True)
class CharacterClass:
    """Runs of a class's characters, the window over them, the bits a window must have and the kinds (any of each group) it must hold."""

    runs: re.Pattern
    window: int
    bits: float
    needs: tuple[int, ...]


CLASSES = (
    CharacterClass(re.compile(rb"[0-9A-Fa-f]{24,}"), 24, 3.0, (LOWER | UPPER, DIGIT)),
    CharacterClass(re.compile(rb"[0-9a-z]{24,}|[0-9A-Z]{24,}"), 24, 3.6, (LOWER | UPPER, DIGIT)),
    CharacterClass(re.compile(rb"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7, (LOWER, UPPER, DIGIT)),
)
#: What is random or looks so, and is no secret.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        rb"(?i)(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])",
        rb"(?i)\b(?:sha(?:1|224|256|384|512)|md5)[-:=]\s?[A-Za-z0-9+/=_-]+",
        rb"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
        rb"(?:https?|ftp)://[^\s\"'<>]+",
    )
)
#: A candidate string with one of these in it is made up for show.
PLACEHOLDER = re.compile(rb"(?i)example|placeholder|changeme|xxxxxx|your[_-]?(?:api|key|token|secret)|0123456789|abcdefghijklmnop")


def _sums(size: int) -> np.ndarray:
    """c * log2 c for c from 0 to ``size``, as integers."""
    return np.array([round(c * math.log2(c) * (1 << BITS)) if c else 0 for c in range(size + 1)], dtype=np.int64)


def bound_of(kind: CharacterClass) -> int:
    """The largest sum of c * log2 c that a window of enough entropy has: log2 w - sum / w is at least the bits."""
    return math.floor(kind.window * (math.log2(kind.window) - kind.bits) * (1 << BITS))


def window_sums(run: np.ndarray, window: int) -> np.ndarray:
    """The sum of c * log2 c over the character counts c of every window of a run (bytes), by what comes and goes.

    How often the coming character is in the window, and the going one, is read from where each
    character's occurrences begin to lie within it; so no window is counted anew.
    """
    size = len(run)
    table = _sums(window + 1)
    gain = np.diff(table)
    # occurrences by character, then position
    keys = np.sort(run.astype(np.int64) * (size + 1) + np.arange(size))
    here = run.astype(np.int64) * (size + 1) + np.arange(size)
    rank = np.searchsorted(keys, here)
    # up to the first full window characters only come
    before = rank - np.searchsorted(keys, np.maximum(here - window, run.astype(np.int64) * (size + 1)))
    change = gain[before]
    gone = here[: size - window]
    stay = np.searchsorted(keys, gone + window, side="right") - rank[: size - window]
    change[window:] -= gain[stay - 1]
    return np.cumsum(change)[window - 1 :]


def strong_windows(run: bytes, kind: CharacterClass) -> np.ndarray:
    """The first places of a run's windows that have the class's entropy and kinds of characters."""
    chars = np.frombuffer(run, dtype=np.uint8)
    w = kind.window
    strong = window_sums(chars, w) <= bound_of(kind)
    for need in kind.needs:
        held = np.cumsum(np.append(0, (_KIND_OF[chars] & need) > 0))
        strong &= held[w:] > held[:-w]
    return np.flatnonzero(strong)


def entropy_spans(text: bytes, classes: Iterable[CharacterClass] = CLASSES) -> list[tuple[int, int]]:
    """Byte spans of strong windows, those that overlap or touch joined, over all classes and all candidates but placeholders."""
    found: list[tuple[int, int]] = []
    for candidate in CANDIDATE.finditer(text):
        if PLACEHOLDER.search(text, candidate.start(), candidate.end()):
            continue
        for kind in classes:
            for run in kind.runs.finditer(text, candidate.start(), candidate.end()):
                firsts = strong_windows(run[0], kind) + run.start()
                if len(firsts):
                    breaks = np.flatnonzero(np.diff(firsts) > kind.window)
                    found += zip(firsts[np.append(0, breaks + 1)].tolist(), (firsts[np.append(breaks, len(firsts) - 1)] + kind.window).tolist(), strict=True)
    joined: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the fixed patterns' whole matches, in bytes."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def added_spans(text: bytes, base: list[tuple[int, int, int]], allowed: tuple[re.Pattern, ...] = ALLOWED, known: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int]]:
    """Spans of high entropy that no base span and nothing allowed covers."""
    found = entropy_spans(text)
    if not found:
        return []
    covers = [(s, e) for s, e, _ in base] + [m.span() for p in allowed for m in p.finditer(text)]
    covers += [m.span() for k in known for m in re.finditer(re.escape(k), text)]
    return [(s, e, 3) for s, e in found if not any(a <= s and e <= b for a, b in covers)]


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as spans of code points."""
    if not spans or text.isascii():
        return spans
    buf = np.frombuffer(text, dtype=np.uint8)
    place, at, seen = {}, 0, 0
    for offset in sorted({x for s, e, _ in spans for x in (s, e)}):
        seen += int(np.count_nonzero((buf[at:offset] & 0xC0) != 0x80))
        place[offset], at = seen, offset
    return [(place[s], place[e], k) for s, e, k in spans]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


FOUND = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "n_entropy": "bigint", "base_sha256": "string", "spans": "string"}


def scan(docs: DataFrame, text_col: str = "text", allowed: tuple[re.Pattern, ...] = ALLOWED, known: Iterable[str] = ()) -> DataFrame:
    """``docs`` with the counts of each kind of span, a digest of the base ones and all spans as text.

    Spans are kind:start:end in code points, the end exclusive; a base span is the whole match.
    ``known`` are strings (of the configuration, so few) that are never reported for their entropy.
    """
    bound_batches(docs.sparkSession)
    listed_known = frozenset(k.encode() for k in known)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {t}" for n, t in FOUND.items()) + ">")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                text = value.as_py() or b""
                base = base_spans(text)
                spans = code_points(text, base + added_spans(text, base, allowed, listed_known))
                counts = [sum(s[2] == k for s in spans) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed([s for s in spans if s[2] < 3]).encode()).hexdigest(), listed(spans)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*FOUND])

    made = fresh(docs, "found")
    others = [col(c) for c in docs.columns if c.lower() not in FOUND]
    return docs.withColumn(made, found(col(text_col).cast("binary"))).select(*others, *(col(made)[n].alias(n) for n in FOUND))
