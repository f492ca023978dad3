"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once per worker.

A byte-level BPE splits a text by a fixed pattern into pieces and encodes every piece by itself. The
pieces of texts whose characters are all below LIMIT, where the pattern's classes are plain, are
found here in numpy; the library's model encodes those that the worker has not met before, with a
character for each byte as the byte-level pre-tokenizer has it. Any other text
goes to the library whole: one with a character from LIMIT on, one that names an added token, and all
texts if the tokenizer file says that it splits or changes texts in another way.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .bytetext import BYTE_HASH, HashIndex, Slice, text_slices

#: The pattern that a byte-level pre-tokenizer splits by, and pieces are cut by here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 0x250
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 600_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.full(LIMIT, OTHER, dtype=np.uint8)
    for i in range(LIMIT):
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            if regex.fullmatch(pattern, chr(i)):
                table[i] = kind
    return table


@lru_cache(maxsize=1)
def byte_characters() -> np.ndarray:
    """The character by which a byte-level tokenizer file names each byte: its own if that is printed, else one from 256 on."""
    shown = np.zeros(256, dtype=bool)
    for low, high in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        shown[low : high + 1] = True
    return np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u2")


def piece_starts(chars: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start in the joined characters of texts; offs has the start of each text and the end of the last."""
    n = len(chars)
    kind = classes()[chars]
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start |= first[:n]
    # runs of white space before other characters of the text: the last one stands alone, or goes with what follows if it is a space
    white = kind == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    start[last] = True
    joined = last[chars[last] == 0x20]
    start[joined + 1] = False
    # contractions where a piece would start with an apostrophe
    at = np.flatnonzero((chars == 0x27) & start)
    after = np.concatenate([chars, np.zeros(2, dtype=chars.dtype)])
    ends = offs[np.searchsorted(offs, at, side="right")]
    one, two = np.where(at + 1 < ends, after[at + 1], 0), np.where(at + 2 < ends, after[at + 2], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for which, size in ((short, 2), (long & ~short, 3)):
        hit = at[which]
        start[hit + 1] = False
        if size == 3:
            start[hit + 2] = False
        follow = hit + size
        start[follow[follow < n]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        said = json.loads(self.library.to_str())
        cuts = said.get("pre_tokenizer") or {}
        #: Whether pieces may be cut here.
        self.cuts = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and not said.get("normalizer") and not said.get("truncation") and not said.get("padding") and said["model"].get("type") == "BPE" and not said["model"].get("dropout")
        self.added = [t["content"].encode() for t in said.get("added_tokens") or []]
        self._forget()

    def _forget(self) -> None:
        self.number = HashIndex()
        self.pool, self.filled = np.zeros(1 << 16, dtype=np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _learn(self, kinds: np.ndarray, pieces: list[str]) -> None:
        """Remembers pieces, given in byte_characters."""
        made = [[token.id for token in self.model.tokenize(piece)] for piece in pieces]
        size = np.array([len(x) for x in made], dtype=np.int64)
        ids = np.array([i for x in made for i in x], dtype=np.uint32)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        known = self.number.n
        while known + len(pieces) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.size[known : known + len(pieces)] = size
        self.begin[known : known + len(pieces)] = self.filled + np.cumsum(size) - size
        self.filled += len(ids)
        self.number.insert(kinds, known + np.arange(len(pieces)))

    def _plain(self, part: Slice, chars: np.ndarray, char_offs: np.ndarray, byte_at: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose characters, which are at byte_at, are all below LIMIT."""
        starts = piece_starts(chars, char_offs)
        begin = byte_at[starts]
        end = np.append(begin[1:], len(part.buf)) if len(starts) else begin
        hashes = part.hash_spans(part.prefix_hash(BYTE_HASH), begin, end)
        index = self.number.lookup(hashes)
        if (index < 0).any():
            if self.number.n > CACHE_PIECES:
                self._forget()
                index[:] = -1
            new = np.flatnonzero(index < 0)
            kinds, first = np.unique(hashes[new], return_index=True)
            named, some = byte_characters()[part.buf].tobytes().decode("utf-16-le"), new[first]
            self._learn(kinds, [named[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
            index[new] = self.number.lookup(hashes[new])
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, char_offs)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null one has none."""
        out: list[np.ndarray] = []
        for part in text_slices(texts):
            raw = part.buf.tobytes()
            if not self.cuts:
                out += [self._whole(raw[a:b]) for a, b in zip(part.offs[:-1].tolist(), part.offs[1:].tolist(), strict=True)]
                continue
            chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            byte_at = np.flatnonzero((part.buf & 0xC0) != 0x80)
            char_offs = np.searchsorted(byte_at, part.offs)
            plain = np.diff(np.searchsorted(np.flatnonzero(chars >= LIMIT), char_offs)) == 0
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    plain[np.searchsorted(part.offs, at, side="right") - 1] = False
                    at = raw.find(token, at + 1)
            if plain.all():
                out += self._plain(part, chars, char_offs, byte_at)
                continue
            for i in range(part.n):
                a, b = part.offs[i], part.offs[i + 1]
                if plain[i]:
                    some = Slice(part.first + i, part.buf[a:b], np.array([0, b - a]))
                    which = slice(char_offs[i], char_offs[i + 1])
                    out += self._plain(some, chars[which], char_offs[i : i + 2] - char_offs[i], byte_at[which] - a)
                else:
                    out.append(self._whole(raw[a:b]))
        return out

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
