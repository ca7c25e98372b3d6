"""Byte-pair vocabularies of rank files, and where they and their pre-tokenizing pattern cut a text for certain."""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import cached_property

import numpy as np
import tiktoken

#: Folder of the rank files; they are read on the driver and sent to the workers, and no copy is kept.
FOLDER = os.environ.get("TREELINE_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
#: The pattern whose pieces piece_starts finds; merges never cross them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_wide: list[np.ndarray] = []


def rank_file(path: str | None = None) -> bytes:
    with open(path or os.path.join(FOLDER, FILE), "rb") as f:
        return f.read()


def _kind(cp: int) -> int:
    c = unicodedata.category(chr(cp))[0]
    return LETTER if c == "L" else NUMBER if c == "N" else OTHER


def _kinds() -> np.ndarray:
    """Class of each code point."""
    if not _wide:
        t = np.array([_kind(i) for i in range(0x110000)], np.uint8)
        t[_SPACES] = SPACE
        t[32] = BLANK
        _wide.append(t)
    return _wide[0]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def borders(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """offsets with further ones about every `size` bytes within longer texts, and the places of the given ones among them.

    They are at blanks between two ASCII letters, where a piece begins whatever else the text has, so that encoding the
    parts apart gives what encoding the text gives. A part that has no such blank stays whole.
    """
    more = []
    for r in np.flatnonzero(np.diff(offsets) > 2 * size).tolist():
        at, end = int(offsets[r]) + size, int(offsets[r + 1])
        while at < end - size:
            w = data[at : min(at + size, end)]
            blank = (w[1:-1] == 32) & _ASCII_LETTER[w[:-2]] & _ASCII_LETTER[w[2:]]
            k = int(blank.argmax()) if len(blank) else 0
            if len(blank) and blank[k]:
                more.append(at + k + 1)
                at += k + 1 + size
            else:
                at += max(1, len(w) - 2)
    if not more:
        return offsets, np.arange(len(offsets))
    return np.sort(np.concatenate([offsets, np.array(more, offsets.dtype)])), np.arange(len(offsets)) + np.searchsorted(more, offsets, "left")


class Vocabulary:
    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # Only pieces are encoded with it; the pattern is found by piece_starts.
        self.piece = tiktoken.Encoding("pieces", pat_str="x", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = tokens[-1][1] + 1
        length = np.zeros(self.size, np.int64)
        for t, r in tokens:
            length[r] = len(t)
        self.length = length
        self.start = np.concatenate([[0], np.cumsum(length)])
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        #: never[a << 8 | b]: the bytes a and b stand side by side in no token, so that every text is cut between them.
        self.never = np.ones(1 << 16, bool)
        pair = (self.flat[:-1].astype(np.int64) << 8) | self.flat[1:]
        inside = np.ones(len(self.flat), bool)
        inside[self.start[1:-1][length[1:] > 0] - 0] = False
        self.never[pair[inside[1:]]] = False
        self.kinds = _kinds()

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        """The vocabulary's own encoder."""
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def classes(self, data: np.ndarray) -> np.ndarray:
        """Class of the character that each byte belongs to."""
        out = self.kinds[:128][np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            wide = np.zeros(len(data) + 3, np.int64)
            wide[: len(data)] = data
            b = wide[lead]
            n = 2 + (b >= 0xE0) + (b >= 0xF0)
            c = [wide[lead + k] & 63 for k in (1, 2, 3)]
            cp = np.where(n == 2, (b & 31) << 6 | c[0], np.where(n == 3, (b & 15) << 12 | c[0] << 6 | c[1], (b & 7) << 18 | c[0] << 12 | c[1] << 6 | c[2]))
            k = self.kinds[np.minimum(cp, 0x10FFFF)]
            for j in range(4):
                at = lead[n > j] + j
                ok = at < len(data)
                out[at[ok]] = k[n > j][ok]
        return out

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True at the bytes where a piece of the pattern begins. Texts begin at offsets."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        start[offsets] = True
        new = start[:n].copy()
        if not n:
            return new
        cls = self.classes(data)
        solid = cls < SPACE
        before, was = np.empty_like(cls), np.empty_like(solid)
        before[0], before[1:] = OTHER, cls[:-1]
        was[0], was[1:] = False, solid[:-1]
        then = np.zeros(n, bool)
        then[:-1] = solid[1:] & ~new[1:]
        begins = new | np.where(solid, np.where(was, cls != before, before == SPACE), was | then)
        tail = data & 0xC0 == 0x80
        wide = np.flatnonzero(tail & ~solid)
        if len(wide):
            # White space of several bytes: it begins at its first byte, if followed by something solid or after it.
            begins[wide] = False
            for i in np.flatnonzero((data >= 0xC0) & ~solid):
                e = i + 1
                while e < n and tail[e]:
                    e += 1
                begins[i] = new[i] or was[i] or (e < n and solid[e] and not new[e])
        quote = np.flatnonzero((data == 39) & begins)
        if len(quote):
            end = np.searchsorted(offsets, quote, "right")
            end = offsets[end]
            ends_at = np.full(len(quote), -1)
            padded = np.zeros(n + 3, np.uint8)
            padded[:n] = data
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [115, 116, 109, 100]) & (quote + 1 < end)
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (quote + 2 < end)
            ends_at[one] = quote[one] + 2
            ends_at[two] = quote[two] + 3
            hit = ends_at > 0
            begins[quote[hit] + 1] = False
            after = ends_at[hit]
            begins[after[after < n]] = True
        return begins

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True where encoding starts afresh: pieces of the pattern, and pairs of bytes that are in no token."""
        begins = self.piece_starts(data, offsets)
        if len(data) > 1:
            begins[1:] |= self.never[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        return begins
