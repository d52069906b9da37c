"""Vectorised pre-tokenisation for the public byte-level BPE vocabularies, and a bounded memo of encodings.

The public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
splits a text by runs of four classes (letters, numbers, white space, the rest), where
* the last character of a run of white space that something follows stands alone, and if it is a
  blank it opens the run that follows;
* an apostrophe alone, at the start of a match, takes along a following s, t, re, ve, m, ll or d.
That needs no regular expression: the starts of all matches are one Boolean expression over arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from tidemark.llm.texthash import SLICE, hash_blocks, slices, word_blocks

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
# The Unicode White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = np.fromiter(
        ({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
        dtype=np.uint8,
        count=0x110000,
    )
    kind[WHITE_SPACE] = WHITE
    return kind


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every pre-token of the documents, and the number in each document."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off) - 1, np.int64)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(lead) == len(raw):
        cp = raw.astype(np.uint32)
    else:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    doc = np.searchsorted(lead, off)
    opens = np.zeros(n + 1, bool)
    opens[doc] = True
    kind = classes()[cp]
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    # white space that something of its own document follows
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~opens[1:n]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~opens[1:n]
    start = (run & white) | last | (run & ~white & ~blank_before)
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        _contractions(quote, cp, kind, run, opens, start)
    at = np.flatnonzero(start)
    begin = lead[at]
    end = np.append(begin[1:], len(raw))
    return begin, end, np.diff(np.searchsorted(at, doc))


def _contractions(quote, cp, kind, run, opens, start) -> None:
    n = len(cp)
    padded = np.concatenate((cp, np.zeros(3, cp.dtype)))
    own = np.concatenate((opens[:n], np.ones(3, bool)))
    one, two = padded[quote + 1], padded[quote + 2]
    here = ~own[quote + 1]
    single = here & np.isin(one, [ord(c) for c in "stmd"])
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    double = here & pair & ~own[quote + 2]
    for found, size in ((quote[single], 2), (quote[double], 3)):
        start[found + 1] = False
        rest = found + size
        rest = rest[rest < n]
        rest = rest[(kind[rest] == LETTER) & ~run[rest]]
        start[rest] = True


class Memo:
    """Encodings of pre-tokens. They are found by a hash and used only where all bytes agree.

    When ``most`` are held, or ``room`` blocks of eight bytes, it starts anew, so memory is bounded by these and one slice.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 500_000, room: int = 4_000_000):
        self.encode, self.most, self.room = encode, most, room
        self.clear()

    def clear(self) -> None:
        # the slot of each hash, by hash; of each slot its size, its blocks and its ids
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.block_at, self.blocks = np.zeros(1, np.int64), np.zeros(0, np.uint64)
        self.id_at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, raw, begin, end, blocks, per_token, which: np.ndarray) -> np.ndarray:
        """New slots for these pre-tokens of a slice."""
        data = raw.tobytes()
        coded = self.encode([data[a:b] for a, b in zip(begin[which].tolist(), end[which].tolist())])
        first = np.cumsum(per_token) - per_token
        base = len(self.size)
        self.size = np.concatenate((self.size, (end - begin)[which]))
        self.blocks = np.concatenate((self.blocks, blocks[gather(first[which], per_token[which])]))
        self.block_at = np.concatenate((self.block_at, self.block_at[-1] + np.cumsum(per_token[which])))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        self.ids = np.concatenate((self.ids, np.array([i for ids in coded for i in ids], np.uint32)))
        self.id_at = np.concatenate((self.id_at, self.id_at[-1] + np.cumsum(sizes)))
        return base + np.arange(len(which))

    def encode_slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each document)."""
        begin, end, per_doc = spans(raw, off)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        if len(self.size) > self.most or len(self.blocks) > self.room:
            self.clear()
        size = end - begin
        blocks, per_token = word_blocks(raw, begin, end)
        some, where, back = np.unique(hash_blocks(blocks, per_token, size), return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, some)
        known = np.zeros(len(some), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == some[inside]
        slots = np.full(len(some), -1)
        slots[known] = self.slot[at[known]]
        if not known.all():
            slots[~known] = self._add(raw, begin, end, blocks, per_token, where[~known])
            self.key = np.insert(self.key, at[~known], some[~known])
            self.slot = np.insert(self.slot, at[~known], slots[~known])
        used = slots[back]
        # a slot of another text with the same hash doesn't count: such a pre-token gets a slot that no hash finds
        same = self.size[used] == size
        fits = np.flatnonzero(same)
        theirs = self.blocks[gather(self.block_at[used[fits]], per_token[fits])]
        own = blocks if len(fits) == len(size) else blocks[gather((np.cumsum(per_token) - per_token)[fits], per_token[fits])]
        cuts = np.cumsum(per_token[fits]) - per_token[fits]
        if len(fits):
            same[fits] = np.logical_and.reduceat(theirs == own, cuts)
        if not same.all():
            other = np.flatnonzero(~same)
            used[other] = self._add(raw, begin, end, blocks, per_token, other)
        count = (self.id_at[1:] - self.id_at[:-1])[used]
        out = self.ids[gather(self.id_at[used], count)]
        done = np.concatenate(([0], np.cumsum(count)))
        edge = np.concatenate(([0], np.cumsum(per_doc)))
        return out, np.diff(done[edge])

    def encode_column(self, texts: pa.Array, most: int = 2 * SLICE) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; null is empty."""
        for raw, off in slices(texts, most):
            ids, sizes = self.encode_slice(raw, off)
            yield from np.split(ids, np.cumsum(sizes)[:-1])


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices ``first[k] .. first[k] + size[k] - 1`` of all k, one after the other."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
