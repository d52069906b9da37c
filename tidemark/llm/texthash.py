"""Vectorised word hashing over Arrow string columns.

A word is a run of ``[^\\x20\\x09-\\x0D]`` bytes; since every separator is ASCII, the byte view of UTF-8
finds the same words as the code-point view. Hashes are 64-bit, the same in every process, and
computed without one Python object a word. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What is left of a block of eight bytes when the first 0 to 8 count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of text that are worked on at once, about: the arrays beside them take some ten times as much.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a string column as (bytes, offsets), of about ``most`` bytes or one document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each document."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off) - 1, np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    per_doc = np.diff(np.searchsorted(starts, off))
    return starts, ends, per_doc


def word_blocks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word as blocks of eight bytes, zeros behind its end, one word after the other; and the blocks of each word."""
    per_word = (ends - starts + 7) >> 3
    first = np.cumsum(per_word) - per_word
    within = np.arange(int(per_word.sum())) - np.repeat(first, per_word)
    at = np.repeat(starts, per_word) + 8 * within
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    anywhere = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    return anywhere[at] & _FIRST[np.minimum(np.repeat(ends, per_word) - at, 8)], per_word


def hash_blocks(blocks: np.ndarray, per_word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its blocks: each is mixed with its place before they are added up."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(per_word) - per_word
    within = (np.arange(len(blocks)) - np.repeat(first, per_word)).astype(np.uint64)
    value = mix(mix(blocks + _ODD) ^ mix((within + np.uint64(1)) * _ODD))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (none is empty), ``A-Z`` lower-cased first if asked."""
    blocks, per_word = word_blocks(_LOWER[raw] if lower else raw, starts, ends)
    return hash_blocks(blocks, per_word, ends - starts)


def word_hashes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of every word, words of each document) for each slice of the column, in order."""
    for raw, off in slices(texts):
        starts, ends, per_doc = words(raw, off)
        yield hash_words(raw, starts, ends, lower), per_doc
