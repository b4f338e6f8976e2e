"""Words of whole texts as 64-bit hashes, many texts at a time in numpy.

A word is a maximal run of bytes that a 256-entry table calls word bytes. Its bytes go into the hash eight at a time, each
time through a mixer that is no polynomial, so patterns of letters do not cancel; words of more than LONG bytes are hashed
by BLAKE2b. Runs of words are hashed by joining halves with the same mixer. Where equality is decided by hashes, two
hashes of different keys are taken together as 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Bytes of the longest word that is hashed in numpy.
LONG = 64

_U = np.uint64
#: Two keys for two hashes of the same words.
KEYS = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words [^\x20\x09-\x0D]+.
NOT_SPACE = ~_SPACE
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a to z, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(32)
    return h


def join(a: np.ndarray, b: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = mix(a + _U(key))
    x ^= b
    return mix(x)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEYS[0]) -> np.ndarray:
    """A 64-bit hash of the bytes low[start:end] of each word; words have a byte at least."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), np.dtype("<u8"), padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _U(key)
    h ^= eight[starts] & _MASK[np.minimum(size, 8)]
    h = mix(h)
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        x = (h[more] + _U(key)) ^ (eight[starts[more] + at] & _MASK[np.minimum(size[more] - at, 8)])
        h[more] = mix(x)
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h


@dataclass
class Words:
    """Texts first .. first + len(bounds) - 2 of a batch: text k has the words bounds[k] .. bounds[k + 1] - 1."""

    first: int
    raw: np.ndarray  # bytes of these texts
    low: np.ndarray  # the same, lower-cased if that was asked for
    text_at: np.ndarray  # offsets of the texts in raw
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def second(self) -> np.ndarray:
        """Hashes of the words by the other key."""
        return word_hashes(self.low, self.starts, self.ends, KEYS[1])

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if at is not None and len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(texts: pa.Array, is_word: np.ndarray = NOT_SPACE, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Words]:
    data, at = buffers(texts)
    for i, j in chunks(at, most):
        raw = data[at[i] : at[j]]
        text_at = at[i : j + 1] - at[i]
        low = LOWER[raw] if lower else raw
        n = len(raw)
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(i, raw, low, text_at, none, none, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64))
            continue
        inside = is_word[low]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before[text_at[:-1][text_at[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after[text_at[1:][text_at[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        hashes = word_hashes(low, starts, ends)
        yield Words(i, raw, low, text_at, starts, ends, hashes, np.searchsorted(starts, text_at))


def window_hashes(hashes: np.ndarray, width: int, key: int = KEYS[0]) -> np.ndarray:
    """The hash of every run of width hashes; run i starts at i. Runs that cross texts are for the caller to drop.

    Runs of 1, 2, 4, ... hashes are joined from halves; those of the width's binary digits make up the whole.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = hashes, 1, None, 0
    while True:
        if width & size:
            out = power[:n] if out is None else join(out, power[done : done + n], key)
            done += size
        if done == width:
            return out.copy() if out is hashes or out.base is hashes else out
        power = join(power[:-size], power[size:], key)
        size *= 2


def starts_inside(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs of width words that stay in one text, number of the text of each)."""
    counts = np.maximum(0, np.diff(bounds) - width + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return np.arange(counts.sum()) - first[text] + bounds[:-1][text], text


def hash_strings(values: list[bytes], key: int = KEYS[0]) -> np.ndarray:
    """The hash that words() gives to each of these words, or that by another key."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    ends = np.cumsum(size)
    return word_hashes(np.frombuffer(b"".join(values), np.uint8), ends - size, ends, key)


class Lookup:
    """Exact map of distinct 64-bit keys to numbers in numpy: open addressing at half load or less."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = keys.astype(np.uint64, copy=False), np.asarray(values, np.int64)
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift = _U(64 - (size.bit_length() - 1))
        self.keys, self.values, self.full = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.zeros(size, bool)
        at, rest, self.most = self._slots(keys), np.arange(len(keys)), 1
        while True:
            # Of the keys that meet in a free slot the first takes it; the others go on.
            free = np.flatnonzero(~self.full[at])
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]], self.full[at[won]] = keys[rest[won]], values[rest[won]], True
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) % size
            if not len(rest):
                break
            self.most += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray, default: int = 0) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        at = self._slots(keys)
        hit, full = self.keys[at] == keys, self.full[at]
        out = np.where(hit & full, self.values[at], default)
        open_ = np.flatnonzero(~hit & full)
        for _ in range(self.most - 1):
            if not len(open_):
                break
            at = (at if len(at) == len(open_) else at[open_]) + 1
            at %= len(self.keys)
            hit, full = self.keys[at] == keys[open_], self.full[at]
            out[open_[hit & full]] = self.values[at[hit & full]]
            more = ~hit & full
            open_, at = open_[more], at[more]
        return out
