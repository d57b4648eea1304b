"""Words of whole Arrow batches, hashed with numpy: no Python object per document or word.

A word is a maximal run of ASCII letters, ASCII digits and bytes of 0x80 and above (so every non-ASCII character is a
word character), with ASCII letters in lower case. Words don't cross documents. A word's name is a 64-bit fingerprint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of the base's inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, _CHUNK + 1), _INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[key] = have
    return have[:n]


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    b = np.frombuffer(data, np.uint8, off[-1])[off[0] :] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return b, off - off[0]


@dataclass
class Words:
    """hashes[first[d]:first[d+1]] are document d's words; starts and ends are byte offsets into bytes."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bytes: np.ndarray
    offsets: np.ndarray


def spans(b: np.ndarray, off: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[b]
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    at = off[:-1][(off[1:] > off[:-1])]
    st[at] = w[at]
    last = off[1:][(off[1:] > off[:-1])] - 1
    en[last] = w[last]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def fingerprint(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte ranges, which are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        size = int(ends[hi - 1] - base)
        c = np.zeros(size + 1, np.uint64)
        np.cumsum(_LOWER[b[base : base + size]] * powers(size), out=c[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (c[e] - c[s]) * powers(size + 1, True)[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def words(texts: pa.Array | pa.ChunkedArray) -> Words:
    b, off = text_bytes(texts)
    starts, ends = spans(b, off)
    return Words(fingerprint(b, starts, ends), starts, ends, np.searchsorted(starts, off), b, off)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n consecutive values: one for each start, len(hashes) - n + 1 in all (none if shorter)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for lo in range(0, len(out), _CHUNK):
        part = hashes[lo : lo + _CHUNK + n - 1]
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_CHUNK + n)[: len(part)], out=c[1:])
        k = len(part) - n + 1
        out[lo : lo + k] = (c[n:] - c[:-n]) * powers(_CHUNK + n, True)[:k]
    return mix(out)
