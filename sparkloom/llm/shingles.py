"""Word shingles and MinHash values, computed for many texts at once in numpy.

A word is a maximal run of letters or digits of the lower-cased text, where every non-ASCII byte counts as a letter. A shingle
is five consecutive words; a text of one to four words has the one shingle of all its words, and a text without words has none.
Shingles stand as 64-bit hashes of their words: two different shingles of one pair of texts meet with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5  #: words a shingle
HASHES = 128  #: MinHash values a text

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads close values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def lower_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts in UTF-8, each with a line feed behind it, and how many bytes each takes with it."""
    raw = [(t.lower().encode("utf-8", "replace") if t else b"") + b"\n" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def words_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and how many words each text has."""
    edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends - starts, np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))


def word_hashes(texts: list[str | None], piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in order, and how many each text has. piece: about how many bytes are worked on at once."""
    data, sizes = lower_bytes(texts)
    starts, lengths, counts = words_of(data, sizes)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + piece)))
        n = lengths[first:last]
        at = np.cumsum(n) - n
        inner = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        terms = (data[np.repeat(starts[first:last], n) + inner].astype(np.uint64) + np.uint64(1)) * _powers(int(n.max()))[inner]
        out[first:last] = mix(np.add.reduceat(terms, at) + n.astype(np.uint64))
        first = last
    return out, counts


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles."""
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _powers(width)[k]
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            s = np.sort(rolled[at : at + count - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif count:
            out.append(mix((hashes[at : at + count] * _powers(count)).sum(dtype=np.uint64, keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * _ODD)
    return (seed[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[hashes:] >> np.uint64(32)).astype(np.uint32)


def minhashes(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """One row of MinHash values for each set, which must not be empty."""
    out = np.empty((len(sets), hashes), np.uint32)
    a, b = _multipliers(hashes)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(lengths)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 32_768, "right")))
        low = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum(lengths[first:last]) - lengths[first:last]
        for k in range(hashes):
            out[first:last, k] = np.minimum.reduceat(low * a[k] + b[k], at)
        first = last
    return out
