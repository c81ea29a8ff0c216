"""Word shingles of whole texts as sorted 64-bit hashes, computed batch by batch with numpy.

Words are hashed over the bytes of a batch at once: with b[i] a random number for the
byte at i, a word's hash is the sum of b[i] * R^(i - start) mod 2^64, taken from a
prefix sum, and mixed. Work is cut at blanks into pieces of bounded size, so one very
long text needs no more memory than its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _rng.integers(1, 2**63, 4, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _piece_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of bytes that begin and end at a word's border."""
    word = ~BLANK[data]
    if not word.any():
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every word of one text's bytes, in order; A-Z count as a-z."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data) and not BLANK[data[end]]:  # cut at a blank: the last one of the piece, else the next one
            back = np.flatnonzero(BLANK[data[at:end]])
            if len(back):
                end = at + int(back[-1])
            else:
                while end < len(data):
                    ahead = np.flatnonzero(BLANK[data[end:end + PIECE]])
                    if len(ahead):
                        end += int(ahead[0])
                        break
                    end = min(end + PIECE, len(data))
        if end == at:
            end += 1
        parts.append(_piece_words(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield data[offsets[i]:offsets[i + 1]] if valid else data[:0]


def batch_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text. Short neighbours are hashed together."""
    held: list[np.ndarray] = []
    size = 0
    gap = np.frombuffer(b"\n", np.uint8)

    def flush():
        if not held:
            return
        joined = np.concatenate([x for text in held for x in (text, gap)])
        hashes = word_hashes(joined)
        word = ~BLANK[joined]
        first = word.copy()
        first[1:] &= ~word[:-1]
        ends = np.cumsum([len(text) + 1 for text in held])
        upto = np.cumsum(first)[ends - 1]
        yield from np.split(hashes, upto[:-1])
        held.clear()

    for text in texts_of(column):
        if size + len(text) > PIECE and held:
            yield from flush()
            size = 0
        held.append(text)
        size += len(text) + 1
    yield from flush()


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = mix(h * _ORDER[i % 4] + words[i: len(words) - n + 1 + i])
    return np.unique(mix(h + _U(n)))
