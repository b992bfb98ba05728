"""Word and shingle hashes of whole texts, worked out for many texts at a time with NumPy.

Texts are UTF-8 bytes; A-Z is lower-cased and the six ASCII white-space
characters part words.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
PIECE_BYTES = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WEIGHT = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        factors = np.full(max(n, PIECE_BYTES), base, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n > 4 * PIECE_BYTES:
            return have  # for one giant word: not worth keeping
        _powers[name] = have
    return have


def _piece_hashes(data: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a run of bytes that does not cut a word."""
    space = spaces[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_WEIGHT[_LOWER[data]] * _power("up", _BASE, n)[:n], dtype=np.uint64)))
    down = _power("down", pow(_BASE, -1, 1 << 64), n)
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: Sequence[bytes], spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one more entry than texts).

    ``spaces`` tells for each byte value whether it parts words; a space must.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data):  # on to the next white space
            gap = np.flatnonzero(spaces[data[end - 1 : end + 65536]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 65536, len(data))
        h, s = _piece_hashes(data[at:end], spaces)
        hashes.append(h)
        places.append(s + at)
        at = end
    words, starts = np.concatenate(hashes), np.concatenate(places)
    return words, np.searchsorted(starts, begins)


def _fold(columns: Sequence[np.ndarray], seed: int) -> np.ndarray:
    h = columns[0] ^ _U(seed)
    for c in columns[1:]:
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + c
    return mix(h)


def shingle_sets(texts: Sequence[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``size`` words has one shingle, its whole word sequence;
    a text without words has none.
    """
    words, bounds = word_hashes(texts)
    n = len(words) - size + 1
    rolled = _fold([words[k : k + n] for k in range(size)], size) if n > 0 else words[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield _fold([words[i : i + 1] for i in range(a, b)], b - a)
        else:
            yield words[:0]


def batches(texts: Sequence[bytes], most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most_bytes`` each; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most_bytes:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)
