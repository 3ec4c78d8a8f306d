"""64-bit hashes of word shingles, computed over whole batches of texts without a Python loop over words.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct ``size``-word
shingles, or the whole sequence if there are fewer words. Word hashes come from one polynomial
prefix sum over the batch's bytes; shingle hashes mix those of their words in order.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}
#: Texts are hashed in runs of about so many bytes; working arrays take some 40 times as much.
RUN = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if _powers["n"] < n:
        m = max(n, RUN + 1)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            step = np.full(m, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        _powers["n"] = m
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, and the index in ``texts`` of each word."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    n = len(data)
    blank = _BLANK[data]
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[_LOWER[data]] * up[:n], out=sums[1:])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of the batch one after another, each sorted, and the ``len(texts) + 1`` offsets of the sets."""
    words, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    acc = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        shifted = words if k == 0 else np.concatenate([words[k:], np.zeros(min(k, len(words)), dtype=np.uint64)])
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + shifted + np.uint64(k))
    left = first[1:][owner] - np.arange(len(words))
    whole = left >= size
    keys, of = acc[whole], owner[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            value = words[np.where(has, first[short] + k, 0)]
            extra = np.where(has, mix(extra * np.uint64(0xD6E8FEB86659FD93) + value + np.uint64(k)), extra)
        keys, of = np.concatenate([keys, mix(extra + count[short].astype(np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((keys, of)) if len(short) else None
    if order is None:
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            keys[a:b].sort()
    else:
        keys, of = keys[order], of[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[fresh], of[fresh]
    return keys, np.searchsorted(of, np.arange(len(texts) + 1))


def runs_of(sizes: list[int], most: int = RUN):
    """(begin, end) of runs of items of about ``most`` bytes together."""
    begin, total = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def in_runs(texts: list[bytes], sets) -> tuple[np.ndarray, np.ndarray]:
    """As ``sets(texts)``, with working arrays of one run's size."""
    parts, counts = [], [np.zeros(1, dtype=np.int64)]
    for lo, hi in runs_of([len(t) for t in texts]):
        keys, offsets = sets(texts[lo:hi])
        parts.append(keys)
        counts.append(np.diff(offsets))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.cumsum(np.concatenate(counts))
