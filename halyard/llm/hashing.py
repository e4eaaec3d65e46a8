"""Vectorised 64-bit hashes of words and word shingles, over the bytes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240131))
#: A random odd number for each byte value, and the base of the polynomial with its inverse mod 2**64.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PIECE = 1 << 20

#: ASCII white space (space and 0x09-0x0D) parts words; A-Z are lower-cased.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_POWI = _powers(_INVERSE, 1 << 16)


def _grow(n: int) -> None:
    global _POW, _POWI
    if n > len(_POW):
        size = 1 << int(n).bit_length()
        _POW, _POWI = _powers(_BASE, size), _powers(_INVERSE, size)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a megabyte that end between words."""
    at = 0
    while len(text) - at > _PIECE:
        ends = [e for e in (text.find(c, at + _PIECE) for c in (b" ", b"\n", b"\t")) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def _hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of each word of lower-cased bytes."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _grow(len(b) + 1)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * _POW[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * _POWI[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order; none for null."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        sizes = np.cumsum([0] + [len(g) + 1 for g in group])
        h, start = _hash_bytes(b" ".join(group))
        yield from np.split(h, np.searchsorted(start, sizes[1:-1]))

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if len(data) > _PIECE:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([_hash_bytes(p)[0] for p in _pieces(data)])
            continue
        group.append(data)
        size += len(data)
        if size > _PIECE // 2:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix(np.array([int((words * _STEP[:n]).sum(dtype=np.uint64)) ^ n], np.uint64))
    total = words[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mix(total))
