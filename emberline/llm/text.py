"""Small helpers that the text operators share inside tasks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def named_apart(names: list[str], name: str) -> str:
    """``name``, made longer until none of ``names`` is it."""
    while name in names:
        name += "_"
    return name


def slices(texts: list[bytes], most: int = 4 << 20):
    """(first, last) row ranges of at most ``most`` bytes each, or one longer row."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Zero-copy slices of a batch with at most ``most`` UTF-8 bytes in a string column each, or one longer row."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    total, first = np.concatenate(([0], np.cumsum(size))), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


_rng = np.random.default_rng(20_011)
BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # letters A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = [np.uint64(x | 1) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xCA5A826395121157, 0x9FB21C651E98DF25)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n, kept for up to a million; longer texts make their own."""
    if n > 1 << 20:
        return _powers(n)
    return tuple(p[:n] for p in _million())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


@functools.cache
def _million() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 20)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that are no ASCII white space, A-Z lowered) and each text's first word's index.

    A polynomial over the bytes is summed once for the whole slice; a word's hash is a difference of two prefix sums,
    moved to the origin and scrambled together with its length.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = powers(len(data) + 1)
    space = SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(space, np.uint64(0), BYTE[data]) * up[: len(data)])))
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, at)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles; a shorter text is one shingle, no words are none."""
    h, at = word_hashes(texts)
    total = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for j in range(width):
        total += mix(h[j : j + len(total)] ^ STEPS[j]) * STEPS[j]
    total = mix(total) >> np.uint64(1)  # 63 bits: a Spark long that is not negative
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for j in range(b - a):
                one = mix(one * STEPS[4] ^ h[a + j])
            out.append(one >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
