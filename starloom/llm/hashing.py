"""Vectorised 64-bit hashes of words and word shingles of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: An odd multiplier of prefix polynomials and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Another one, for a second hash of what the first finds equal.
BASE_2 = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=6)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


def _room(n: int) -> int:
    return max(1 << 20, 1 << (n - 1).bit_length())


def prefix_sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """p[i]: the polynomial hash of data[:i]; data[a:b] hashes to (p[b] - p[a]) * base ** -a."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, _room(n + 1))[:n], out=out[1:])
    return out


def inverses(n: int, base: int = BASE) -> np.ndarray:
    return powers(INVERSE if base == BASE else pow(base, -1, 1 << 64), _room(n + 1))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-space bytes, A-Z lower-cased) and the number of words of each text."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = prefix_sums(_LOWER[data])
    hashes = mixed((sums[ends] - sums[starts]) * inverses(len(data))[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(starts, stops)
    return hashes, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as its one shingle."""
    hashes, counts = word_hashes(texts)
    factors = powers(0xD6E8FEB86659FD93, size + 1)[1:]
    n = len(hashes)
    sums = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size if len(sums) else 0):
        sums += hashes[i : n - size + 1 + i] * factors[i]
    sums = mixed(sums + np.uint64(size))
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(sums[at : at + c - size + 1]))
        elif c:
            out.append(mixed((hashes[at : at + c] * factors[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes | None]]]:
    """Consecutive rows of a string column, about ``most`` bytes at a time: (first row, texts); a longer text is alone."""
    column = column.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) + 1 if len(column) else []
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(column):
        yield start, column.slice(start).to_pylist()
    release()


def release() -> None:
    """Gives unused memory back to the system: workers stay alive between tasks, and many of them share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        return
