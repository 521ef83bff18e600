"""Word shingles of texts as sorted 64-bit hashes, computed for a whole batch at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

WIDTH = 5
U = np.uint64
P = 0x9E3779B97F4A7C15 | 1


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse for i < n at least, modulo 2**64; kept for the largest n so far."""
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(n, U(P)), np.full(n, U(pow(P, -1, 1 << 64)))
        up[0] = down[0] = U(1)
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes hashed at a time; small, so that a task's arrays stay at a few MB.
CHUNK = 1 << 18


def word_hashes(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the words of a byte array that begins and ends with white space."""
    gap = SPACE[content]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    hashes = np.empty(len(start), U)
    first = 0
    while first < len(start):  # a run of whole words at a time
        last = max(first + 1, int(np.searchsorted(stop, start[first] + CHUNK)))
        low, high = start[first], stop[last - 1]
        up, down = powers(1 << max(19, int(high - low + 1).bit_length()))
        sums = np.zeros(high - low + 1, U)
        np.cumsum((content[low:high].astype(U) + U(1)) * up[: high - low], out=sums[1:])
        a, b = start[first:last] - low, stop[first:last] - low
        hashes[first:last] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
        first = last
    return hashes, start


def shingles(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words than ``width`` has one shingle of all its words; one without words has none.
    Different shingles have equal hashes with a chance of about 2**-64 per pair.
    """
    joined = b" " + b" ".join(texts) + b" "
    hashes, start = word_hashes(np.frombuffer(joined, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    last = np.searchsorted(start, ends)
    out, first = [], 0
    n = max(len(hashes) - width + 1, 0)
    slid = np.zeros(n, U)
    for k in range(width):
        slid = mixed(slid + hashes[k : k + n] * U(2 * k + 1))
    for stop in last:
        count = stop - first
        if count >= width:
            out.append(np.unique(slid[first : stop - width + 1]))
        elif count:
            one = np.array([count], U)
            for k in range(first, stop):
                one = mixed(one * U(3) + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, U))
        first = stop
    return out


def blocks(column: pa.Array, size: int = CHUNK):
    """The texts of a column as bytes, null as empty, in runs of about ``size`` bytes."""
    held, used = [], 0
    for x in column.cast(pa.binary()):
        t = x.as_py() or b""
        held.append(t)
        used += len(t)
        if used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


@cache
def minhash_factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20210521)
    return rng.integers(0, 1 << 63, count, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, count, dtype=U)


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` 32-bit minima of each non-empty set, as rows."""
    if not sets:
        return np.zeros((0, count), np.uint32)
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    by, plus = minhash_factors(count)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((every * by[k] + plus[k]) >> U(32)).astype(np.uint32), at)
    return out
