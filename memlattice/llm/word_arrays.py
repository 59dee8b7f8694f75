"""The words of many texts at once as numpy arrays of 64-bit hashes, and hashes of their shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Any odd numbers do.
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are worked through at once; a block ends at white space.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit in has to do with every bit out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each begins and ends; null is empty."""
    x = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = x.buffers()
    ends = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _blocks(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end where a text does, or at white space."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + BLOCK, n)
        end = int(cuts[np.searchsorted(cuts, to)])  # of the text that is cut
        while to < end:
            space = _SPACE[data[to : min(to + BLOCK, end)]]
            if space.any():
                to += int(space.argmax())
                break
            to += len(space)
        yield at, to
        at = to


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a hash of every word of all texts, and for each text where its words begin and end among them."""
    data, cuts = _buffer(texts)
    hashes, starts = [], []
    for lo, hi in _blocks(data, cuts):
        block = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        inside = ~_SPACE[block]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)] - lo  # texts that begin in the block
        first[edges] = inside[edges]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            sizes = e - s
            powers = np.full(int(sizes.max()), _BASE)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            at = np.arange(len(block))
            within = np.where(inside, at - np.maximum.accumulate(np.where(first, at, 0)), 0)
            terms = np.where(inside, (block.astype(np.uint64) + np.uint64(1)) * powers[within], np.uint64(0))
            hashes.append(mixed(np.add.reduceat(terms, s) + sizes.astype(np.uint64) * _STEP))
            starts.append(s + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), cuts)


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of hashes; their order and number count."""
    x = columns[0]
    for c in columns[1:]:
        x = mixed(x * _STEP + c)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of one text's words; of the whole sequence if there are fewer words, none without any."""
    n = len(hashes)
    if n < width:
        return chained([hashes[k : k + 1] for k in range(n)]) if n else hashes
    return chained([hashes[k : n - width + 1 + k] for k in range(width)])
