"""Hashes of words and word runs, worked out for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crestline.llm.arrow_text import text_bytes

ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that belong to words: ASCII letters and digits, and every byte of other characters.
WORD_BYTE = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every lower-cased word, in order."""
    raw, ends = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = WORD_BYTE[raw]
    before = np.concatenate(([False], inside[:-1]))
    borders = ends[:-1][np.diff(ends) > 0]
    before[borders] = False
    after = np.concatenate((inside[1:], [False]))
    after[borders[borders > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # a word's hash is the sum of byte times ODD ** place, brought back to place 0
    powers = np.empty(len(raw), np.uint64)
    powers[0] = 1
    powers[1:] = ODD
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    inverse = np.empty(len(raw), np.uint64)
    inverse[0] = 1
    inverse[1:] = BACK
    np.multiply.accumulate(inverse, out=inverse)
    found = (sums[stops] - sums[starts]) * inverse[starts]
    row = np.searchsorted(ends, starts, "right") - 1
    return row, mix(found ^ (stops - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of size words, end to end in ascending order by row, and row borders.
    A row of fewer words, but at least one, has one run of all its words; a row without words has none."""
    n = len(column)
    row, hashed = words(column)
    counts = np.bincount(row, minlength=n)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    runs = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), runs)
    place = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    total = np.zeros(len(owner), np.uint64)
    for k in range(size):
        at = place + k
        there = at < first[owner + 1]
        part = hashed[np.minimum(at, len(hashed) - 1)]
        total = total * ODD + np.where(there, part, np.uint64(k + 1))
    total = mix(total)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    owner, total = owner[new], total[new]
    return total, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def min_hashes(hashes: np.ndarray, borders: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """A row of count 32-bit minima for each set; zeros for an empty set."""
    n = len(borders) - 1
    out = np.zeros((n, count), np.uint32)
    full = np.flatnonzero(np.diff(borders) > 0)
    if not len(full):
        return out
    draw = np.random.default_rng(seed)
    scale = draw.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, count, np.uint64)
    starts = borders[:-1][full]
    for j in range(count):
        out[full, j] = np.minimum.reduceat((hashes * scale[j] + shift[j]) >> np.uint64(32), starts)
    return out


def set_keys(hashes: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """16 bytes that name each set."""
    import hashlib

    raw = hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(borders[:-1], borders[1:], strict=True)]
