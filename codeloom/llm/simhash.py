"""SimHash signatures, counted with byte lanes."""

from __future__ import annotations

import numpy as np

from . import common

_LANES = np.uint64(0x0101010101010101)


def signatures(hashes: np.ndarray, bounds: np.ndarray, words: int = 1) -> np.ndarray:
    """One signature of ``64 * words`` bits for each slice of feature hashes; shape (slices, words).

    A bit is set if more than half of the features have it set in their (mixed) hash. Features are added
    255 at a time as byte lanes of 64-bit integers, eight lanes a step. An empty slice has signature 0.
    """
    n = len(bounds) - 1
    out = np.zeros((n, words), np.uint64)
    if not len(hashes):
        return out
    lens = np.diff(bounds)
    full = np.flatnonzero(lens)
    chunks = -(-lens[full] // 255)
    first = np.cumsum(chunks) - chunks
    cuts = common.ragged(np.zeros(len(full), np.int64), chunks) * 255 + np.repeat(bounds[:-1][full], chunks)
    shifts = np.arange(8, dtype=np.uint64)
    for k in range(words):
        h = hashes if words == 1 else common.mix(hashes, k + 1)
        counts = np.empty((len(full), 64), np.int64)
        for s in shifts:
            lanes = np.add.reduceat((h >> s) & _LANES, cuts)
            bytes8 = lanes.view(np.uint8).reshape(-1, 8)
            counts[:, int(s) :: 8] = np.add.reduceat(bytes8.astype(np.int64), first, axis=0)
        bits = counts * 2 > lens[full][:, None]
        out[full, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)
