"""A fixed map from 64-bit keys to small numbers, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Open addressing with linear probes; absent keys give -1. Keys are non-negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys on one slot the last one stays
            settled = self.keys[slot] == keys
            self.values[slot[settled]] = values[settled]
            keys, values, slot = keys[~settled], values[~settled], (slot[~settled] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out
