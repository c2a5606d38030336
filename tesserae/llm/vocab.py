"""Public vocabularies. Their path is a parameter; files are read where they are used."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Rank file of the byte-level vocabulary that the queries use.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file, by id."""
    out: dict[int, bytes] = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            out[int(rank)] = base64.b64decode(token)
    return tuple(out[i] for i in range(len(out)))


class Pairs:
    """A hash table from two small integers to one, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            first = np.unique(slot[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out
