"""Refined matching of one pair's blocks: which template block each destination's one takes.

A block is a dict of index, normalized and total (the blocks of its side).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np

from tesserae.functions import distance

#: Weights of content, length and position, and the least score of a refined match.
WEIGHTS, THRESHOLD = (0.7, 0.15, 0.15), 0.7
#: Characters of template blocks that are compared with a destination's block at once.
TOGETHER = 4096


class Free:
    """A pair's template blocks (index, normalized, total) that aren't taken yet."""

    def __init__(self, blocks: list[dict]) -> None:
        self.texts = [b["normalized"] for b in blocks]
        self.index = np.array([b["index"] for b in blocks], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.at = np.array([_at(b) for b in blocks])
        self.free = np.ones(len(blocks), bool)
        self.places: dict[int, dict[str, int]] = {}

    def best(self, block: dict) -> tuple[float, int] | None:
        """(-score, index) of the free block that scores best with a destination's one, the first of equals, if any
        reaches the threshold.

        Length and position bound the score, so blocks that can't reach the threshold, or the best score so far,
        are left out. Those that begin or end like the destination's come first, as little of them is to be
        compared; the others are compared together.
        """
        text, best = block["normalized"], None
        longest = np.maximum(self.sizes, len(text))
        size = np.where(self.sizes == len(text), 1.0, np.minimum(self.sizes, len(text)) / np.maximum(longest, 1))
        position = 1.0 - np.abs(self.at - _at(block))
        most = (WEIGHTS[0] + WEIGHTS[1]) * size + WEIGHTS[2] * position
        some = np.flatnonzero(self.free & (most >= THRESHOLD - 1e-9))
        needed = np.maximum((THRESHOLD - WEIGHTS[1] * size[some] - WEIGHTS[2] * position[some]) / WEIGHTS[0], 0.0)
        bounds = np.ceil((1 - needed) * longest[some] + 1e-6).astype(np.int64)

        def take(k: int, distance: int) -> None:
            nonlocal best
            content = 1.0 if distance == 0 else 1.0 - distance / float(longest[k])
            score = float(WEIGHTS[0] * content + WEIGHTS[1] * size[k] + WEIGHTS[2] * position[k])
            if score >= THRESHOLD and (best is None or (-score, int(self.index[k])) < best):
                best = (-score, int(self.index[k]))

        later = []
        backwards = text[::-1]
        for k, bound in zip(some.tolist(), bounds.tolist(), strict=True):
            other = self.texts[k]
            alike = distance.common(other, text) if other[:1] == text[:1] else 0
            if other[-1:] == text[-1:]:
                alike += distance.common(other[::-1], backwards)
            if 2 * alike >= min(len(other), len(text)):
                if (found := distance.bounded(other, text, bound)) >= 0:
                    take(k, found)
            else:
                later.append((k, bound))
        rest = [(k, bound) for k, bound in later if best is None or most[k] >= -best[0] - 1e-9]
        while rest:
            bits, n = 0, 0
            while n < len(rest) and (n == 0 or bits + self.sizes[rest[n][0]] <= TOGETHER):
                bits += int(self.sizes[rest[n][0]])
                n += 1
            now, rest = rest[:n], rest[n:]
            for k, _ in now:
                if k not in self.places:
                    self.places[k] = distance.places(self.texts[k])
            found = distance.beside([(len(self.texts[k]), self.places[k]) for k, _ in now], text, [bound for _, bound in now])
            for (k, bound), one in zip(now, found, strict=True):
                if 0 <= one <= bound:
                    take(k, one)
        return best

    def take(self, index: int) -> None:
        self.free[self.index == index] = False


def _at(block: dict) -> float:
    return block["index"] / (block["total"] - 1) if block["total"] > 1 else 0.5


def ways(template: list[dict], destination: list[dict]) -> list[tuple[int, int, float]]:
    """(template index, destination index, score): in the destination's order each block takes the free template
    block that scores best, the first of equals."""
    out, free = [], Free(template)
    for index, same in groupby(sorted(destination, key=lambda b: b["index"]), key=lambda b: b["index"]):
        if best := min(filter(None, map(free.best, same)), default=None):
            free.take(best[1])
            out.append((best[1], index, -best[0]))
    return out
