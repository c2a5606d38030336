"""Edit distance of texts, by bits.

The built-in distance is quadratic in cells, which a pair of very long blocks makes minutes of. Here equal
beginnings and ends are left out, and a column of the rest is a few operations on numbers of as many bits
as the pattern has characters.
"""

from __future__ import annotations


def common(a: str, b: str) -> int:
    """Characters that a and b begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def bounded(a: str, b: str, most: int) -> int:
    """The edit distance of a and b; -1 if it is more than `most`."""
    k = common(a, b)
    a, b = a[k:], b[k:]
    k = common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return -1
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column rises and falls
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (full & ~(diagonal | up)), diagonal & up
        score += 1 if rises & last else -1 if falls & last else 0
        if score - left > most:
            return -1
        rises = (rises << 1 | 1) & full
        up, down = (falls << 1 & full) | (full & ~(diagonal | rises)), rises & diagonal
    return score if score <= most else -1


def places(pattern: str) -> dict[str, int]:
    """For each character of a pattern the bits of where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def beside(patterns: list[tuple[int, dict[str, int]]], text: str, bounds: list[int]) -> list[int]:
    """The edit distance of a text to each of several patterns (length, places()), or -1 for all if each is more
    than its bound. The patterns lie side by side in one number, with a free bit between them that ends a
    carry, so a character of the text is a few operations for all of them."""
    starts, full, at, offsets = 0, 0, 0, []
    for size, _ in patterns:
        offsets.append(at)
        full |= ((1 << size) - 1) << at
        starts |= (1 << at) if size else 0
        at += size + 1
    of = {}
    for c in set(text):
        bits = 0
        for offset, (_, where) in zip(offsets, patterns, strict=True):
            if c in where:
                bits |= where[c] << offset
        of[c] = bits
    up, down, done = full, 0, 0
    step = max(64, -(-len(text) // 8))

    def now() -> list[int]:
        cut = [((up >> o) & ((1 << n) - 1), (down >> o) & ((1 << n) - 1)) for o, (n, _) in zip(offsets, patterns, strict=True)]
        return [done + u.bit_count() - v.bit_count() for u, v in cut]

    while done < len(text):
        for c in text[done : done + step]:
            same = of[c]
            diagonal = ((((same & up) + up) ^ up) | same | down) & full
            rises, falls = down | (full & ~(diagonal | up)), diagonal & up
            rises = (rises << 1 & full) | starts
            up, down = (falls << 1 & full) | (full & ~(diagonal | rises)), rises & diagonal
        done = min(len(text), done + step)
        if done < len(text) and all(s - (len(text) - done) > b for s, b in zip(now(), bounds, strict=True)):
            return [-1] * len(patterns)
    return now()
