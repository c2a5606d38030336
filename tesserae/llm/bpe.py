"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

A text is cut into pre-tokens by the public pattern of the vocabulary (contractions, letters, numbers
and others each with at most one leading space, white space). Within a pre-token, the leaves of a
segment tree hold the rank of each adjacent pair, made unique by its place; the root is then the
leftmost pair of lowest rank. A merge changes three leaves (the pair itself and its two neighbours),
each a point update along one path, until the root says that no pair can be merged. A pre-token of n
bytes so takes O(n log n), however long it is.

The trees of all distinct pre-tokens of a slice with about the same length stand side by side in one
array and take their merges in step, so that the work is numpy's throughout. A very long pre-token has a
tree of its own, in which the leftmost merges of the root's rank are found by one descent and made
together as long as none of them brings a pair that would come before the next.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, shared, vocab

_NONE = np.int64(1) << np.int64(62)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Pre-tokens of more bytes have a tree of their own.
LONG = 2048


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def pretoken_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where each pre-token begins, as byte positions; together they tile data."""
    if not len(data):
        return np.zeros(0, np.int64)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(chars)
    kind = _classes()[chars]
    row = np.zeros(n + 1, bool)  # a text begins here; the end counts as one
    row[np.searchsorted(at, offsets)] = True
    run = row[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = chars == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~row[1:-1]
    space = kind == _SPACE
    start = run & (space | ~after_blank)
    # White space before anything else gives up its last character: a blank goes to what follows,
    # another kind stands alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row[1:-1]
    start |= last
    # An apostrophe that begins a pre-token takes the ending of a contraction with it.
    quote = np.flatnonzero((chars == 39) & run & ~after_blank)
    if len(quote):
        pad = np.concatenate([chars, [0, 0]]).astype(np.int64)
        fence = np.concatenate([row, [True, True]])
        one, two = pad[quote + 1], pad[quote + 2]
        inside, further = ~fence[quote + 1], ~fence[quote + 1] & ~fence[quote + 2]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = further & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 1), (long, 2)):
            q = quote[hit]
            start[q + 1] = False
            rest = q + 1 + size
            rest = rest[rest < n]
            # what is left of the letters begins anew; a blank or another kind does so anyway
            start[rest[kind[rest] == _LETTER]] = True
    return at[start]


class Encoder:
    """Encodes many byte strings at once."""

    def __init__(self, tokens: tuple[bytes, ...]) -> None:
        ids = {t: i for i, t in enumerate(tokens)}
        found = [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        left, right, value = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.pairs = vocab.Pairs(left, right, value)
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.bounds = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.bounds[1:])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(left, right).astype(np.int64)
        return np.where(rank < 0, _NONE, rank << 32 | place)

    def _together(self, begin: np.ndarray, size: np.ndarray, data: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each, their ids) for words of at most `leaves` bytes."""
        n = len(begin)
        place = np.arange(leaves)[:, None]
        alive = place < size
        token = np.zeros((leaves + 1, n), np.int64)
        token[:leaves] = self.single[data[np.minimum(begin + place, len(data) - 1)]]
        after = np.broadcast_to(np.arange(1, leaves + 2)[:, None], (leaves + 1, n)).copy()
        before = after - 2
        tree = np.full((2 * leaves, n), _NONE, np.int64)
        where, word = np.nonzero(place[:-1] + 1 < size)
        tree[leaves + where, word] = self._keys(token[where, word], token[where + 1, word], where)
        half = leaves
        while half > 1:
            np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2], out=tree[half // 2 : half])
            half //= 2
        w = np.flatnonzero(tree[1] < _NONE)
        while len(w):
            root = tree[1, w]
            at, merged = root & 0xFFFFFFFF, root >> 32
            gone = after[at, w]
            then, prior = after[gone, w], before[at, w]
            token[at, w] = merged
            alive[gone, w] = False
            after[at, w] = then
            inside = then < size[w]
            before[np.minimum(then, leaves), w] = at
            tree[leaves + gone, w] = _NONE
            tree[leaves + at, w] = np.where(inside, self._keys(merged, token[np.minimum(then, leaves), w], at), _NONE)
            has = prior >= 0
            v, p = w[has], prior[has]
            tree[leaves + p, v] = self._keys(token[p, v], merged[has], p)
            paths = [(leaves + gone, w), (leaves + at, w), (leaves + p, v)]
            for _ in range(leaves.bit_length() - 1):
                up = [(node >> 1, col) for node, col in paths]
                for node, col in up:
                    tree[node, col] = np.minimum(tree[2 * node, col], tree[2 * node + 1, col])
                paths = up
            w = w[tree[1, w] < _NONE]
        return alive.sum(axis=0), token[:leaves].T[alive.T]

    def _alone(self, data: np.ndarray) -> np.ndarray:
        """The ids of one long word."""
        n = len(data)
        leaves = 1 << (n - 1).bit_length()
        token = np.append(self.single[data], 0)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        tree = np.full(2 * leaves, _NONE, np.int64)
        tree[leaves : leaves + n - 1] = self._keys(token[: n - 1], token[1:n], np.arange(n - 1))
        half = leaves
        while half > 1:
            np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2], out=tree[half // 2 : half])
            half //= 2
        while tree[1] < _NONE:
            rank = tree[1] >> 32
            nodes = np.ones(1, np.int64)
            while nodes[0] < leaves:
                nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
                nodes = nodes[tree[nodes] >> 32 == rank]
            at = nodes - leaves
            # of overlapping pairs (a run of one token) every other one, from the left
            run = np.flatnonzero(np.concatenate([[True], at[1:] != after[at[:-1]]]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            then, prior = after[gone], before[at]
            joined = np.concatenate([[False], prior[1:] == gone[:-1]])
            right = np.where(then < n, self.pairs.get(np.full(len(at), rank), token[np.minimum(then, n)]), -1)
            left = np.where(prior >= 0, self.pairs.get(np.where(joined, rank, token[prior]), np.full(len(at), rank)), -1)
            first = ((right >= 0) & (right <= rank)) | ((left >= 0) & (left <= rank))  # a pair that comes before the next merge
            if first.any():
                most = int(np.argmax(first)) + 1
                at, gone, then = at[:most], gone[:most], then[:most]
            token[at], alive[gone] = rank, False
            after[at] = then
            before[np.minimum(then, n)] = at
            where = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            follows = after[where]
            tree[leaves + gone] = _NONE
            tree[leaves + where] = np.where(follows < n, self._keys(token[where], token[np.minimum(follows, n)], where), _NONE)
            nodes = np.unique(np.concatenate([gone, where]) + leaves >> 1)
            while nodes[0]:
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
                nodes = nodes >> 1
                nodes = nodes[np.concatenate([[True], nodes[1:] != nodes[:-1]])]
        return token[:n][alive]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids) of the strings data[offsets[i]:offsets[i + 1]]."""
        size, begin = offsets[1:] - offsets[:-1], offsets[:-1]
        group = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        count, parts = np.zeros(len(size), np.int64), []
        for g in np.unique(group[size > 0]):
            leaves = 1 << int(g)
            members = np.flatnonzero((group == g) & (size > 0))
            if leaves > LONG:
                for m in members:
                    ids = self._alone(data[begin[m] : begin[m] + size[m]])
                    count[m] = len(ids)
                    parts.append((np.array([m]), ids))
                continue
            most = max(1, (1 << 19) // (2 * leaves))
            for k in range(0, len(members), most):
                m = members[k : k + most]
                count[m], ids = self._together(begin[m], size[m], data, leaves)
                parts.append((m, ids))
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        out = np.empty(bounds[-1], np.int32)
        for m, ids in parts:
            to = np.zeros(len(m) + 1, np.int64)
            np.cumsum(count[m], out=to[1:])
            out[np.arange(to[-1]) + np.repeat(bounds[m] - to[:-1], count[m])] = ids
        return bounds, out

    def encode_texts(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids) of whole texts: pre-tokens, the distinct ones encoded, put together again."""
        offsets, data = arrays.buffers(column)
        starts = pretoken_starts(offsets, data)
        code, at, words = arrays.distinct(np.append(starts, len(data)), data)
        bounds, ids = self.encode(at, words)
        flat, to = arrays.gather_ragged(ids, bounds, code)
        return to[np.searchsorted(starts, offsets)], flat

    def gives_back(self, ids: np.ndarray, bounds: np.ndarray, column: pa.StringArray) -> np.ndarray:
        """Whether ids[bounds[i]:bounds[i + 1]] decode to the bytes of the column's text i."""
        offsets, data = arrays.buffers(column)
        flat, to = arrays.gather_ragged(self.bytes, self.bounds, ids.astype(np.int64))
        ends = to[bounds]
        same = np.diff(ends) == np.diff(offsets)
        rows = np.flatnonzero(same)
        (back, at), (source, _) = arrays.gather_ragged(flat, ends, rows), arrays.gather_ragged(data, offsets, rows)
        wrong = np.concatenate([[0], np.cumsum(back != source)])
        same[rows] = wrong[at[1:]] == wrong[at[:-1]]
        return same

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str | None]:
        """The text of ids[bounds[i]:bounds[i + 1]]; None where an id isn't in the vocabulary."""
        known = (ids >= 0) & (ids < len(self.bounds) - 1)
        flat, to = arrays.gather_ragged(self.bytes, self.bounds, np.where(known, ids, 0).astype(np.int64))
        raw, cuts = flat.tobytes(), to[bounds]
        bad = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(~known, out=bad[1:])
        bad = bad[bounds[1:]] - bad[bounds[:-1]]
        return [None if b else raw[s:e].decode("utf-8", "replace") for s, e, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), bad.tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocab.ranks(path))


def encode(text: Column, path: str = vocab.BYTE_BPE) -> Column:
    """struct(token_ids, round_trip): the ids of a text, and whether their bytes are the text's, told slice by slice, so
    that no decoded copy of a batch is held or leaves the worker. Nulls for null, an empty array and true for an empty text."""
    kind = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("round_trip", T.BooleanType())])

    @F.arrow_udf(kind)
    def encoded(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        texts = arrays.strings(texts)
        bounds, ids, same, base = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)], 0
        for s in arrays.slices(texts):
            b, i = enc.encode_texts(s)
            same.append(enc.gives_back(i, b, s))
            bounds.append(b[1:] + base)
            ids.append(i)
            base += len(i)
        mask = texts.is_null() if texts.null_count else None
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(ids)), type=pa.list_(pa.field("element", pa.int32(), False)), mask=mask)
        return pa.StructArray.from_arrays([lists, pa.array(np.concatenate(same), mask=None if mask is None else mask.to_numpy(zero_copy_only=False))], kind.names)

    return encoded(text)


def decode(ids: Column, path: str = vocab.BYTE_BPE) -> Column:
    """The text of an array of ids: null for null or for an id out of the vocabulary; bytes that
    aren't UTF-8 become U+FFFD."""

    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        enc = encoder(path)
        out: list[str | None] = []
        for k in range(0, len(lists), 256):
            part = lists.slice(k, 256)
            flat = part.flatten()
            size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.zeros(len(part) + 1, np.int64)
            np.cumsum(size, out=bounds[1:])
            texts = enc.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            out += [t if v else None for t, v in zip(texts, part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = vocab.BYTE_BPE) -> DataFrame:
    """(id, token_ids, n_tokens, round_trip): each text encoded, decoded again and compared.

    One pass without a shuffle that reads the id and the text only. Null text: nulls. Empty text: no
    ids, round_trip true. Texts of any length are encoded whole. Null ids and repeated rows are kept
    row by row; other columns don't matter, whatever their names.
    """
    ids = docs.select(shared.named(id_col).alias("id"), encode(shared.named(text_col), path).alias("e")).select("id", "e.*")
    n_tokens = F.when(F.col("token_ids").isNotNull(), F.size("token_ids"))
    return ids.select(F.col("id").alias(id_col), "token_ids", n_tokens.alias("n_tokens"), "round_trip")
