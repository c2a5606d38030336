"""SimHash near-dedup by vantage-point trees.

A text's fingerprint has 128 bits: of the hashes of its distinct lower-case words, the majority at
each bit. Two documents are near copies if their fingerprints differ in at most `radius` bits and
their lengths in words by at most a quarter. All pairs within the radius are found exactly:

* Equal fingerprints of equal length are one point from here on.
* Points are divided by length into bands as wide as the allowed difference, so that a partner lies in
  the same band or the next, and a band of more points than a shard should hold by a vantage-point tree over
  Hamming distance. Its vantage points come from a sample; what is found doesn't depend on it. A point
  lives in one leaf and is sent as a query to every later leaf that its radius overlaps by the triangle
  bounds, and to the overlapping leaves of the next band. A shard's queries are counted, and dealt to several
  tasks when they are many, each with a copy of the shard's points, so a task's memory is bounded.
* Over 128 bits, points that are far apart are all about equally far apart, so that a radius of 24 prunes few
  leaves: a large band's shards meet nearly all. Within a task, points are therefore looked up by pieces of
  16 bits. Fingerprints that differ in at most 24 bits differ in at most 3 of the first piece or in at most 2 of
  another (otherwise in 4 + 7 * 3 = 25 at least), so each query visits the points with such a piece, about
  one in 40, and no pair is lost. The work still grows with the square of a band, with that small factor.

A task can return pairs, or a forest with the same connections and fewer edges than points, so groups of
thousands of copies don't become millions of rows. Rows that come with scopes can be searched within
those only (`near_in_scopes`, by `anchors` for instance); that leaves out pairs, and no query does it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, components, shared

RADIUS = 24
#: Lengths may differ by this factor; bands are a little wider, for rounding.
LENGTHS = (5, 4)
BAND = math.log(LENGTHS[0] / LENGTHS[1]) * 1.0001
#: Points of a shard, and queries that one task holds beside them.
SHARD_POINTS, TASK_QUERIES = 100_000, 200_000
#: Points sampled for each shard, to choose vantage points.
SAMPLED = 64
#: Points of a leaf within a task; pairs looked at together; found pairs that are united together.
LEAF, TOGETHER, FOUND = 512, 1 << 17, 1_000_000
#: Anchors of a text: of texts that share the part J of their runs of three words, all but about (1 - J)^ANCHORS share one; rows of scopes that a task searches; scopes of so few points are searched side by side.
ANCHORS, TASK_ROWS, FEW = 12, 200_000, 48

#: A byte's bits as eight counters of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _words(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every lower-case word."""
    offsets, data = arrays.buffers(arrays.strings(pc.utf8_lower(column)))
    starts, ends = arrays.runs(arrays.WORD[data], offsets)
    return arrays.row_of(starts, offsets), arrays.hash_spans(data, starts, ends)


def anchors(row: np.ndarray, word: np.ndarray, n: int, most: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by row, anchors) of the words of n rows."""
    with np.errstate(over="ignore"):
        three = arrays.mix(word[:-2] * np.uint64(0x51ED270B9F652295) + word[1:-1] * np.uint64(0xA24BAED4963EE407) + word[2:]) if len(word) > 2 else word[:0]
    whole = row[: len(three)] == row[2:]
    few = np.bincount(row, minlength=n)[row] < 3
    r, h = np.concatenate([row[: len(three)][whole], row[few]]), np.concatenate([three[whole], word[few]])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h = r[first], h[first]
    begin = np.searchsorted(r, np.arange(n))
    least = np.arange(len(r)) - begin[r] < most
    return np.searchsorted(r[least], np.arange(n + 1)), h[least]


def fingerprints(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, words) of each text; words is 0 where there are none."""
    return _majorities(*_words(column), len(column))


def _majorities(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.bincount(row, minlength=n)
    out = np.zeros((n, 2), np.uint64)
    if len(row):
        order = np.lexsort((word, row))
        row, word = row[order], word[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
        row, word = row[first], word[first]
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(begins, len(row)))
        # counters of a byte hold 255 words: longer rows are added up in parts
        within = np.arange(len(row)) - np.repeat(begins, size)
        parts = np.flatnonzero(within % 255 == 0)
        both = np.stack([word, arrays.mix(word ^ np.uint64(0x6A09E667F3BCC909))], axis=1)
        counts = np.add.reduceat(_SPREAD[both.view(np.uint8)], parts, axis=0)
        counts = counts.view(np.uint8).reshape(len(parts), 128).astype(np.int32)
        counts = np.add.reduceat(counts, np.searchsorted(parts, begins), axis=0)
        out[row[begins]] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.uint64)
    return out[:, 0], out[:, 1], words


def fingerprint(text: Column, anchored: bool = True) -> Column:
    """struct(high, low, words, and if anchored anchors); null where a text is null or has no words."""
    number = T.LongType()
    kind = T.StructType([T.StructField("high", number), T.StructField("low", number), T.StructField("words", T.IntegerType())])
    if anchored:
        kind = kind.add("anchors", T.ArrayType(number, False))

    @F.arrow_udf(kind)
    def hashed(texts: pa.Array) -> pa.Array:
        done, lists, size = [], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for s in arrays.slices(arrays.strings(texts)):
            row, word = _words(s)
            done.append(_majorities(row, word, len(s)))
            if anchored:
                bounds, found = anchors(row, word, len(s))
                lists.append(found)
                size.append(np.diff(bounds))
        high, low, words = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.uint64) for k in range(3))
        columns = [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(words.astype(np.int32))]
        if not anchored:
            return pa.StructArray.from_arrays(columns, kind.names, mask=pa.array(words == 0))
        bounds = np.cumsum(np.concatenate(size)).astype(np.int32)
        each = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(lists).view(np.int64)), type=pa.list_(pa.field("element", pa.int64(), False)))
        return pa.StructArray.from_arrays([*columns, each], kind.names, mask=pa.array(words == 0))

    return hashed(text)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of fingerprints (last axis: high, low)."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


@dataclass
class Node:
    """Inner: a vantage point, its children (within, beyond) and their least and largest distances."""

    vantage: np.ndarray | None = None
    bounds: tuple[tuple[int, int], tuple[int, int]] = ((0, 128), (0, 128))
    children: tuple[Node, Node] | None = None
    leaf: int = -1
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def grow(points: np.ndarray, rows: np.ndarray, most: int, tight: bool) -> Node:
    """A vantage-point tree with leaves of at most `most` rows. tight: bounds as these rows have
    them; otherwise as any point beside them may (for rows that are only a sample)."""
    if len(rows) <= most:
        return Node(rows=rows)
    # of a few candidates, the vantage point whose distances spread most
    few = rows[:: max(1, len(rows) // 8)][:8]
    some = points[rows[:: max(1, len(rows) // 256)]]
    vantage = points[few[int(np.argmax([hamming(points[c], some).astype(float).std() for c in few]))]]
    d = hamming(points[rows], vantage)
    middle = int(np.median(d))
    inside = d <= middle
    if inside.all():
        middle = int(d.max()) - 1
        inside = d <= middle
    if not inside.any():
        return Node(rows=rows)  # all the same distance from each other
    if tight:
        bounds = ((int(d[inside].min()), int(d[inside].max())), (int(d[~inside].min()), int(d[~inside].max())))
    else:
        bounds = ((0, middle), (middle + 1, 128))
    return Node(vantage, bounds, (grow(points, rows[inside], most, tight), grow(points, rows[~inside], most, tight)))


def leaves(tree: Node) -> list[Node]:
    return [tree] if tree.children is None else leaves(tree.children[0]) + leaves(tree.children[1])


def descend(tree: Node, points: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, the rows of points whose radius may reach into it)."""
    if not len(rows):
        return
    if tree.children is None:
        yield tree, rows
        return
    d = hamming(points[rows], tree.vantage).astype(np.int64)
    for (low, high), child in zip(tree.bounds, tree.children, strict=True):
        yield from descend(child, points, rows[(d - radius <= high) & (d + radius >= low)], radius)


@lru_cache(maxsize=2)
def pieces(radius: int) -> list[tuple[int, np.ndarray]]:
    """(most, the 16-bit values of at most so many bits) of the eight pieces of a fingerprint: the numbers most + 1
    add up to radius + 1, so that of two fingerprints within the radius one piece at least differs in `most` bits or fewer."""
    bits = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)).astype(int)
    each, more = divmod(radius + 1, 8)
    return [(most, np.flatnonzero(bits <= most).astype(np.int32)) for most in (each - (k >= more) for k in range(8))]


def _by_pieces(points: np.ndarray, queries: np.ndarray, radius: int, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, point) within the radius, each pair once, and if itself with query < point."""
    lanes, asked = (np.ascontiguousarray(x).view(np.uint16).reshape(len(x), 8) for x in (points, queries))
    asked_high = np.ascontiguousarray(queries[:, 0])
    mosts = np.array([most for most, _ in pieces(radius)])
    for k, (_, masks) in enumerate(pieces(radius)):
        if not len(masks):
            continue
        order = np.argsort(lanes[:, k], kind="stable")
        high = points[order, 0]
        begin = np.searchsorted(lanes[order, k], np.arange((1 << 16) + 1))
        count = np.diff(begin)
        there = count > 0
        step = max(1, TOGETHER // len(masks))
        for s in range(0, len(queries), step):
            own = asked[s : s + step, k].astype(np.int32)[:, None]
            value = own ^ masks
            asks = there[value]
            if itself:  # of two values, the lesser asks
                asks &= value >= own
            asks = np.flatnonzero(asks)
            value, who = value.ravel()[asks], s + asks // len(masks)
            upto, at = np.cumsum(count[value]), 0
            while at < len(value):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, "right")))
                v, before = value[at:to], upto[at - 1] if at else 0
                a = np.repeat(who[at:to], count[v])
                b = np.arange(len(a)) + np.repeat(begin[v] - (upto[at:to] - count[v] - before), count[v])
                at = to
                close = np.flatnonzero(np.bitwise_count(asked_high[a] ^ high[b]) <= radius)
                a, b = a[close], order[b[close]]
                close = hamming(queries[a], points[b]) <= radius
                a, b = a[close], b[close]
                earlier = (np.bitwise_count(asked[a, :k] ^ lanes[b, :k]) <= mosts[:k]).any(axis=1)
                if itself:
                    earlier |= (asked[a, k] == lanes[b, k]) & (a >= b)  # equal values ask each other
                    a, b = np.minimum(a, b), np.maximum(a, b)
                if not earlier.all():
                    yield a[~earlier], b[~earlier]


def _by_tree(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, point) within the radius, each pair once."""
    tree = grow(points, np.arange(len(points)), LEAF, tight=True)
    for leaf, found in descend(tree, queries, np.arange(len(queries)), radius):
        here = points[leaf.rows]
        for k in range(0, len(found), 512):
            q = found[k : k + 512]
            near = np.bitwise_count(queries[q, 0][:, None] ^ here[:, 0][None, :]) <= radius
            a, b = np.nonzero(near)
            a, b = q[a], leaf.rows[b]
            near = hamming(queries[a], points[b]) <= radius
            yield a[near], b[near]


def search(points: np.ndarray, words: np.ndarray, queries: np.ndarray, query_words: np.ndarray, radius: int, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, point) within the radius and the allowed lengths. itself: the queries are
    the points, and each pair comes once. Few points are searched by a tree, more by pieces."""
    if not len(points) or not len(queries):
        return
    by_tree = len(points) < 2 * sum(len(masks) for _, masks in pieces(radius))
    for a, b in _by_tree(points, queries, radius) if by_tree else _by_pieces(points, queries, radius, itself):
        short, long = np.minimum(query_words[a], words[b]).astype(np.int64), np.maximum(query_words[a], words[b]).astype(np.int64)
        ok = LENGTHS[1] * long <= LENGTHS[0] * short
        if itself:
            ok &= a < b
        if ok.any():
            yield a[ok], b[ok]


def band_of(words: Column) -> Column:
    return F.floor(F.log(words.cast("double")) / BAND).cast("int")


@dataclass(frozen=True)
class Shards:
    """Trees by band, and over how many tasks the queries of each shard go (one, if it isn't named)."""

    trees: dict[int, Node]
    tasks: dict[int, int]


def _banded(points: DataFrame) -> DataFrame:
    """(band, rep, high, low, words); bands of different scopes (numbers from 0, if there are any) are apart."""
    scope = F.col("scope") if "scope" in points.columns else F.lit(0)
    return points.select((scope.cast("long") * 1000 + band_of(F.col("words"))).alias("band"), "rep", "high", "low", "words")


def plan(points: DataFrame, radius: int, shard_points: int = SHARD_POINTS, task_queries: int = TASK_QUERIES) -> Shards:
    """Chooses shards from counts by band and a sample of points, and counts the queries of each: a few
    rows a shard reach the driver."""
    banded = _banded(points)
    counts = {r.band: r.n for r in banded.groupBy("band").agg(F.count("*").alias("n")).collect()}
    rate = min(1.0, SAMPLED / shard_points)
    wide = [b for b, n in counts.items() if n > shard_points]
    sampled: dict[int, list[tuple[int, int]]] = {}
    if wide:
        chosen = banded.filter(F.col("band").isin(wide))
        chosen = chosen.filter(F.pmod(F.xxhash64("high", "low", "words"), F.lit(1_000_000)) < int(rate * 1_000_000))
        for r in chosen.select("band", "high", "low").orderBy("band", "high", "low").collect():
            sampled.setdefault(r.band, []).append((r.high, r.low))
    trees, at = {}, 0
    for b in sorted(counts):
        rows = np.array(sampled.get(b, []), np.int64).reshape(-1, 2).view(np.uint64)
        trees[b] = grow(rows, np.arange(len(rows)), max(8, round(shard_points * rate)), tight=False) if len(rows) else Node()
        for leaf in leaves(trees[b]):
            leaf.leaf, at = at, at + 1
            leaf.rows = leaf.rows[:0]
    shards = Shards(trees, {})
    if sum(counts.values()) <= task_queries:
        return shards
    queries = route(points, shards, radius, homes=False).groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > task_queries)
    return Shards(trees, {r.shard: math.ceil(r.n / task_queries) for r in queries.collect()})


def route(points: DataFrame, shards: Shards, radius: int, homes: bool = True) -> DataFrame:
    """(shard, task, query, rep, high, low, words): points at home in every task of their shard, and
    as queries in one task of each shard they reach."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = batch.column(0).to_numpy()
            rep, high, low = (batch.column(k).to_numpy() for k in (1, 2, 3))
            words = batch.column(4).to_numpy()
            fp = np.stack([high, low], axis=1).view(np.uint64)
            to: list[tuple[np.ndarray, int, np.ndarray, bool]] = []
            for b in np.unique(band):
                rows = np.flatnonzero(band == b)
                home = np.full(len(band), -1)
                for leaf, found in descend(shards.trees[b], fp, rows, 0):
                    home[found] = leaf.leaf
                    if homes:
                        to += [(found, leaf.leaf, np.full(len(found), t), False) for t in range(shards.tasks.get(leaf.leaf, 1))]
                for near in (b, b + 1):
                    if near in shards.trees:
                        for leaf, found in descend(shards.trees[near], fp, rows, radius):
                            found = found[home[found] < leaf.leaf]
                            to.append((found, leaf.leaf, rep[found] % shards.tasks.get(leaf.leaf, 1), True))
            for rows, shard, task, query in to:
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), shard, np.int32)), pa.array(task.astype(np.int32)), pa.array(np.full(len(rows), query)), *(pa.array(x[rows]) for x in (rep, high, low, words))],
                        ["shard", "task", "query", "rep", "high", "low", "words"],
                    )

    return _banded(points).mapInArrow(routed, "shard int, task int, query boolean, rep long, high long, low long, words int")


def near(points: DataFrame, radius: int = RADIUS, forest: bool = True, shard_points: int = SHARD_POINTS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """(u, v) of points (rep, high, low, words, and scope where only points of one are compared) within the
    radius: every pair of a scope once (u < v), or a forest with the same connections."""

    def found(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query", "rep"])
        rep, words = rows["rep"].to_numpy(np.int64), rows["words"].to_numpy(np.int64)
        fp = rows[["high", "low"]].to_numpy(np.int64).view(np.uint64)
        n = int((~rows["query"].to_numpy(bool)).sum())
        union, pairs, held = components.Forest(len(rep)), [], []

        def keep(most: int) -> None:
            if held and sum(len(a) for a, _ in held) > most:
                a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                if forest:
                    union.add(a, b)
                else:
                    pairs.append((rep[a], rep[b]))

        ways = [(fp[n:], words[n:], n, False)] + ([(fp[:n], words[:n], 0, True)] if key[1] == 0 else [])
        for queries, lengths, base, itself in ways:
            for a, b in search(fp[:n], words[:n], queries, lengths, radius, itself):
                held.append((a + base, b))
                keep(FOUND)
        keep(0)
        if forest:
            out = np.flatnonzero(union.label != np.arange(len(rep)))
            pairs = [(rep[out], rep[union.label[out]])]
        u, v = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        arrays.release()
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    # a number of its own: shards are few bytes and much work, and would be put together in few tasks
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = route(points, plan(points, radius, shard_points, task_queries), radius).repartition(tasks, "shard", "task")
    return routed.groupBy("shard", "task").applyInPandas(found, "u long, v long")


def _side_by_side(fp: np.ndarray, words: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius and the allowed lengths in each of the groups of so many rows."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(fp)) - 1  # rows of the group that follow
    for k in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(left >= k)
        a = a[hamming(fp[a], fp[a + k]) <= radius]
        short, long = np.minimum(words[a], words[a + k]), np.maximum(words[a], words[a + k])
        a = a[LENGTHS[1] * long <= LENGTHS[0] * short]
        if len(a):
            yield a, a + k


def near_in_scopes(scoped: DataFrame, radius: int = RADIUS, forest: bool = True, shard_points: int = SHARD_POINTS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """(u, v) of the points of each scope of scoped (scope, rep, high, low, words) within the radius:
    every pair once (u < v), or a forest with the same connections. Each point comes once in a scope."""
    sizes = shared.cut(scoped.groupBy("scope").agg(F.count("*").alias("n")).filter("n > 1"))
    most = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= shard_points, F.col("n"))), F.lit(0)).alias("rows"), F.count_if(F.col("n") > shard_points).alias("large")).first()

    def found(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "scope", "rep"])
        scope, rep, words = (rows[c].to_numpy(np.int64) for c in ("scope", "rep", "words"))
        fp = rows[["high", "low"]].to_numpy(np.int64).view(np.uint64)
        names, at = np.unique(rep, return_inverse=True)
        begin = np.flatnonzero(np.concatenate([[True], scope[1:] != scope[:-1]]))
        size = np.diff(np.append(begin, len(scope)))
        few = int((size <= FEW).sum())  # these come first
        end = int(begin[few]) if few < len(begin) else len(scope)
        union, pairs, held = components.Forest(len(names)), [], []

        def keep(a: np.ndarray, b: np.ndarray, last: bool = False) -> None:
            held.append((at[a], at[b]))
            if last or sum(len(h[0]) for h in held) > 1_000_000:
                a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                if forest:
                    union.add(a, b)
                else:
                    pairs.append((names[np.minimum(a, b)], names[np.maximum(a, b)]))

        for a, b in _side_by_side(fp[:end], words[:end], size[:few], radius):
            keep(a, b)
        for s, e in zip(begin[few:], begin[few:] + size[few:], strict=True):
            for a, b in search(fp[s:e], words[s:e], fp[s:e], words[s:e], radius, True):
                keep(a + s, b + s)
        keep(np.zeros(0, np.int64), np.zeros(0, np.int64), True)
        if forest:
            child = np.flatnonzero(union.label != np.arange(len(names)))
            pairs = [(names[union.label[child]], names[child])]
        arrays.release()
        return pd.DataFrame({"u": np.concatenate([p[0] for p in pairs]), "v": np.concatenate([p[1] for p in pairs])})

    tasks = max(1, math.ceil(most.rows / TASK_ROWS))
    small = scoped.join(sizes.filter(F.col("n") <= shard_points), "scope").withColumn("task", F.pmod(F.xxhash64("scope"), F.lit(tasks)))
    out = small.groupBy("task").applyInPandas(found, "u long, v long")
    if most.large:  # of all rows, at most one in shard_points
        named = [(r.scope, k) for k, r in enumerate(sizes.filter(F.col("n") > shard_points).select("scope").orderBy("scope").collect())]
        numbers = scoped.sparkSession.createDataFrame(named, "scope long, number long")
        large = shared.cut(scoped.join(shared.small(numbers, len(named)), "scope").select(F.col("number").alias("scope"), "rep", "high", "low", "words"))
        out = out.unionByName(near(large, radius, forest, shard_points, task_queries))
    return out.distinct()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchored: bool = True) -> DataFrame:
    """(id, h, n, high, low, words, and if anchored anchors) of the documents that have an id and words, kept in
    the shared folder; h is a hash of the text and n its length, to tell apart texts of one id."""
    text = shared.named(text_col)
    rows = docs.select(shared.named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"), fingerprint(text, anchored).alias("f"))
    return shared.cut(rows.filter("id is not null and f is not null").select("id", "h", "n", "f.*"))


def duplicates_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, h, n, kept) of every document that is a near copy; kept is the struct (id, h, n) of the
    least of its group."""
    same = ["high", "low", "words"]
    points = prints.groupBy(*same).agg(F.min(F.struct("id", "h", "n")).alias("least"))
    points = shared.cut(points.withColumn("rep", F.monotonically_increasing_id()))
    roots = components.components(near(points, radius)).select(F.col("v").alias("rep"), "root")
    grouped = points.join(roots, "rep", "left").select(*same, "least", F.coalesce("root", "rep").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("least").alias("kept"))
    grouped = grouped.join(kept, "root").select(*same, "kept")
    return prints.join(grouped, same).filter(F.struct("id", "h", "n") != F.col("kept")).select("id", "h", "n", "kept")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept id) of every document that is a near copy of another; the group keeps its least id.

    Groups are the connected components of the near pairs. Documents with a null id, a null text or
    no words are in no group. Rows with the same id and text are one document; texts of one id are
    documents of their own, and the id is in the result, with the least kept id, if one of them is a near copy of
    a document of another id. A document without copies isn't in the result; no documents give no rows.
    Other columns don't matter, whatever their names.
    """
    found = duplicates_of(fingerprint_table(docs, id_col, text_col, anchored=False), radius).select("id", F.col("kept.id").alias("kept"))
    found = found.filter("id <> kept").groupBy("id").agg(F.min("kept").alias("kept"))
    return found.select(F.col("id").alias(id_col), F.col("kept").alias(f"kept_{id_col}"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group of near copies (the least id; of one id's texts the
    one with the least hash).

    Rows without an id, a text or words stay. Of rows with the same id and text one stays; rows that share an
    id but not the text are documents of their own, and none goes unless it is a near copy. What goes is broadcast
    up to a counted number; beyond it the join shuffles. Other columns may have any names.
    """
    prints = fingerprint_table(docs, id_col, text_col, anchored=False)
    key = ["id", "h", "n"]
    drop = shared.cut(duplicates_of(prints, radius).select(*key).distinct())
    again = shared.cut(prints.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").select(*key))
    text = shared.named(text_col)
    rows = docs.select(shared.row(docs).alias("row"), shared.named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    left = rows.join(shared.small(drop, drop.count()), key, "left_anti")
    times = again.count()
    if times:
        again = shared.small(again, times)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(*shared.fields(docs))
