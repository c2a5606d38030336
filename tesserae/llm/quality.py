"""Quality rules: gradient-boosted trees over document statistics, flattened for vectorised scoring.

Trees are grown on histograms of the statistics under logistic loss. Chosen features carry a
monotonic constraint: a split that would turn against it is refused, and its children's values are
bounded by the middle of the split, so that the constraint holds for the whole model. The trees are
kept as flat arrays (feature, threshold, children, value); all documents of a batch descend a tree
together, one array step a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, labelled, shared

#: Frequent function words of the languages at hand.
STOPWORDS = (
    "the of and to in is that it for on with as was be by this are or an at from not "
    "der die und das den von mit ist des sich auf ein eine im zu nicht "
    "le la les de et des un une que qui dans en pour est par sur du au "
    "el los las y se del por con una su para es al lo como no"
).split()

#: The statistics, each with its constraint: +1 (more is never worse), -1 (more is never better), 0.
STATISTICS = {
    "log_chars": 0, "log_words": 0, "word_length": 0, "letters": 0, "digits": -1, "upper": -1, "symbols": -1, "bars": -1,
    "spaces": 0, "stop_words": 1, "repeated_words": 0, "repeated_lines": -1, "line_length": 0, "ends": 0, "symbol_words": -1, "upper_words": -1,
}

_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL[[ord(c) for c in ".,'"]] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?"]] = True


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(STOPWORDS).encode(), np.uint8)
    return np.unique(arrays.hash_spans(data, *arrays.runs(data != 32, np.array([0, len(data)]))))


_STOP = _stop_hashes()


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _repeats(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weight of each row's values that stood in the row before."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[again], weights=weight[order][again], minlength=n)


def statistics(column: pa.StringArray) -> np.ndarray:
    """A row of STATISTICS for each text; zeros for an empty one. Ratios are of bytes, words or lines."""
    n = len(column)
    offsets, data = arrays.buffers(column)
    size = (offsets[1:] - offsets[:-1]).astype(np.float64)
    chars = _sums((data & 0xC0) != 0x80, offsets)
    starts, ends = arrays.runs(~arrays.SPACE[data], offsets)
    row = arrays.row_of(starts, offsets)
    words = np.bincount(row, minlength=n).astype(np.float64)
    low_offsets, low = arrays.buffers(arrays.strings(pc.utf8_lower(column)))
    w_starts, w_ends = arrays.runs(arrays.WORD[low], low_offsets)
    w_row, w_hash = arrays.row_of(w_starts, low_offsets), arrays.hash_spans(low, w_starts, w_ends)
    w_count = np.bincount(w_row, minlength=n).astype(np.float64)
    stop = _STOP[np.minimum(np.searchsorted(_STOP, w_hash), len(_STOP) - 1)] == w_hash
    lines, line_ends = arrays.runs(data != 10, offsets)
    line_row, line_size = arrays.row_of(lines, offsets), (line_ends - lines).astype(np.float64)
    line_count = np.bincount(line_row, minlength=n).astype(np.float64)
    letters, symbol, upper = arrays.WORD[data] & ~_DIGIT[data], _SYMBOL[data], _UPPER[data]
    within = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    of_words = lambda mask: np.bincount(row, weights=(within(mask)[ends] - within(mask)[starts]) >= 2, minlength=n)
    at_least = lambda x: np.maximum(x, 1.0)
    by = {
        "log_chars": np.log1p(chars), "log_words": np.log1p(words), "word_length": chars / at_least(words),
        "letters": _sums(letters, offsets) / at_least(size), "digits": _sums(_DIGIT[data], offsets) / at_least(size),
        "upper": _sums(upper, offsets) / at_least(size), "symbols": _sums(symbol, offsets) / at_least(size),
        "bars": _sums(data == 124, offsets) / at_least(words), "spaces": _sums(arrays.SPACE[data], offsets) / at_least(size),
        "stop_words": np.bincount(w_row, weights=stop, minlength=n) / at_least(w_count),
        "repeated_words": _repeats(w_row, w_hash, np.ones(len(w_row)), n) / at_least(w_count),
        "repeated_lines": _repeats(line_row, arrays.hash_spans(data, lines, line_ends), line_size, n) / at_least(size),
        "line_length": np.log1p(size / at_least(line_count)), "ends": _sums(_END[data], offsets) / at_least(words),
        "symbol_words": of_words(symbol) / at_least(words), "upper_words": of_words(upper) / at_least(words),
    }
    return np.stack([by[k] for k in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Params:
    """Of the boosting."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    l2: float = 1.0
    least: float = 2.0  # least sum of second derivatives in a leaf
    most_labelled: int = labelled.MAX_LABELLED


@dataclass(frozen=True)
class Trees:
    """Flat nodes; a leaf is its own child. roots has the first node of each tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total


def _best_split(g: np.ndarray, h: np.ndarray, bounds: tuple[float, float], signs: np.ndarray, p: Params) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, left value, right value) over histograms (features x bins) of a node."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = g.sum(axis=1, keepdims=True) - gl, h.sum(axis=1, keepdims=True) - hl
    left, right = np.clip(-gl / (hl + p.l2), *bounds), np.clip(-gr / (hr + p.l2), *bounds)
    here = np.clip(-g[0].sum() / (h[0].sum() + p.l2), *bounds)
    fall = lambda G, H, v: -(G * v + 0.5 * (H + p.l2) * v * v)
    gain = fall(gl, hl, left) + fall(gr, hr, right) - fall(g[0].sum(), h[0].sum(), here)
    gain[(hl < p.least) | (hr < p.least) | (signs[:, None] * (right - left) < 0)] = -np.inf
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left[f, b]), float(right[f, b])


def fit(x: np.ndarray, y: np.ndarray, p: Params = Params(), signs: np.ndarray | None = None) -> Trees:
    """Boosted trees for labels 0 and 1. No rows, or one class only: a constant."""
    signs = np.array(list(STATISTICS.values())) if signs is None else signs
    mean = (y.sum() + 1) / (len(y) + 2)
    base = 0.0 if not len(y) else float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), base)
        for _ in range(p.trees):
            prob = 1 / (1 + np.exp(-total))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            roots.append(len(nodes))
            nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
            grown = [(roots[-1], np.arange(len(y)), (-np.inf, np.inf), 0)]
            while grown:
                k, rows, bounds, depth = grown.pop()
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + p.l2), *bounds))
                split = (-np.inf,)
                if depth < p.depth and len(rows) > 1:
                    hist = lambda w: np.stack([np.bincount(binned[rows, f], weights=w[rows], minlength=p.bins + 1) for f in range(x.shape[1])])  # noqa: B023, E731
                    split = _best_split(hist(g), hist(h), bounds, signs, p)
                if not split[0] > 1e-9 or split[2] >= len(cuts[split[1]]):
                    nodes[k][4] = p.rate * value
                    total[rows] += p.rate * value
                    continue
                _, f, b, low, high = split
                goes_left = binned[rows, f] <= b
                a, c = len(nodes), len(nodes) + 1
                nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, c, c, 0.0]]
                nodes[k] = [f, cuts[f][b], a, c, 0.0]
                middle = (low + high) / 2
                lows, highs = bounds, bounds
                if signs[f] > 0:
                    lows, highs = (bounds[0], middle), (middle, bounds[1])
                elif signs[f] < 0:
                    lows, highs = (middle, bounds[1]), (bounds[0], middle)
                grown += [(a, rows[goes_left], lows, depth + 1), (c, rows[~goes_left], highs, depth + 1)]
    n = np.array(nodes, np.float64).reshape(-1, 5)
    return Trees(base, np.array(roots, np.int64), n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64), n[:, 4], p.depth)


def _statistics_of(column: pa.Array) -> np.ndarray:
    parts = [statistics(s) for s in arrays.slices(arrays.strings(column))]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees fitted on the statistics of at most p.most_labelled labelled documents; those
    statistics (16 numbers a document) are computed where the texts are and collected."""

    @F.arrow_udf(T.ArrayType(T.DoubleType(), False))
    def measured(texts: pa.Array) -> pa.Array:
        x = _statistics_of(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()), type=pa.list_(pa.field("element", pa.float64(), False)))

    rows = labelled.sample(docs, labels, label_col, p.most_labelled, id_col, text_col).select("order", "id", "label", measured("text").alias("x")).toPandas()
    rows = rows.sort_values(["order", "id"], kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return fit(x, rows["label"].to_numpy(np.float64), p)


def quality(text: Column, trees: Trees) -> Column:
    """The probability that a text is of good quality; null for null."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-np.clip(trees.logits(_statistics_of(texts)), -35, 35)))
        return pa.array(p, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return scored(text)


def _has_content(text: Column) -> Column:
    return text.rlike(r"[^\t\n\x0B\f\r ]")


def kept(text: Column, trees: Trees, threshold: float = 0.5) -> Column:
    """Whether a text has any content and scores at least the threshold."""
    return F.coalesce((_has_content(text)) & (quality(text, trees) >= threshold), F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, quality, keep) of every row of docs, by trees fitted on labelled documents.

    Null or blank text isn't kept (null text has a null score). Null ids and repeated rows are rated
    row by row. Without labels every score is 0.5 and every text with content is kept. Other columns
    don't matter, whatever their names.
    """
    trees = train(docs, labels, p, id_col, text_col, label_col)
    content = _has_content(shared.named(text_col))
    rated = docs.select(shared.named(id_col).alias(id_col), content.alias("content"), quality(shared.named(text_col), trees).alias("quality"))
    return rated.select(id_col, "quality", F.coalesce(F.col("content") & (F.col("quality") >= threshold), F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that rate() keeps. No join: the rule is applied to the text."""
    return docs.filter(kept(shared.named(text_col), train(docs, labels, p, id_col, text_col, label_col), threshold))
