"""Token counts by a linear longest-match automaton.

A text's words are its runs between ASCII white space, each put behind one space, and a word's
pieces are found greedily: the longest vocabulary entry that starts where the last piece ended. The
vocabulary is a byte trie. Each node has a failure link (the node reached once the longest piece on
its path is popped, and further ones until the rest is a path of the trie again) and the number of
pieces so popped. Reading a byte either follows the trie or pops along failure links, so a word costs
time linear in its length and no piece is built. The distinct words of a slice of texts advance
together, byte by byte.

Bytes that no entry covers: each counts as one piece of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, shared, vocab

#: So few words are read byte by byte.
FEW = 32


class Automaton:
    """Counts the greedy longest-match pieces of many words at once."""

    def __init__(self, tokens: tuple[bytes, ...]) -> None:
        known = {t for t in tokens if t}
        known |= {bytes([b]) for b in range(256)}
        goto: list[dict[int, int]] = [{}]
        final, depth, paths = [False], [0], [b""]
        for token in sorted(known):
            at = 0
            for b in token:
                if b not in goto[at]:
                    goto[at][b] = len(goto)
                    goto.append({})
                    final.append(False)
                    depth.append(depth[at] + 1)
                    paths.append(paths[at] + bytes([b]))
                at = goto[at][b]
            final[at] = True
        n = len(goto)
        fail, popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        # Level by level, as in the construction of Aho and Corasick: a node that is an entry pops
        # itself; another takes its parent's pops and goes on along failure links until its last
        # byte can be read.
        level = [0]
        while level:
            below = []
            for parent in level:
                for b, node in goto[parent].items():
                    below.append(node)
                    if final[node]:
                        fail[node], popped[node] = 0, 1
                        continue
                    at, count = int(fail[parent]), int(popped[parent])
                    while at >= 0 and b not in goto[at]:
                        count += int(popped[at])
                        at = int(fail[at])
                    if at >= 0:
                        fail[node], popped[node] = goto[at][b], count
            level = below
        parents = np.array([p for p in range(n) for _ in goto[p]], np.int64)
        byte = np.array([b for p in range(n) for b in goto[p]], np.int64)
        child = np.array([c for p in range(n) for c in goto[p].values()], np.int32)
        self.step, self.fail, self.popped = vocab.Pairs(parents, byte, child), fail, popped
        self.goto, self.scalars = goto, list(zip(fail.tolist(), popped.tolist(), strict=True))

    def _rest(self, at: int, raw: bytes) -> tuple[int, int]:
        """(state, pieces popped) after reading raw from a state on."""
        goto, scalars, count = self.goto, self.scalars, 0
        for b in raw:
            while (to := goto[at].get(b)) is None:
                at, popped = scalars[at]
                count += popped
            at = to
        return at, count

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Pieces of each word data[offsets[i]:offsets[i + 1]]."""
        lengths = offsets[1:] - offsets[:-1]
        order = np.argsort(-lengths, kind="stable")
        lengths, begin = lengths[order], offsets[:-1][order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -k, "left"))  # longest first: those with more than k bytes
            if live <= FEW:  # a step of arrays would cost more than the bytes one by one
                for w in range(live):
                    state[w], more = self._rest(int(state[w]), data[begin[w] + k : begin[w] + lengths[w]].tobytes())
                    count[w] += more
                break
            read = data[begin[:live] + k].astype(np.int64)
            to = self.step.get(state[:live], read)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                at = state[stuck]
                count[stuck] += self.popped[at]
                state[stuck] = self.fail[at]
                to[stuck] = self.step.get(state[stuck], read[stuck])
                stuck = stuck[to[stuck] < 0]
            state[:live] = to
        left = np.flatnonzero(state > 0)
        while len(left):  # the end of a word pops what is left
            count[left] += self.popped[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocab.ranks(path))


def count_slice(column: pa.StringArray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(words, pieces) of each text of a slice."""
    offsets, data = arrays.buffers(column)
    starts, ends = arrays.runs(~arrays.SPACE[data], offsets)
    if not len(starts):
        return np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    code, at, words = arrays.distinct(*arrays.cut(data, starts, ends))
    spaced = np.insert(words, at[:-1], 32)
    each = auto.counts(at + np.arange(len(at)), spaced)[code]
    row = arrays.row_of(starts, offsets)
    n = len(column)
    return np.bincount(row, minlength=n), np.bincount(row, weights=each, minlength=n).astype(np.int64)


def token_counts(text: Column, path: str = vocab.BYTE_BPE) -> Column:
    """struct(n_words, n_tokens) of a text column; a null text gives null, an empty one zeros."""

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def counted(texts: pa.Array) -> pa.Array:
        auto = automaton(path)
        texts = arrays.strings(texts)
        done = [count_slice(s, auto) for s in arrays.slices(texts)]
        null = texts.is_null()
        words, pieces = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        return pa.StructArray.from_arrays([pa.array(words), pa.array(pieces)], ["n_words", "n_tokens"], mask=null)

    return counted(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = vocab.BYTE_BPE) -> DataFrame:
    """(id, n_words, n_tokens) of every row of docs.

    One pass without a shuffle; only the id and the text are read. Null text: null counts. Empty or
    white text: zeros. Null ids and repeated rows are kept row by row. Other columns, whatever their
    names, don't matter. An empty table gives an empty result.
    """
    counted = docs.select(shared.named(id_col).alias(id_col), token_counts(shared.named(text_col), path).alias("counted"))
    return counted.select(id_col, "counted.n_words", "counted.n_tokens")


#: The same by recursion: each step takes from every distinct word the longest entry that starts it.
#: Bytes are written as two hexadecimal digits.
ORACLE = f"""WITH RECURSIVE vocab AS (
  SELECT hex(from_base64(split_part(line, ' ', 1))) AS piece
  FROM read_csv('{vocab.BYTE_BPE}', columns = {{'line': 'VARCHAR'}}, header = false, delim = '\t', quote = '', escape = '', auto_detect = false)),
widest AS (SELECT max(length(piece)) AS most FROM vocab),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS word FROM documents),
each AS (SELECT doc_id, word, count(*) AS times FROM words GROUP BY ALL),
forms AS (SELECT DISTINCT word FROM each),
seg AS (
  SELECT word, '20' || hex(encode(word)) AS rest, 0 AS pieces FROM forms
  UNION ALL
  SELECT word, substr(rest, any_value(best) + 1), pieces + 1 FROM (
    SELECT s.word, s.rest, s.pieces, max(k) AS best FROM (
      SELECT word, rest, pieces, unnest(generate_series(2, least(length(rest), (SELECT most FROM widest)), 2)) AS k
      FROM seg WHERE rest <> '') s JOIN vocab ON vocab.piece = substr(s.rest, 1, k)
    GROUP BY ALL) GROUP BY word, rest, pieces),
done AS (SELECT word, pieces FROM seg WHERE rest = ''),
sums AS (SELECT doc_id, sum(times)::BIGINT AS n_words, sum(times * pieces)::BIGINT AS n_tokens FROM each JOIN done USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n_words, 0) END AS n_words, CASE WHEN text IS NOT NULL THEN coalesce(n_tokens, 0) END AS n_tokens
FROM documents LEFT JOIN sums USING (doc_id)"""
