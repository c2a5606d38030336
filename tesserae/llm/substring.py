"""Substring dedup by super-k-mer partitioning.

A window is `WINDOW` consecutive words (runs between ASCII white space, as they stand). Its minimiser
is the least hash among its grams of `GRAM` words, the leftmost of equals, so identical windows have
the same minimiser at the same place. Consecutive windows that share one make a super-k-mer, which
travels as one packed string (the stretch of text itself) to the bucket of its minimiser, where
windows are sorted by their words and counted exactly; hashes decide only where a string goes.

Before any text travels, the super-k-mers of each minimiser are counted as rows of a few numbers. One
alone with its minimiser can't hold a repeated window (two equal windows of one document lie in two
super-k-mers), so its text stays where it is. Of equal strings only the first of each `TOGETHER` bytes
travels, and in the bucket only the first of all is held: the windows of the others are repeated and none
is a first one, so that neither a task's memory nor its rows follow the most common passage. The windows
of a minimiser with very many super-k-mers (whose strings may all differ, as around a common sentence) go
one by one, each to a bucket of its own and as its 128-bit digest instead of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, shared

WINDOW, GRAM = 50, 12
#: The windows of a minimiser of more super-k-mers than this go one by one.
HOT = 50_000
#: Bytes of packed strings that a bucket's task counts together; whole minimisers only.
TOGETHER = 4_000_000

_BASE = np.uint64(0xD6E8FEB86659FD93)


def spans_of_words(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row of each word, first word of each row; the last is their number)."""
    offsets, data = arrays.buffers(column)
    starts, ends = arrays.runs(~arrays.SPACE[data], offsets)
    row = arrays.row_of(starts, offsets)
    return data, starts, ends, row, np.searchsorted(row, np.arange(len(column) + 1))


def super_kmers(column: pa.StringArray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, windows, minimiser) of each super-k-mer."""
    data, starts, ends, row, first = spans_of_words(column)
    n = len(starts)
    if n < k:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    word = arrays.hash_spans(data, starts, ends)
    gram = word[: n - m + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, m):
            gram *= _BASE
            gram += word[j : n - m + 1 + j]
    gram = arrays.mix(gram)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, have = k - m + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n - k + 1], least[width - have :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = row[: n - k + 1] == row[k - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    begin = np.flatnonzero(begins)
    number = np.bincount(np.cumsum(begins)[inside] - 1, minlength=len(begin))
    return row[begin], begin - first[row[begin]], number, gram[at[begin]]


def window_codes(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k word codes, equal for equal runs, by doubling: exact."""
    codes, have = pd.factorize(words)[0].astype(np.int64), 1
    n = len(words)
    while 2 * have <= k:
        codes = pd.factorize(codes[:-have] << 32 | codes[have:])[0].astype(np.int64)
        have *= 2
    if have < k:
        codes = pd.factorize(codes[: n - k + 1] << 32 | codes[k - have :])[0].astype(np.int64)
    return codes


_FOUND = ["id", "h", "start", "stop", "removed"]


def _stretch_rows(rows: pa.Table, which: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Later occurrences, whole."""
    ids, h, at = (rows.column(c).to_numpy()[which] for c in ("id", "h", "at"))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(at), pa.array(stop), pa.array(np.ones(len(ids), bool))], _FOUND)


def _first_of_equals(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (m, id, h, at, packed, many): (the first of each string, whether it is one of several,
    the others); a row that comes again as it is is neither."""
    code = rows.column("packed").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    m, ids, h, at = (rows.column(c).to_numpy() for c in ("m", "id", "h", "at"))
    many = rows.column("many").to_numpy(zero_copy_only=False)
    order = np.lexsort((at, h, ids, code, m))
    m, ids, h, at, code = (x[order] for x in (m, ids, h, at, code))
    new = np.ones(len(order), bool)
    new[1:] = (m[1:] != m[:-1]) | (code[1:] != code[:-1])
    other = np.zeros(len(order), bool)
    other[1:] = ~new[1:] & ((ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1]))
    begin = np.flatnonzero(new)
    several = np.logical_or.reduceat(many[order] | other, begin) if len(begin) else many[:0]
    return order[begin], several, order[other]


def _count_bucket(rows: pa.Table, k: int) -> pa.RecordBatch:
    """Repeated stretches of the distinct strings (m, id, h, at, packed, many) of whole minimisers."""
    ids, h, at, m = (rows.column(c).to_numpy() for c in ("id", "h", "at", "m"))
    rows = rows.take(np.lexsort((at, h, ids, m)))
    _, starts, ends, row, first = spans_of_words(packed := arrays.strings(rows.column("packed")))
    data = arrays.buffers(packed)[1]
    m, ids, h, at = (rows.column(c).to_numpy() for c in ("m", "id", "h", "at"))
    many = rows.column("many").to_numpy(zero_copy_only=False)
    code, _, _ = arrays.distinct(*arrays.cut(data, starts, ends))
    inside = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :]) if k > 1 else np.zeros(0, np.int64)
    window, of = window_codes(code, k)[inside] if len(inside) else inside, row[inside]
    place = at[of] + inside - first[of]
    alone = np.flatnonzero(np.diff(first) == 1)  # a digest stands for the only window
    window = np.concatenate([window, code[first[alone]] + len(code)])
    of, place = np.concatenate([of, alone]), np.concatenate([place, at[alone]])
    group = np.cumsum(np.concatenate([[False], m[1:] != m[:-1]]))
    key = group[of] << 32 | window
    order = np.argsort(key, kind="stable")
    s_key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], s_key[1:] != s_key[:-1]])) if len(s_key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(s_key)))
    later = np.ones(len(s_key), bool)
    later[begin] = False
    repeated = np.repeat((size > 1) | np.logical_or.reduceat(many[of[order]], begin), size) if len(begin) else later
    hit, later = order[repeated], later[repeated]
    back = np.argsort(hit, kind="stable")
    hit, later = hit[back], later[back]
    r, p = of[hit], place[hit]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (later[1:] != later[:-1])]) if len(hit) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(hit)) - 1 if len(a) else a
    return pa.RecordBatch.from_arrays([pa.array(ids[r[a]]), pa.array(h[r[a]]), pa.array(p[a]), pa.array(p[z] + k), pa.array(later[a])], _FOUND)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows that repeat an id with the same text are one document, h tells others apart."""
    text = shared.named(text_col)
    return docs.select(shared.named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).filter("id is not null and text is not null")


def _digests(column: pa.StringArray, word: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, list[str]]:
    """(bucket, digest) of each window of k words from the given word on."""
    data, starts, ends, _, _ = spans_of_words(column)
    bounds, plain = arrays.cut(np.append(data, np.uint8(32)), starts, ends + 1)
    plain = plain.copy()
    plain[bounds[1:] - 1] = 32
    raw = plain.tobytes()
    found = [blake2b(raw[a:z], digest_size=16, key=x).digest() for a, z, x in zip(bounds[word].tolist(), bounds[word + k].tolist(), map(int.to_bytes, m.view(np.uint64).tolist(), [8] * len(m)), strict=True)]
    return np.frombuffer(b"".join(found), np.int64)[::2], [d.hex() for d in found]


def _pack(candidates: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """(m, id, h, at, stop, packed, many) of the candidates (m, id, h, at, n, hot): super-k-mers as they
    stand in the text; of a hot one a digest for each window, under a bucket of its own. Of equal strings that
    are packed together the first has many set, the others have no string and no m."""

    def parted(s: pa.StringArray, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        data, starts, ends, _, first = spans_of_words(s)
        lists = rows.column(3)
        of = np.repeat(np.arange(len(s)), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        at, n, m, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(4))
        ids, h = (rows.column(c).to_numpy()[of] for c in (0, 1))
        cold = np.flatnonzero(~hot)
        for b in range(0, len(cold), 20_000):
            part = cold[b : b + 20_000]
            word = first[of[part]] + at[part]
            to, text = arrays.cut(data, starts[word], ends[word + n[part] + k - 2])
            strings = pa.StringArray.from_buffers(len(to) - 1, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(text))
            begin = at[part].astype(np.int64)
            yield pa.table([m[part], ids[part], h[part], begin, begin + n[part] + k - 1, strings], names[:-1])
        if hot.any():
            part = np.repeat(np.flatnonzero(hot), n[hot])
            within = np.arange(len(part)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            bucket, digest = _digests(s, first[of[part]] + at[part] + within, m[part], k)
            begin = (at[part] + within).astype(np.int64)
            yield pa.table([bucket, ids[part], h[part], begin, begin + k, pa.array(digest, pa.string())], names[:-1])

    def flushed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        rows = rows.append_column("many", pa.array(np.zeros(len(rows), bool)))
        one, several, others = _first_of_equals(rows)
        firsts, rest = rows.take(one), rows.take(others)
        yield from firsts.set_column(6, "many", pa.array(several)).combine_chunks().to_batches()
        # these have only to be put together with the others of their document
        nothing = [pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.string()), pa.nulls(len(rest), pa.bool_())]
        yield from pa.table([nothing[0], *(rest.column(c) for c in ("id", "h", "at", "stop")), *nothing[1:]], names).combine_chunks().to_batches()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            done = 0
            for s in arrays.slices(arrays.strings(batch.column(2))):
                for rows in parted(s, batch.slice(done, len(s))):
                    held.append(rows)
                    size += rows.nbytes
                done += len(s)
                if size >= 2 * TOGETHER:
                    yield from flushed(held)
                    held, size = [], 0
        if held:
            yield from flushed(held)

    names = ["m", "id", "h", "at", "stop", "packed", "many"]
    listed = candidates.groupBy("id", "h").agg(F.collect_set(F.struct("at", "n", "m", "hot")).alias("parts"))
    joined = keyed.join(listed, ["id", "h"]).select("id", "h", "text", "parts")
    return joined.mapInArrow(packed, "m long, id long, h long, at long, stop long, packed string, many boolean")


def repeated_stretches(docs: DataFrame, k: int = WINDOW, m: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, start, stop, removed): maximal stretches of words covered by repeated windows, those of
    first occurrences (by id) and those of later ones apart."""
    return stretches(_keyed(docs, id_col, text_col), k, m, hot)


def stretches(keyed: DataFrame, k: int, m: int, hot: int) -> DataFrame:
    """(id, h, start, stop, removed) for keyed (id, h, text)."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for s in arrays.slices(arrays.strings(batch.column(2))):
                row, at, n, least = super_kmers(s, k, m)
                ids, h = (batch.column(c).to_numpy()[done + row] for c in (0, 1))
                done += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(ids), pa.array(h), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "id", "h", "at", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by minimiser, string and place; held are the distinct strings of unfinished minimisers."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            told = np.flatnonzero(batch.column(5).is_null().to_numpy(zero_copy_only=False))
            if len(told):
                yield _stretch_rows(rows, told, rows.column("stop").to_numpy()[told])
                rows = rows.filter(rows.column("packed").is_valid())
                if not len(rows):
                    continue
            rows = rows if held is None else pa.concat_tables([held, rows])
            if held is None or rows.nbytes - held.nbytes >= TOGETHER // 4 or rows.nbytes >= TOGETHER:
                one, several, others = _first_of_equals(rows)
                yield _stretch_rows(rows, others, rows.column("stop").to_numpy()[others])
                rows = rows.take(one).set_column(6, "many", pa.array(several))
            held = rows.combine_chunks()
            if held.nbytes >= TOGETHER:
                of = held.column("m").to_numpy()
                whole = int(np.searchsorted(of, of[-1], "left"))  # the last minimiser may go on
                if whole:
                    yield _count_bucket(held.slice(0, whole), k)
                    held = held.take(np.arange(whole, len(held)))
        if held is not None:
            one, several, others = _first_of_equals(held)
            yield _stretch_rows(held, others, held.column("stop").to_numpy()[others])
            yield _count_bucket(held.take(one).set_column(6, "many", pa.array(several)), k)
        held = None
        arrays.release()

    places = keyed.mapInArrow(placed, "m long, id long, h long, at int, n int")
    # counted before the join, so that a common minimiser's rows are added up where they lie and AQE divides them
    times = places.groupBy("m").agg(F.count("*").alias("times")).filter("times > 1")
    candidates = places.join(times.select("m", (F.col("times") > hot).alias("hot")), "m")
    packed = _pack(candidates, keyed, k)
    bucket = F.coalesce("m", F.xxhash64("id", "h", "at"))
    sent = packed.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("m", "packed", "id", "h", "at").drop("bucket")
    found = sent.mapInArrow(counted, "id long, h long, start long, stop long, removed boolean")
    kind = Window.partitionBy("id", "h", "removed").orderBy("start", "stop")
    reach = F.max("stop").over(kind.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("stretch", F.sum("new").over(kind.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "h", "removed", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*_FOUND)


def find_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, removed) of every stretch of a document made of windows of k words
    that occur more than once in the corpus, in the same document or another.

    removed is false for the first occurrence (the least id, then the first place), true for all
    others. Documents without one, with fewer than k words, with null or empty text or a null id have
    no rows. Rows with the same id and the same text are one document. An empty table gives no rows.
    Other columns don't matter, whatever their names.
    """
    found = repeated_stretches(docs, k, m, hot, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("start").alias("first_word"), (F.col("stop") - F.col("start")).alias("n_words"), "removed")


def _without(text: Column, parts: Column) -> Column:
    """text without the words of the parts (start, stop); what stands between words stays. Said to be
    nondeterministic so that it isn't computed once for a filter and again for the output."""

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        texts, out, done = arrays.strings(texts), [], 0
        for s in arrays.slices(texts):
            lists = spans.slice(done, len(s))
            done += len(s)
            data, starts, ends, _, first = spans_of_words(s)
            offsets, _ = arrays.buffers(s)
            flat = lists.flatten()
            of = np.repeat(np.arange(len(s)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            a, z = (first[of] + flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, starts[a], 1)
            after = np.minimum(z, len(starts) - 1)
            to = np.where((z < len(starts)) & (z < first[of + 1]), starts[after], offsets[of + 1])  # the space behind goes too
            np.add.at(gone, to, -1)
            stay = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[offsets]
            out.append(pa.StringArray.from_buffers(len(s), pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[stay])))
        return pa.chunked_array(out, pa.string()).combine_chunks() if out else pa.array([], pa.string())

    return F.when(parts.isNull(), text).otherwise(cut.asNondeterministic()(text, F.coalesce(parts, F.array().cast("array<struct<start:bigint,stop:bigint>>"))))


def drop_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, all columns, its texts without the stretches that find_repeats calls removed; chars_col,
    if there is one, is set to the new length. A document of which no word is left goes; any other
    row stays, with null ids and texts as they are.
    """
    gone = repeated_stretches(docs, k, m, hot, id_col, text_col).filter("removed")
    gone = gone.groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    keyed = docs.select(shared.row(docs).alias("row"), shared.named(id_col).cast("long").alias("id"), F.xxhash64(shared.named(text_col)).alias("h"))
    joined = keyed.join(gone, ["id", "h"], "left").select("row", (F.col("parts").isNotNull()).alias("changed"), _without(F.col("row")[text_col], F.col("parts")).alias("rest"))
    joined = joined.filter(~F.col("changed") | F.col("rest").rlike(r"[^\t\n\x0B\f\r ]"))
    new = {text_col: F.col("rest")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("changed"), F.length("rest")).otherwise(F.col("row")[chars_col]).cast(docs.schema[chars_col].dataType)
    return joined.select(*shared.fields(docs, **new))


#: The same by joining the words of every window to one string.
ORACLE = f"""WITH words AS (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT doc_id, text, w, unnest(range(0, len(w) - {WINDOW} + 1)) AS place FROM words),
windows AS (SELECT doc_id, text, place, md5(array_to_string(w[place + 1:place + {WINDOW}], ' ')) AS words FROM places),
counted AS (SELECT doc_id, text, place, count(*) OVER (PARTITION BY words) AS times, row_number() OVER (PARTITION BY words ORDER BY doc_id, place) > 1 AS removed FROM windows),
marked AS (SELECT *, coalesce(place > max(place + {WINDOW}) OVER (PARTITION BY doc_id, text, removed ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM counted WHERE times > 1),
stretches AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, removed ORDER BY place) AS stretch FROM marked)
SELECT doc_id, min(place)::BIGINT AS first_word, (max(place) + {WINDOW} - min(place))::BIGINT AS n_words, removed FROM stretches GROUP BY doc_id, text, removed, stretch"""
