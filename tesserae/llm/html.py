"""HTML extraction by host suffix arrays.

A page becomes a stream of tokens: its visible words, and a mark for each tag; scripts, styles,
comments and attributes are no tokens. The streams of a host's pages are concatenated and their suffixes
sorted by their first `LENGTH` tokens (prefix doubling over exact token codes). Neighbours in the suffix
array that agree that far are occurrences of one substring; if they lie in at least two distinct
pages, the tokens they cover are boilerplate of the host. What is left of a page are its unique runs.

A host of more than `HOST_BYTES` isn't sorted by one task but in blocks, where its pages lie, and what a
block can't decide alone is decided between blocks; the result is the same:

* A task parses its pages once and writes them, block by block, into the shared folder. Blocks don't move.
* Of each block the distinct minimisers of its super-k-mers (a third as many as tokens) travel as sorted
  numbers of a few bits. Those that stand in one block only can't be part of a substring of two blocks;
  the others are told to their blocks, a bit each.
* A block's suffix array decides every substring that stands in two distinct pages of the block. Those
  with a told minimiser, decided or not, travel once a block as 128-bit digests of host and tokens, with
  their page's digest. Those that stand in two distinct pages are told to their blocks, which
  cut them out. No group is larger than the number of blocks.
"""

from __future__ import annotations

import html as entities
import io
import math
import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import arrays, shared, substring

#: Least tokens of a repeated substring, tag marks among them (footers come to as few as 10), and
#: the gram by which a large host's substrings are divided.
LENGTH, GRAM = 10, 6
#: Bytes of html of a host that one task sorts, and of the streams of a block of a larger host.
HOST_BYTES, BLOCK_BYTES = 16_000_000, 8_000_000
#: Minimisers that one task compares.
TOGETHER = 2_000_000
_MARK = "\x01"
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)(script|style|noscript|template|svg)(?=[\s/>])(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+>", re.I | re.S)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style")}
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<(/?[a-zA-Z][a-zA-Z0-9-]*)[^<>]*>?")
_BLOCK = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section header footer nav aside main title body html head blockquote pre form dl dt dd hr figure figcaption option".split()


def _mark(m: re.Match) -> str:
    return f" {_MARK}{(m[1] or m[2]).lower()} "


def _visible(page: str) -> str:
    """A page without comments, scripts, styles, noscript, template and svg elements.

    Scripts and styles end at their end tag, or with the page. Of the others an element without end tag
    loses only its own tag; a self-closing svg is whole."""
    gone: list[tuple[int, int]] = []
    begun: list[tuple[str, int]] = []
    times = dict.fromkeys(("noscript", "template", "svg"), 0)  # in begun
    at = 0
    while m := _GONE.search(page, at):
        at, name, whole = m.end(), (m[2] or "").lower(), m[0].endswith("/>")
        if not m[1]:
            if name in _RAW_END and not (whole and times["svg"]):  # in an svg these can be self-closing too
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            elif name in times and not (whole and name == "svg"):
                begun.append((name, m.start()))
                times[name] += 1
            gone.append((m.start(), at))
        elif times.get(name):
            last = ""
            while last != name:
                last, start = begun.pop()
                times[last] -= 1
            gone.append((start, at))
    parts, done = [], 0
    for a, z in sorted(gone):
        if a >= done:
            parts.append(page[done:a])
        done = max(done, z)
    return " ".join([*parts, page[done:]])


def stream(page: str) -> str:
    """A page's tokens, one space between them; a tag is its name behind a mark."""
    text = _TAG.sub(_mark, _visible(page.replace(_MARK, " ")))
    parts = entities.unescape(text).split(" ")
    return " ".join(" ".join(parts).split())


def _streams(pages: pa.Array) -> pa.StringArray:
    done = [pa.array([None if p is None else stream(p) for p in s.to_pylist()], pa.string()) for s in arrays.slices(arrays.strings(pages))]
    return pa.chunked_array(done, pa.string()).combine_chunks()


def packed_streams(page: Column) -> Column:
    """The token stream of each page, compressed for its way to the host's task; null for null."""

    @F.arrow_udf(T.BinaryType())
    def streamed(pages: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        done = [pa.array([None if p is None else pack(stream(p).encode()) for p in s.to_pylist()], pa.binary()) for s in arrays.slices(arrays.strings(pages))]
        return pa.chunked_array(done, pa.binary()).combine_chunks()

    return streamed(page)


def _unpacked(column: pa.ChunkedArray) -> pa.StringArray:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if b is None else unpack(b).decode() for b in column.to_pylist()], pa.string())


def streams(page: Column) -> Column:
    """The token stream of each page; null for null."""

    @F.arrow_udf(T.StringType())
    def streamed(pages: pa.Array) -> pa.Array:
        return _streams(pages)

    return streamed(page)


def _tag_hashes() -> np.ndarray:
    names = (" ".join(f"{_MARK}{s}{b}" for b in _BLOCK for s in ("", "/"))).encode()
    data = np.frombuffer(names, np.uint8)
    return np.sort(arrays.hash_spans(data, *arrays.runs(data != 32, np.array([0, len(data)]))))


_BLOCKS = _tag_hashes()


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` codes, rank of each suffix): equal ranks are equal
    prefixes. Suffixes shorter than depth aren't in it. By doubling."""
    n = len(codes) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, have = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        rank = np.unique(rank[: len(rank) - step] << 32 | rank[step:], return_inverse=True)[1]
        have += step
    return np.argsort(rank, kind="stable"), rank


def covered(codes: np.ndarray, page: np.ndarray, group: np.ndarray, length: int, told: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
    """Which tokens lie in a substring of `length` tokens that stands in two distinct groups, or at one
    of the places told; page tells where streams end, group which streams count as one page."""
    order, rank, begin, apart = _substrings(codes, page, group, length)
    out = np.zeros(len(codes) + 1, np.int32)
    if len(order):
        size = np.diff(np.append(begin, len(order)))
        apart = apart | np.isin(rank[order[begin]], rank[told])
        hit = order[np.repeat(apart, size)]
        np.add.at(out, hit, 1)
        np.add.at(out, hit + length, -1)
    return np.cumsum(out[:-1]) > 0


def _substrings(codes: np.ndarray, page: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in the suffix array's order, rank by place, where each substring begins in the order,
    whether it stands in two distinct groups)."""
    order, rank = suffix_array(codes, length)
    order = order[page[order] == page[order + length - 1]]
    if not len(order):
        return order, rank, np.zeros(0, np.int64), np.zeros(0, bool)
    r, g = rank[order], group[order]
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return order, rank, begin, np.minimum.reduceat(g, begin) != np.maximum.reduceat(g, begin)


def _text(column: pa.StringArray, gone: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(text, tokens, tokens that went) of each stream, slice by slice; gone: by token."""
    done, at = [], 0
    for s in arrays.slices(column):
        n = len(substring.spans_of_words(s)[1])
        done.append(_text_of_slice(s, gone[at : at + n]))
        at += n
    if not done:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.chunked_array([d[0] for d in done], pa.string()).combine_chunks(), np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])


def _codes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every token of the streams; equal tokens have equal codes."""
    words, rows, base = [], [], 0
    for s in arrays.slices(column):
        data, starts, ends, row, _ = substring.spans_of_words(s)
        to, raw = arrays.cut(data, starts, ends)
        words.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)]))
        rows.append(row + base)
        base += len(s)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = pa.chunked_array(words).combine_chunks().dictionary_encode().indices
    return codes.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(rows)


def _text_of_slice(column: pa.StringArray, gone: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(text of what stays, tokens, tokens that went) of each stream; gone: by token. Words of
    different blocks, or on either side of what went, are divided by a line's end."""
    data, starts, ends, row, first = substring.spans_of_words(column)
    n = len(column)
    tag = data[starts] == 1
    name = arrays.hash_spans(data, starts, ends)
    block = tag & (_BLOCKS[np.minimum(np.searchsorted(_BLOCKS, name), len(_BLOCKS) - 1)] == name)
    edges = np.cumsum(block | gone)
    word = np.flatnonzero(~tag & ~gone)
    of, to = row[word], ends[word] - starts[word] + 1
    bounds, out = arrays.cut(np.append(data, np.uint8(32)), starts[word], ends[word] + 1)
    out = out.copy()
    same = of[1:] == of[:-1]
    out[bounds[1:] - 1] = 32
    out[bounds[1:-1][same & (edges[word][1:] != edges[word][:-1])] - 1] = 10
    stay = np.ones(len(out), bool)
    stay[bounds[1:][np.append(~same, True)] - 1 if len(word) else bounds[:0]] = False
    size = np.bincount(of, weights=to, minlength=n).astype(np.int64) - (np.bincount(of, minlength=n) > 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[stay])))
    return text, np.diff(first), np.bincount(row[gone], minlength=n)


_COLUMNS = ["row", "text", "n_tokens", "n_boilerplate"]
_RESULT = "row {row}, text string, n_tokens long, n_boilerplate long"


def _result(rows: pa.ChunkedArray | pa.Array, valid: np.ndarray, text: pa.StringArray, tokens: np.ndarray, went: np.ndarray) -> list[pa.Array]:
    return [rows, *(pa.array(x.to_pylist() if isinstance(x, pa.Array) else x, t, mask=~valid) for x, t in ((text, pa.string()), (tokens, pa.int64()), (went, pa.int64())))]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    return F.when(host != "", host)


def extract(pages: DataFrame, length: int = LENGTH, host_bytes: int = HOST_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_tokens, n_boilerplate) of every row of pages.

    Boilerplate are the tokens in a substring of at least `length` tokens that stands in two distinct
    pages of the host; pages of one host with the same stream count as one page, so whole copies aren't
    emptied. text joins the words that are left, a line's end between blocks. Null html: nulls. Empty
    html: empty text. A null url, or one without a host, has no boilerplate. Null and repeated ids are kept row
    by row. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    kept = F.struct(shared.named(id_col).alias("id"), shared.named(url_col).alias("url")).alias("row")
    base = pages.select(kept, host_of(shared.named(url_col)).alias("host"), shared.named(html_col).alias("html"))
    by_size = base.filter("host is not null").groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).filter(F.col("bytes") > host_bytes)
    sizes = shared.cut(by_size)
    large, in_all = sizes.agg(F.count("*"), F.sum("bytes")).first()
    # hosts too large for one task are few: of the whole input, at most bytes / host_bytes
    base = base.join(shared.small(sizes.select("host", F.lit(True).alias("large")), large), "host", "left")
    row_type = base.schema["row"].dataType.simpleString()
    result = _RESULT.format(row=row_type)

    def alone(batches):
        for batch in batches:
            tokens = _streams(batch.column(1))
            yield pa.RecordBatch.from_arrays(_result(batch.column(0), tokens.is_valid().to_numpy(zero_copy_only=False), *_text(tokens, np.zeros(len(_codes(tokens)[0]), bool))), _COLUMNS)

    def by_host(table: pa.Table) -> pa.Table:
        tokens = _unpacked(table.column("tokens"))
        code, row = _codes(tokens)
        stream_code = tokens.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        gone = covered(code, row, stream_code[row], length)
        del code, row
        arrays.release()
        return pa.table(_result(table.column("row"), tokens.is_valid().to_numpy(zero_copy_only=False), *_text(tokens, gone)), names=_COLUMNS)

    no_host = base.filter("host is null").select("row", "html").mapInArrow(alone, result)
    small = base.filter("host is not null and large is null").select("host", "row", packed_streams(F.col("html")).alias("tokens")).groupBy("host").applyInArrow(by_host, result)
    out = no_host.unionByName(small)
    if large:
        out = out.unionByName(_in_blocks(base.filter("large").select("row", "host", "html"), in_all, length, block_bytes, result))
    return out.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text", "n_tokens", "n_boilerplate")


class _Block:
    """Some pages of one host: rows and streams, their tokens' codes, and which streams are equal."""

    def __init__(self, rows: pa.ChunkedArray, tokens: pa.StringArray, length: int) -> None:
        self.rows, self.tokens, self.length = rows, tokens, length
        self.codes, self.page = _codes(tokens)
        self.group = tokens.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[self.page]

    @classmethod
    def read(cls, place: str, at: int, size: int, length: int) -> _Block:
        system, path = shared.system(place)
        with system.open_input_file(path) as source:
            source.seek(at)
            table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(source.read(size))).read_all()
        return cls(table.column("row"), arrays.strings(table.column("tokens")), length)

    @staticmethod
    def packed(rows: pa.Table) -> bytes:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        return zstandard.ZstdCompressor(level=9).compress(sink.getvalue())

    def minimisers(self, scope: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, substrings, number of `bits` bits) of each super-k-mer."""
        found = []
        base = 0
        for s in arrays.slices(self.tokens):
            row, at, n, least = substring.super_kmers(s, self.length, min(GRAM, self.length))
            first = substring.spans_of_words(s)[4]
            found.append((base + first[row] + at, n, arrays.mix(least ^ np.uint64(scope)) >> np.uint64(64 - bits)))
            base += int(first[-1])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def open_ones(self, host: str, bits: int, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, digest as two numbers, page's digest) of each distinct substring whose minimiser is
        told; the page's is 0 where the substring stands in two pages here."""
        order, rank, begin, apart = _substrings(self.codes, self.page, self.group, self.length)
        at, n, m = self.minimisers(_scope(host), bits)
        hit = np.isin(m, told)
        at, n = at[hit], n[hit]
        places = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.unique(np.searchsorted(rank[order[begin]], rank[places]))
        place, apart = order[begin[which]], apart[which]
        pages = np.array([0 if t is None else int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little") | 1 for t in self.tokens.to_pylist()], np.uint64)
        return place, self._digests(place, host.encode()), np.where(apart, np.uint64(0), pages[self.page[place]])

    def _digests(self, place: np.ndarray, host: bytes) -> np.ndarray:
        out, base = np.empty((len(place), 2), np.uint64), 0
        key = blake2b(host, digest_size=32).digest()
        for s in arrays.slices(self.tokens):
            data, starts, ends, _, first = substring.spans_of_words(s)
            here = np.flatnonzero((place >= base) & (place < base + first[-1]))
            raw = data.tobytes()
            spans = zip(starts[place[here] - base].tolist(), ends[place[here] - base + self.length - 1].tolist(), strict=True)
            out[here] = np.frombuffer(b"".join(blake2b(raw[a:z], digest_size=16, key=key).digest() for a, z in spans), np.uint64).reshape(-1, 2)
            base += int(first[-1])
        return out

    def result(self, told: np.ndarray) -> pa.RecordBatch:
        gone = covered(self.codes, self.page, self.group, self.length, told)
        return pa.RecordBatch.from_arrays([_one(x) for x in _result(self.rows, self.tokens.is_valid().to_numpy(zero_copy_only=False), *_text(self.tokens, gone))], _COLUMNS)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _scope(host: str) -> int:
    return int.from_bytes(blake2b(host.encode(), digest_size=8).digest(), "little")


def _pack_numbers(values: np.ndarray) -> bytes:
    """Rising numbers as differences, bytes of one weight together, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _expand(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _in_blocks(big: DataFrame, in_all: int, length: int, block_bytes: int, result: str) -> DataFrame:
    """The same for hosts that are too large for one task; in_all: their bytes of html."""
    spark = big.sparkSession
    place = shared.place(spark, "blocks")
    # of numbers of so many bits few are equal by chance; there are at most so many as a third of the tokens
    bits = min(60, math.ceil(math.log2(in_all + 2)) + 8)
    buckets = max(1, in_all // (12 * TOGETHER))
    tasks = min(100_000, 1 + 2 * in_all // block_bytes)  # said, as a block is much work for few bytes of rows

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = shared.system(place)
        system.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}"  # a repeated task writes another file; only one task's rows count
        held: dict[str, list[pa.Table]] = {}
        size: dict[str, int] = {}
        written = 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as sink:

            def flush(host: str) -> Iterator[pa.RecordBatch]:
                nonlocal written
                rows = pa.concat_tables(held.pop(host))
                size.pop(host)
                raw = _Block.packed(rows)
                sink.write(raw)
                values = np.unique(_Block(rows.column("row"), arrays.strings(rows.column("tokens")), length).minimisers(_scope(host), bits)[2])
                bucket = (values * np.uint64(buckets) >> np.uint64(bits)).astype(np.int64) if bits + buckets.bit_length() < 64 else (values.astype(np.float64) * (buckets / 2.0**bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
                lists = [_pack_numbers(values[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                k = len(lists) + 1  # and a row for the block itself
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{place}/{name}"] * k), pa.array([written] * k), pa.array([len(raw)] * k), pa.array([host] * k), pa.array([-1, *bucket[cuts[:-1]].tolist()], pa.int64()), pa.array([None, *lists], pa.binary())],
                    ["file", "at", "size", "host", "bucket", "numbers"],
                )
                written += len(raw)
                arrays.release()

            for batch in batches:
                tokens = _streams(batch.column(2))
                table = pa.table([batch.column(0), tokens, batch.column(1)], ["row", "tokens", "host"])
                hosts = table.column("host").combine_chunks().dictionary_encode()
                code = hosts.indices.to_numpy(zero_copy_only=False)
                for k, host in enumerate(hosts.dictionary.to_pylist()):
                    rows, most = table.take(np.flatnonzero(code == k)).select(["row", "tokens"]), 0
                    for part in arrays.slices(arrays.strings(rows.column("tokens")), block_bytes):
                        some = rows.slice(most, len(part))
                        most += len(part)
                        held.setdefault(host, []).append(some)
                        size[host] = size.get(host, 0) + some.column("tokens").nbytes
                        if size[host] >= block_bytes:
                            yield from flush(host)
                while sum(size.values()) > 4 * block_bytes:
                    yield from flush(max(size, key=size.get))
            for host in list(held):
                yield from flush(host)

    entries = shared.place(spark, "minimisers")
    big.mapInArrow(stored, "file string, at long, size long, host string, bucket long, numbers binary").write.parquet(entries)
    entries = spark.read.parquet(entries)
    blocks = entries.filter("bucket < 0").select("file", "at", "size", "host")

    def compared(rows: pa.Table) -> pa.Table:
        lists = [_unpack_numbers(b) for b in rows.column("numbers").to_pylist()]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        values = values[times > 1]
        told = [np.isin(x, values, assume_unique=True) for x in lists]
        some = np.flatnonzero([t.any() for t in told])
        columns = [rows.column(c).take(some) for c in ("file", "at", "size", "host", "bucket")]
        return pa.table([*columns, pa.array([_pack_numbers(lists[k][told[k]]) for k in some], pa.binary())], ["file", "at", "size", "host", "bucket", "numbers"])

    told = entries.filter("bucket >= 0").groupBy("bucket").applyInArrow(compared, "file string, at long, size long, host string, bucket long, numbers binary")
    told = told.groupBy("file", "at", "size", "host").agg(F.collect_list("numbers").alias("numbers")).repartition(tasks, "file", "at")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = _Block.read(r["file"], r["at"], r["size"], length)
                where, digest, page = block.open_ones(r["host"], bits, np.concatenate([_unpack_numbers(b) for b in r["numbers"]]))
                by = np.argsort(digest[:, 0], kind="stable")
                where, digest, page = where[by], digest[by], page[by]
                bucket = (digest[:, 0] >> np.uint64(40)).astype(np.int64) * buckets >> 24
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
                parts = [(_pack_numbers(digest[a:z, 0]), digest[a:z, 1].tobytes(), _squeeze(page[a:z]), _squeeze(where[a:z].astype(np.int32))) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                k = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * k, pa.string()), pa.array([r["at"]] * k, pa.int64()), pa.array(bucket[cuts[:-1]], pa.int64()), *(pa.array([x[i] for x in parts], pa.binary()) for i in range(4))],
                    ["file", "at", "bucket", "one", "two", "page", "place"],
                )
                arrays.release()

    def decided(rows: pa.Table) -> pa.Table:
        one, two, page, place = ([f(b) for b in rows.column(c).to_pylist()] for c, f in (("one", _unpack_numbers), ("two", lambda b: np.frombuffer(b, np.uint64)), ("page", lambda b: _expand(b, np.uint64)), ("place", lambda b: _expand(b, np.int32))))
        of = np.repeat(np.arange(len(one)), [len(x) for x in one])
        one, two, page, place = (np.concatenate(x) for x in (one, two, page, place))
        order = np.lexsort((two, one))
        one, two, page = one[order], two[order], page[order]
        begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        low, high = np.minimum.reduceat(page, begin), np.maximum.reduceat(page, begin)
        hit = np.repeat((low == 0) | (low != high), np.diff(np.append(begin, len(page)))) & (page != 0)
        hit = order[hit]
        hit = hit[np.argsort(of[hit], kind="stable")]
        some, n = np.unique(of[hit], return_counts=True)
        bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.table([rows.column("file").take(some), rows.column("at").take(some), pa.ListArray.from_arrays(bounds, pa.array(place[hit]))], ["file", "at", "places"])

    digests = told.mapInArrow(digested, "file string, at long, bucket long, one binary, two binary, page binary, place binary")
    found = digests.groupBy("bucket").applyInArrow(decided, "file string, at long, places array<int>")
    found = found.groupBy("file", "at").agg(F.flatten(F.collect_list("places")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _Block.read(r["file"], r["at"], r["size"], length).result(np.array(r["places"] or [], np.int64))
                arrays.release()

    return blocks.join(found, ["file", "at"], "left").select("file", "at", "size", "places").repartition(tasks, "file", "at").mapInArrow(cut, result)
