"""WARC files: a writer, and a reader that salvages what damage leaves.

Files are read in ranges of bytes, so one large file is the work of many tasks. A range's task walks from
member to member (gzip members, or bare records by their version line) that begin in its range. A record
counts if its header, its length, its end and its block digest are right. In a gzip member that has a wrong record
the search goes on at the next version line of its content; of a damaged member, records with a digest that were
decompressed before the damage count. After a failed check the reader searches for the next valid gzip member
or version line and goes on there. What lies between valid members is logged as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import shared

#: Bytes of a file that one task looks through.
RANGE = 32 << 20
#: Bytes read at a time.
CHUNK = 1 << 20
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_HEADER = ("type", "uri", "record_id", "date")
_SCHEMA = "file string, start long, stop long, position int, type string, uri string, record_id string, date string, body binary"


def _digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(body: bytes, uri: str | None, record_id: str, date: str = "2024-01-01T00:00:00Z", kind: str = "resource") -> bytes:
    """One record as it stands in a bare file."""
    uri = None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [] if uri is None else [f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Block-Digest: {_digest(body)}", "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _headed(data: bytes, at: int) -> tuple[int, bool]:
    """(where the header at data[at:] ends, -1 if nowhere; whether it may end in bytes beyond data). A header
    of over 64 KB must be lines of a name and a colon."""
    head = data.find(b"\r\n\r\n", at, at + (1 << 16))
    if head >= 0:
        return head, False
    begin = at
    while (stop := data.find(b"\r\n", begin)) >= 0:
        if stop == begin:
            return stop - 2, False
        if begin == at and stop > at + 32 or begin > at and b":" not in data[begin:stop]:
            return -1, False
        begin = stop + 2
    return -1, begin > at or len(data) < at + 34


def parse(data: bytes | memoryview, at: int, sure: bool = False) -> tuple[dict, int] | None:
    """(record, its end) of the record at data[at:], or None where it isn't a whole and right one. sure:
    also None where it has no digest to tell."""
    data = bytes(data) if isinstance(data, memoryview) else data
    if data[at : at + 7] != _VERSION:
        return None
    head, _ = _headed(data, at)
    if head < 0:
        return None
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return None
    end = head + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None
    body = data[head + 4 : end]
    said = fields.get(b"warc-block-digest", "")
    if said != _digest(body) if said.startswith("sha1:") else sure:
        return None
    found = {"type": fields.get(b"warc-type"), "uri": fields.get(b"warc-target-uri"), "record_id": fields.get(b"warc-record-id"), "date": fields.get(b"warc-date"), "body": body}
    return found, end + 4


class _Bytes:
    """A window on a file: bytes from `base` on, grown as far as they are asked for."""

    def __init__(self, source: pa.NativeFile, size: int) -> None:
        self.source, self.size, self.base, self.held = source, size, 0, b""

    def at(self, start: int, n: int) -> bytes:
        """n bytes from start, fewer only at the file's end."""
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if not (self.base <= start and start + n <= self.base + len(self.held)):
            self.source.seek(start)
            self.base, self.held = start, self.source.read(max(n, CHUNK))
        return self.held[start - self.base : start - self.base + n]

    def find(self, what: bytes, start: int, end: int) -> int:
        """Where `what` next begins, at start or later but before end; -1 if nowhere."""
        while start < end:
            part = self.at(start, CHUNK)
            k = part.find(what)
            if k >= 0:
                return start + k if start + k < end else -1
            if start + len(part) >= self.size:
                return -1
            start += len(part) - len(what) + 1
        return -1

    def gunzip(self, start: int) -> tuple[bytes, int, bool]:
        """(content, end, whole) of the gzip member at start; of a damaged one, the content before the damage."""
        z, out, at = zlib.decompressobj(31), [], start
        while not z.eof:
            part, before = self.at(at, 1 << 16), z.copy()
            if not part:
                return b"".join(out), at, False
            try:
                out.append(z.decompress(part))
            except zlib.error:
                for k in range(len(part)):
                    try:
                        out.append(before.decompress(part[k : k + 1]))
                    except zlib.error:
                        break
                return b"".join(out), at, False
            at += len(part)
        return b"".join(out), at - len(z.unused_data), True

    def reached(self, start: int, n: int) -> int:
        """Where the first n bytes of the content of the gzip member at start end in the file."""
        z, at = zlib.decompressobj(31), start
        while True:
            part, before, left = self.at(at, 1 << 16), z.copy(), n
            try:
                n -= len(z.decompress(part))
            except zlib.error:
                n = 0
            if n <= 0:
                break
            at += len(part)
        for k in range(len(part)):
            left -= len(before.decompress(part[k : k + 1]))
            if left <= 0:
                return at + k + 1
        return at + len(part)

    def bare(self, start: int) -> tuple[list[dict], int] | None:
        """The bare record at start; more is read until its length is satisfied."""
        n = 1 << 16
        head = self.at(start, n)
        stop, more = _headed(head, 0)
        while more and start + len(head) < self.size:
            n *= 4
            head = self.at(start, n)
            stop, more = _headed(head, 0)
        if stop < 0:
            return None
        size = next((x.partition(b":")[2].strip() for x in head[:stop].split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        if not size.isdigit() or start + stop + 8 + int(size) > self.size:
            return None
        found = parse(self.at(start, stop + 8 + int(size)), 0)
        return None if found is None else ([found[0]], start + found[1])

    def valid(self, start: int) -> tuple[list[dict], int] | None:
        """(records, end) of a valid member or bare record at start."""
        head = self.at(start, 7)
        if head == _VERSION:
            return self.bare(start)
        if head[:3] != _MAGIC:
            return None
        content, end, whole = self.gunzip(start)
        records, at = [], 0
        while 0 <= at < len(content):
            one = parse(content, at, sure=not whole)
            if one is None:
                at = content.find(_VERSION, at + 1)
                continue
            records.append(one[0])
            at = last = one[1]
        return (records, end if whole else self.reached(start, last)) if records else None


def scan(source: pa.NativeFile, size: int, first: int, end: int) -> Iterator[tuple[int, int, list[dict]]]:
    """(start, stop, records) of the valid members that begin in first..end."""
    held, at = _Bytes(source, size), first
    while at < min(end, size):
        got = held.valid(at)
        if got:
            yield at, got[1], got[0]
            at = got[1]
            continue
        ways = [k for k in (held.find(w, at + 1, min(end, size)) for w in (_MAGIC, _VERSION)) if k >= 0]
        if not ways:
            return
        at = min(ways)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, start, stop, position, type, uri, record_id, date, body) of every valid record, and a row
    with type null for each gap.

    path: a folder (or one file) of .warc and .warc.gz files; without a scheme it is of the cluster's default
    file system, as any path of Spark's. A
    record's start and stop are its member's bytes in the file, position its number in the member. Gaps
    have start and stop only; a wrong record within an undamaged gzip member beside right ones is left out without a gap. An empty file gives no rows, one without any valid record one gap. Valid
    looking members inside another's bytes aren't records.
    """
    path = shared.qualified(spark, path)
    system, root = shared.system(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and f.size)
    prefix = len(root) + 1 if not info.is_file else root.rfind("/") + 1
    listing = spark.createDataFrame([(p, s) for p, s in files], "path string, size long")
    ranges = listing.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("first"))
    n = sum(-(-s // range_bytes) for _, s in files)
    # a task for each range: ranges are few and large
    ranges = ranges.repartition(max(1, min(n, 100_000)), "path", "first")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, _ = shared.system(path)
        for batch in batches:
            for row in batch.to_pylist():
                with reach.open_input_file(row["path"]) as source:
                    out, held = [], 0
                    for start, stop, records in scan(source, row["size"], row["first"], row["first"] + range_bytes):
                        out += [{"file": row["path"][prefix:], "start": start, "stop": stop, "position": k} | r for k, r in enumerate(records)]
                        held += sum(len(r["body"]) for r in records)
                        if held > CHUNK:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int32()), *((c, pa.string()) for c in _HEADER), ("body", pa.binary())])
    place = shared.place(spark, "warc-records")
    ranges.mapInArrow(scanned, _SCHEMA).write.parquet(place)
    records = spark.read.parquet(place)
    order = Window.partitionBy("file").orderBy("start", "stop")
    members = records.filter("position = 0").select("file", "start", "stop")
    ends = listing.select(F.substring("path", prefix + 1, 1 << 20).alias("file"), F.col("size").alias("start"), F.col("size").alias("stop"))
    told = members.unionByName(ends).withColumn("before", F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = shared.cut(told)
    gaps = told.filter("before < start").select("file", F.col("before").alias("start"), F.col("start").alias("stop"))
    inner = told.filter("start < before and stop > start").select("file", "start")
    outer = records.join(shared.small(inner, inner.count()), ["file", "start"], "left_anti").select(*records.columns)
    return outer.unionByName(gaps, allowMissingColumns=True)


Damage = Callable[[int | None, bytes], bytes]


def damaged(page_id: int | None, raw: bytes) -> bytes:
    """Deterministic damage to about one member of 64, by the id's digest: bytes overwritten, the
    second half lost, or junk in front (which costs no record)."""
    by = hashlib.md5(str(page_id).encode()).digest()
    if by[0] >= 4:
        return raw
    half = len(raw) // 2
    return [raw[:half] + bytes(8) + raw[half + 8 :], raw[:half], b"\x00junk\x1f\x8b\x08" * 9 + raw, raw[:half] + b"WARC/1." + raw[half + 7 :]][by[0]]


def write_warc(pages: DataFrame, path: str, damage: Damage | None = None, compressed: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as WARC files in the folder path, one for each partition, a record (and gzip member)
    for each page. A repeated task writes the same file again: the file takes its name when it is whole.

    A null html isn't written; a null id or url leaves its header field out.
    """
    path = shared.qualified(pages.sparkSession, path)
    system, root = shared.system(path)
    system.create_dir(root, recursive=True)
    ending = ".warc.gz" if compressed else ".warc"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reach, here = shared.system(path)
        name = f"{here}/part-{TaskContext.get().partitionId():06d}{ending}"
        n = 0
        with reach.open_output_stream(working := f"{name}.{uuid.uuid4().hex}.tmp", compression=None) as sink:
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if html is None:
                        continue
                    raw = record(html.encode(), url, "urn:page:" + ("" if page_id is None else str(page_id)))
                    raw = member(raw) if compressed else raw
                    sink.write(damage(page_id, raw) if damage else raw)
                    n += 1
        reach.move(working, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    pages.select(shared.named(id_col), shared.named(url_col), shared.named(html_col)).mapInArrow(written, "n long").agg(F.sum("n")).collect()


def round_trip(pages: DataFrame, damage: Damage | None = damaged, range_bytes: int = RANGE, compressed: bool = True) -> DataFrame:
    """(kind, file, start, stop, page_id, url, html): the pages written as damaged WARC files and
    salvaged, kind 'record', and the quarantined gaps, kind 'gap'."""
    spark = pages.sparkSession
    path = shared.place(spark, "warc")
    write_warc(pages, path, damage, compressed)
    rows = read_warc(spark, path, range_bytes)
    kind = F.when(F.col("type").isNull(), "gap").otherwise("record")
    page_id = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    return rows.select(kind.alias("kind"), "file", "start", "stop", F.when(page_id != "", page_id.cast("long")).alias("page_id"), F.col("uri").alias("url"), F.decode("body", "UTF-8").alias("html"))
