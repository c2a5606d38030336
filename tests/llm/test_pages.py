"""HTML extraction and WARC."""

from __future__ import annotations

import gzip
import io
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import html, shared, warc


def brute(pages, length):
    """(id, tokens, boilerplate tokens, words left) of pages (id, host, html)."""
    streams = [(i, h, None if p is None else html.stream(p).split()) for i, h, p in pages]
    seen = defaultdict(set)
    for _, h, t in streams:
        for k in range(len(t or ()) - length + 1):
            seen[h, tuple(t[k : k + length])].add(tuple(t))
    out = []
    for i, h, t in streams:
        if t is None:
            out.append((i, None, None, None))
            continue
        gone = {x for k in range(len(t) - length + 1) if h is not None and len(seen[h, tuple(t[k : k + length])]) > 1 for x in range(k, k + length)}
        out.append((i, len(t), len(gone), [x for k, x in enumerate(t) if k not in gone and x[0] != "\x01"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("host_bytes", [html.HOST_BYTES, 0])
@pytest.mark.parametrize("length", [html.LENGTH, 6])
def test_extract_matches_brute_force(sf, length, host_bytes):
    pages = sf("pages").select("page_id", "url", "html", html.host_of(F.col("url")).alias("host"))
    got = [(r.page_id, r.n_tokens, r.n_boilerplate, r.text.split()) for r in html.extract(pages, length, host_bytes).collect()]
    assert sorted(got, key=repr) == brute([(r.page_id, r.host, r.html) for r in pages.collect()], length)
    assert sum(g[2] for g in got) > 0


@pytest.mark.parametrize("block_bytes", [3_000, 60_000])
def test_blocks_change_nothing(sf, block_bytes):
    """Every host in blocks, hosts just above and below the size, and every host in one task."""
    pages = sf("pages").repartition(5, "page_id")
    want = sorted(map(tuple, html.extract(pages).collect()), key=repr)
    size = pages.groupBy(html.host_of(F.col("url"))).agg(F.sum(F.octet_length("html")).alias("n")).orderBy("n").collect()
    for most in (0, size[len(size) // 2].n, size[len(size) // 2].n - 1):
        assert sorted(map(tuple, html.extract(pages, host_bytes=most, block_bytes=block_bytes).collect()), key=repr) == want


def test_identical_pages_are_one_however_many(spark):
    """Copies cost a row each: what is compared between blocks grows with blocks, not with pairs of pages."""
    from tests.llm.conftest import sentence

    page = f"<p>{sentence(1, 300)}</p>"
    for copies in (200, 800):
        df = spark.createDataFrame([(k, "http://h.example", page) for k in range(copies)], "page_id long, url string, html string").repartition(4, "page_id")
        got = html.extract(df, host_bytes=0, block_bytes=20_000).collect()
        assert len(got) == copies and {r.n_boilerplate for r in got} == {0} and {r.text for r in got} == {sentence(1, 300)}
    block = html._Block(pa.chunked_array([pa.array(range(copies))]), pa.array([html.stream(page)] * copies), html.LENGTH)
    assert len(block.open_ones("h", 40, block.minimisers(html._scope("h"), 40)[2])[0]) == len(set(zip(*[html.stream(page).split()[k:] for k in range(html.LENGTH)])))


@pytest.mark.parametrize("host_bytes", [html.HOST_BYTES, 0])
def test_extract_cases(spark, host_bytes):
    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(9)) + "</ul></nav>"
    one = f"<html><head><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body>{menu}<p>First &amp; only&nbsp;text<b>bold</b></p><!-- no --><p>next</p></body></html>"
    two = f"<body>{menu}<div>Second page 你好 &lt;p&gt;</div><script>unclosed"
    table = [(1, "http://A.example/x", one), (2, "https://a.example:80/y", two), (2, "https://a.example:80/y", two), (3, "http://b.example", one), (4, None, one), (5, "nonsense", two), (6, "http://a.example/z", None), (7, "http://a.example/e", ""), (None, "http://c.example", "plain text < 3"), (8, "http://d.example", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "h", "r", 1) for r in table], "page_id long, url string, html string, host string, row string, tokens int")
    rows = html.extract(df, host_bytes=host_bytes).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(table)
    assert got[1].text == "First & only text bold\nnext" and got[2].text == "Second page 你好 <p>"
    assert got[1].n_boilerplate > 20 and got[3].n_boilerplate == got[4].n_boilerplate == 0 and got[3].text.startswith("menu 0\nmenu 1") and "no" not in got[4].text.split()
    assert got[6].text is None and got[6].n_tokens is None and got[7].text == "" and got[7].n_tokens == 0 and got[None].text == "plain text < 3" and got[8].n_tokens == 50_001
    assert html.extract(df.limit(0), host_bytes=host_bytes).count() == 0


def test_what_follows_an_element_stays(spark):
    middles = [
        '<svg-icon name="x"></svg-icon>', "<template-x>", "<style-guide></style-guide>", '<svg class="i"/>', "<svg/>", '<svg a="x > y"/>', "<svg>", "<noscript>", "<template/>", "<svg><svg>in</svg>",
        "<svg>in<svg>in</svg>in</svg>", "<svg><script href='x'/><style/>in</svg>", "<template>in<svg>in</template>", "<!-- <svg> -->", "<noscript>in</NOSCRIPT >", "<script>'<svg>'</script>", "<script>in</script-x>in</script x>", "<svg a='>'>in</svg>", "</template></svg>",
    ]
    df = spark.createDataFrame([(k, None, f"<p>before</p>{m}<p>after one two</p>") for k, m in enumerate(middles)], "page_id long, url string, html string")
    assert {middles[r.page_id]: r.text.split() for r in html.extract(df).collect()} == {m: "before after one two".split() for m in middles}
    assert html.stream("<p>before</p><svg><p>between</p><svg>in</svg><p>after</p><style>in").replace("\x01", "<").split() == "<p before </p <p between </p <p after </p".split()
    many = 20_000
    assert html.stream("<svg>" * many + "x" + "</template>" * many).split()[0] == "x" and html.stream("<svg>" * many + "x" + "</svg>" * many) == ""


@pytest.mark.parametrize("host_bytes", [html.HOST_BYTES, 0])
def test_short_footers_go_and_articles_stay(spark, host_bytes):
    from tests.llm.conftest import sentence

    articles = [sentence(50 + k, 40) for k in range(6)]
    table = [(k, f"http://h.example/{k}", f"<html><body><article><p>{a}</p></article><footer>&copy; h.example &middot; All of it is ours.</footer></body></html>") for k, a in enumerate(articles)]
    rows = html.extract(spark.createDataFrame(table, "page_id long, url string, html string"), host_bytes=host_bytes).collect()
    assert {r.page_id: r.text for r in rows} == dict(enumerate(articles)) and {r.n_boilerplate for r in rows} == {14}


def test_suffix_array():
    import numpy as np

    codes = np.array([2, 1, 2, 1, 2, 3, 1, 2])
    order, rank = html.suffix_array(codes, 3)
    want = sorted(range(6), key=lambda k: (codes[k : k + 3].tolist(), k))
    assert order.tolist() == want and (rank[0] == rank[2]) and rank[1] != rank[3]


def lost(i):
    import hashlib

    return hashlib.md5(str(i).encode()).digest()[0] in (0, 1, 3)


@pytest.mark.parametrize("range_bytes, compressed", [(warc.RANGE, True), (20_000, True), (20_000, False)])
def test_salvage_recovers_all_that_is_whole(sf, range_bytes, compressed):
    pages = sf("pages").repartition(2, "page_id")
    rows = warc.round_trip(pages, range_bytes=range_bytes, compressed=compressed).collect()
    want = sorted((r.page_id, r.url, r.html) for r in pages.collect() if not lost(r.page_id))
    assert sorted((r.page_id, r.url, r.html) for r in rows if r.kind == "record") == want and len(want) < pages.count()
    spans = defaultdict(list)
    for r in rows:
        spans[r.file].append((r.start, r.stop))
    for s in spans.values():  # records and gaps tile each file
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    assert [r for r in rows if r.kind == "gap"]


def test_warc_cases(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/\r\ny", "<p>a</p>", 1), (None, None, "é" * 200_000, 2), (2, "u", "", 3), (3, "u", None, 4), (1, "http://x/\r\ny", "<p>a</p>", 1)], "page_id long, url string, html string, type int")
    rows = warc.round_trip(pages, damage=None).collect()
    assert sorted((str(r.page_id), str(r.url), len(r.html)) for r in rows) == [("1", "http://x/%0D%0Ay", 8), ("1", "http://x/%0D%0Ay", 8), ("2", "u", 0), ("None", "None", 200_000)]
    assert warc.round_trip(pages.limit(0)).count() == 0
    inner = warc.record(b"inside", "u", "urn:page:9")
    whole = warc.record(b"x" * 300 + b"\r\n" + inner + b"y" * 50, "o", "urn:page:1")
    (tmp_path / "a.warc").write_bytes(b"junk" + whole + whole[: len(whole) // 3] + warc.record(b"last", "l", "urn:page:2"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole + inner) + b"\x1f\x8b\x08\x00" + b"\x00" * 30)
    (tmp_path / "c.warc").write_bytes(b"nothing of the kind")
    (tmp_path / "d.warc").write_bytes(b"")
    for size in (warc.RANGE, 64):
        got = sorted(((r.file, r.start, r.record_id, r.position) for r in warc.read_warc(spark, str(tmp_path), size).collect()), key=str)
        assert [g[2] for g in got if g[0] == "b.warc.gz" and g[2]] == ["<urn:page:1>", "<urn:page:9>"]
        assert {g[2] for g in got if g[0] == "a.warc"} == {None, "<urn:page:1>", "<urn:page:2>"} and [g[1:3] for g in got if g[0] == "c.warc"] == [(0, None)]
        assert len([g for g in got if g[0] == "a.warc" and g[2]]) == 2


def test_paths_are_those_of_the_cluster(spark, tmp_path):
    bare = shared.qualified(spark, str(tmp_path))
    assert bare.startswith("file:/") and shared.system(bare)[1] == str(tmp_path) and shared.system(f"file://{tmp_path}")[1] == str(tmp_path)
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    for path in (f"{tmp_path}/a", f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        warc.write_warc(pages, path)
        assert [r.uri for r in warc.read_warc(spark, path).collect()] == ["u"]
    with pytest.raises(ValueError, match="scheme"):
        shared.system("/bare")


def test_members_of_several_records_are_salvaged():
    import random

    bodies = [random.Random(k).randbytes(40_000) for k in range(4)]
    records = [warc.record(b, "u", f"urn:page:{k}") for k, b in enumerate(bodies)]
    wrong = warc.record(b"x" * 50, "u", "urn:page:9").replace(b"xxx", b"yyy")
    after = warc.member(warc.record(b"last", "u", "urn:page:5"))
    whole = warc.member(b"".join(records))
    no_digest = warc.member(b"".join(b"\r\n".join(x for x in r.split(b"\r\n") if not x.startswith(b"WARC-Block")) for r in records))
    middle = len(whole) * 5 // 8

    def found(raw):
        at = list(warc.scan(pa.BufferReader(raw), len(raw), 0, len(raw)))
        assert all(a[1] <= b[0] for a, b in zip(at, at[1:], strict=False))
        return [r["body"] for a in at for r in a[2]]

    assert found(warc.member(records[0] + wrong + records[1]) + after) == [*bodies[:2], b"last"]
    assert found(whole[:middle] + after) == found(whole[:middle]) + [b"last"] == [*bodies[:2], b"last"]
    assert found(whole[:middle] + bytes(9) + whole[middle + 9 :] + after) == [*bodies[:2], bodies[3], b"last"]
    assert found(no_digest[:middle] + after) == [b"last"]


def test_headers_of_any_length():
    for n in (65_300, 65_400, 65_500, 70_000, 3_000_000):
        raw = warc.record(b"a", "http://x/" + "u" * n, "urn:page:1")
        for both in (raw + raw, warc.member(raw) * 2):
            found = list(warc.scan(pa.BufferReader(both), len(both), 0, len(both)))
            assert [len(r["uri"]) for x in found for r in x[2]] == [n + 9] * 2
    broken = b"WARC/1.1\r\n" + b"no header " * 20_000 + b"\r\n" + raw
    assert [x[0] for x in warc.scan(pa.BufferReader(broken), len(broken), 0, len(broken))] == [len(broken) - len(raw)]


def test_scan_of_bytes():
    raw = b"".join(warc.member(warc.record(str(k).encode(), "u", f"urn:page:{k}")) for k in range(5))
    found = list(warc.scan(pa.BufferReader(raw), len(raw), 0, len(raw)))
    assert [x[2][0]["body"] for x in found] == [b"0", b"1", b"2", b"3", b"4"] and found[-1][1] == len(raw)
    assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1") == 5
