"""The archive converter: hand-written ARC files, round trips and edge cases."""

import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: 7\r\n\r\n<p>\r\n\r\nfiledesc://x 1.1.1.1 20200101000000 text/plain 5\n\xff\x00 end\r\n\r\n"
OLD = b"HTTP/1.0 404 Not Found\nServer: x\n\nnone"


def arc1() -> bytes:
    told = b"1 0 Some Organization\nURL IP-address Archive-date Content-type Archive-length\n"
    out = b"filedesc://one.arc 0.0.0.0 19960923142103 text/plain %d\n%b\n" % (len(told), told)
    for url, mime, block in ((b"http://a.example/", b"text/html", HTTP), (b"http://a.example/with blank", b"text/html; charset=x", OLD), (b"dns:a.example", b"text/dns", b"19960923142103\na.example. 10 IN A 1.2.3.4\n"), (b"http://empty/", b"no-type", b"")):
        out += b"%b 127.10.100.2 19961104142103 %b %d\n%b\n" % (url, mime, len(block), block)
    return out


def arc2() -> bytes:
    told = b"2 0 Other\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    out = b"filedesc://two.arc 0.0.0.0 1998 text/plain 200 - - 0 two.arc %d\n%b\n" % (len(told), told)
    for url, block in ((b"http://b.example/", HTTP), (b"http://c.example/", OLD + b"!")):
        out += b"%b 10.0.0.1 199801 text/html 200 fac069150613fe55599cc7fa88aa089d - %d two.arc %d\n%b\n" % (url, len(out), len(block), block)
    return out


@pytest.fixture(scope="module")
def arcs(tmp_path_factory):
    """One file of a member a record, as crawlers write, one of one member, one not compressed."""
    folder = tmp_path_factory.mktemp("arcs")
    first = arc1()
    at = first.index(b"http://a.example/with")
    (folder / "one.arc.gz").write_bytes(gzip.compress(first[:at]) + gzip.compress(first[at:]))
    (folder / "two.arc.gz").write_bytes(gzip.compress(arc2()))
    (folder / "three.arc").write_bytes(arc1().replace(b"one.arc", b"three.arc"))
    return str(folder)


def test_reads_both_versions(spark, arcs):
    got = {(r.archive, r.url): r for r in warc.read_arc(spark, arcs).collect()}
    assert len(got) == 10
    for name in ("one.arc", "three.arc"):
        own = [got[name, u] for u in ("http://a.example/", "http://a.example/with blank", "dns:a.example", "http://empty/")]
        assert [bytes(r.block) for r in own[:2]] == [HTTP, OLD] and bytes(own[3].block) == b""
        assert all(r.version == 1 and r.ip == "127.10.100.2" and r.status is None for r in own) and own[1].mime == "text/html; charset=x"
    raw = arc2()
    for url, block in (("http://b.example/", HTTP), ("http://c.example/", OLD + b"!")):
        r = got["two.arc", url]
        assert (r.version, r.status, r.date, bytes(r.block)) == (2, "200", "199801", block) and raw[r.offset :].startswith(url.encode())


def test_converts_and_reads_back(spark, arcs, tmp_path):
    out = str(tmp_path / "warc")
    warc.arc_to_warc(spark, arcs, out, least=1)
    got = {(r.target_uri, r.record_id): r for r in warc.read_warc(spark, out).collect()}
    assert len(got) == 10 and all(r.intact for r in got.values())
    by_url = {}
    for (url, _), r in sorted(got.items()):
        by_url.setdefault(url, []).append(r)
    payload = HTTP.split(b"\r\n\r\n", 1)[1]
    same = by_url["http://a.example/"] + by_url["http://b.example/"]
    assert {r.payload_digest for r in same} == {b32(payload)} and {r.payload_length for r in same} == {len(payload)} and {r.source_id for r in same} == {"7"}
    first = [r for r in same if r.warc_type == "response"]
    assert len(first) == 1 and bytes(first[0].payload) == payload and {r.refers_to for r in same if r.warc_type == "revisit"} == {first[0].record_id}
    assert [r.warc_date for r in by_url["http://c.example/"]] == ["1998-01-01T00:00:00Z"] and bytes(by_url["http://c.example/"][0].payload) == b"none!"
    assert {r.warc_type for r in by_url["http://empty/"]} == {"resource"}  # shorter than ``least``
    assert {r.warc_type for r in by_url["dns:a.example"]} == {"resource", "revisit"}
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", r.record_id) for r in got.values())


def test_written_files_are_archives(spark, tmp_path):
    """Files as other readers see them: version blocks, exact lengths, empty lines, whole records."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é" * i) for i in range(40)], "page_id long, url string, html string").repartition(3)
    warc.write_arc(pages, str(tmp_path / "arc"))
    versions = set()
    for f in (tmp_path / "arc").glob("part-*.gz"):
        raw = gzip.decompress(f.read_bytes())
        while raw:
            line, rest = raw.split(b"\n", 1)
            n = int(line.split()[-1])
            if line.startswith(b"filedesc"):
                version, names = rest[:n].split(b"\n")[:2]
                versions.add(int(version.split()[0]))
                assert names.decode() == warc.FIELDS[int(version.split()[0])]
            assert rest[n : n + 1] == b"\n"
            raw = rest[n + 1 :]
    assert versions == {1, 2}
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    total = 0
    for f in (tmp_path / "warc").glob("part-*.gz"):
        raw = gzip.decompress(f.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while raw:
            head, rest = raw.split(b"\r\n\r\n", 1)
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            raw, total = rest[n + 4 :], total + (b"warcinfo" not in head)
    assert total == 40


EDGE = [
    (5, "http://a b\n", "same\r\n\r\n"), (3, None, "same\r\n\r\n"), (None, "", "same\r\n\r\n"), (3, "u", "same\r\n\r\n"), (10, "u", None), (11, "u", ""), (9, "u", ""), (12, "u", "\r\n\r\n\r\n"),
    (13, "u", "\r\n\r\n"), (14, "u", "HTTP/1.1 200 OK\r\nX-Page-Id: 99\r\n\r\nWARC/1.1\r\n\r\n"), (15, "u", "x" * 3_000_000), (16, "u", "x" * 3_000_000), (17, "u", "\r"), (18, "u", "\n"), (19, "u", "é\U0001f600"),
]


def test_archive_edges(spark):
    rows = [(*r, "k", 0) for r in EDGE]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, salt int").repartition(4)
    got = sorted(warc.archive_pages(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type))
    assert len(got) == len(EDGE) and all(r.intact for r in got)
    payloads = sorted(((i, (h or "").encode()) for i, _, h in EDGE), key=lambda p: (p[0] is None, p[0] or 0))
    first: dict = {}
    for i, p in payloads:
        first.setdefault(p, i)
    assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in got] == [(i, len(p), b32(p)) for i, p in payloads]
    assert sum(r.record_type == "response" for r in got) == len(first)
    for r, (i, p) in zip(got, payloads):
        assert r.refers_to == (None if r.record_type == "response" else first[p])
        assert r.record_type == "revisit" or first[p] == i
    least = warc.archive_pages(pages, least=3_000_000).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in least] == [(16, 15)]
    assert warc.archive_pages(pages.limit(0)).count() == 0
    text = pages.where("page_id >= 9").withColumn("page_id", F.col("page_id").cast("string"))
    assert {r.page_id: r.refers_to for r in warc.archive_pages(text).where("record_type = 'revisit'").collect()} == {"10": "9", "11": "9", "16": "15"}


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "cut.arc.gz").write_bytes(gzip.compress(arc1()[:-60]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_arc(spark, str(tmp_path / "cut.arc.gz")).count()
    (tmp_path / "bad.arc").write_bytes(b"no header\n")
    with pytest.raises(Exception, match="not an ARC header"):
        warc.read_arc(spark, str(tmp_path / "bad.arc")).collect()
