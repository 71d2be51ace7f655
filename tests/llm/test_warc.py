"""ARC parsing, conversion and the way of pages through archives."""

import gzip
from hashlib import sha256

import pytest

from tarnkit.llm import warc

BLOCK = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<html>\nfiledesc:// line\n</html>"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_round_trip(version, packed):
    records = [("http://a/x y", "192.0.2.7", "text/html", BLOCK), ("dns:a", "192.0.2.8", "text/dns", b"\n\n20200101\n"), ("u", "-", "t/t", b"")]
    data = warc.arc_file("some.arc", version, "20190405060708", records)
    about, *found = warc.read_arc(gzip.compress(data) if packed else data)
    assert about.version == version and about.fields["url"] == "filedesc://some.arc"
    assert [(r.fields["url"], r.block) for r in found] == [(r[0], r[3]) for r in records]
    if version == 2:
        assert found[0].fields["code"] == "404" and data[int(found[1].fields["offset"]):].startswith(b"dns:a")


def test_conversion():
    data = warc.arc_file("some.arc", 1, "20190405060708", [("http://a/", "192.0.2.7", "text/html", BLOCK), ("dns:a", "192.0.2.8", "text/dns", b"x")])
    (info, _), (page, block), (dns, content) = warc.read_warc(warc.convert_arc(data, "some.arc"))
    assert [x["warc-type"] for x in (info, page, dns)] == ["warcinfo", "response", "resource"]
    assert page["warc-date"] == "2019-04-05T06:07:08Z" and block == BLOCK and content == b"x"
    assert page["warc-payload-digest"] == "sha256:" + sha256(BLOCK.split(b"\r\n\r\n", 1)[1]).hexdigest()
    assert len({x["warc-record-id"] for x in (info, page, dns)}) == 3
    assert warc.convert_arc(data, "some.arc") == warc.convert_arc(data, "some.arc")


@pytest.mark.parametrize("broken", [b"http://a/ 1.2.3.4 2019 text/html 99\nshort", b"no header", b"a b c d e\n"])
def test_broken_archives_are_refused(broken):
    with pytest.raises(ValueError):
        list(warc.read_arc(broken))


@pytest.mark.parametrize("file_bytes", [4 << 20, 100])
def test_pages(spark, monkeypatch, file_bytes):
    long, other = "x" * 150, "é" * 60
    rows = [(1, "http://a/ b", long, 9), (2, None, long, 9), (3, "http://é/", "short", 9), (4, "u", "short", 9), (5, "u", None, 9),
            (None, "u", long, 9), (7, "u", "", 9), (8, "http://a\nb", other, 9), (9, "c", other, 9), (10, "c", "\r\n\r\nX-Page-Id: 3\r\n", 9),
            (11, "c", "y" * 3_000_000, 9), (1, "z", long, 9), (12, "c", "<html>\n" * 15, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    found = {(r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()}
    wanted = set()
    for key, _, html, _ in rows:
        first = {long: 1, other: 8}.get(html, key)
        data = (html or "").encode()
        again = key != first
        wanted.add((key, sha256(data).hexdigest(), len(data), "revisit" if again else "response", first if again else None))
    assert found == wanted


def test_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
