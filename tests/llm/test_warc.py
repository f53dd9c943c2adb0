import gzip
import hashlib

import pytest

from oddsmith.llm import common, warc


def test_arc_versions_and_gzip():
    for version in (1, 2):
        parts = [warc.arc_version_block(version)]
        blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nfiledesc://x 1 2 3 4\n", b"", b"plain\n", "é".encode()]
        parts += [warc.arc_record(version, "http://a/ b", b, "20010203040506", content_type="text/html; charset=x") for b in blocks]
        for data in (b"".join(parts), b"".join(gzip.compress(p) for p in parts)):
            got = list(warc.parse_arc(data))
            assert [r.block for r in got[1:]] == blocks and {r.version for r in got} == {version}
            assert got[1].fields["url"] == "http://a/%20b" and got[1].fields["content_type"] == "text/html; charset=x"
            assert [warc.warc_type(r) for r in got] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("2001") == "2001-01-01T00:00:00Z"


def test_only_the_first_record_is_a_version_block():
    page = warc.arc_record(1, "filedesc://x", b"HTTP/1.1 200 OK\r\n\r\nx", "20010203040506", content_type="text/plain")
    got = list(warc.parse_arc(warc.arc_version_block(1) + page))
    assert [warc.warc_type(r) for r in got] == ["warcinfo", "response"]
    page = warc.arc_record(1, "filedesc://x", b"HTTP/1.1 200 OK\r\n\r\nx", "20010203040506")
    assert [warc.warc_type(r) for r in warc.parse_arc(page)] == ["response"]


@pytest.mark.parametrize("bad", [b"http://a 0.0.0.0 20010101000000 text/html 9\nshort", b"http://a 0 text/html 0\n\n", b"no end", b"a b c d x\n"])
def test_damaged_archives_are_errors(bad):
    with pytest.raises(ValueError):
        list(warc.parse_arc(bad))


def expected(rows):
    sha = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, (_, _, h, _) in enumerate(rows)}
    best = {}
    for i, (page, _, h, _) in enumerate(rows):
        if page is not None and len((h or "").encode()) >= 1000:
            best[sha[i]] = max(best.get(sha[i], page), page)
    out = []
    for i, (page, _, h, _) in enumerate(rows):
        first = best.get(sha[i])
        again = first is not None and first != page
        out.append((page, len((h or "").encode()), sha[i], "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_pages_there_and_back(spark, version):
    rows = [(r.page_id, r.url, r.html, "x") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    big = "ü" * 500
    rows += [(901, "http://a b", big, None), (905, None, big, None), (903, "", big, "z"), (905, None, big, None), (None, "u", big, None), (906, "s", "ü" * 499, None), (907, "s", "ü" * 499, None), (908, None, None, None), (909, "v", "", None), (910, "w\r\nWARC/1.1", "WARC/1.1\r\n\r\n" * 200000, None), (911, "filedesc://x", "a page", None), (912, "filedesc:", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.convert_pages(pages, common.fresh_path(spark, "warc"), version).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got), key=str) == expected(rows)
    ids = {r.record_id: r for r in got}
    assert all(ids[r.refers_to_id].kind == "response" and ids[r.refers_to_id].page_id == r.refers_to for r in got if r.kind == "revisit")
    assert warc.convert_pages(pages.limit(0), common.fresh_path(spark, "warc"), version).count() == 0
