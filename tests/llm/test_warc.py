"""WARC archives: exact round trips and assembly of foreign records."""

import base64
import hashlib
import io

import pytest

from kwhlens.llm import warc
from tests.llm.conftest import rows

PAGES = [
    (5, "http://a.example/x?y#z", "<p>same</p>"),
    (3, "http://a.example/é", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "http://b.example", None),
    (2, "http://b.example/\r\nX: y", ""),
    (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "u", "é" * 100000 + "\x00\r\n\r\n"),
    (None, "u", "nobody"),
    (11, "u", "twice"),
    (11, "u", "twice"),
]


def want(pages, least=0):
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for p, _, t in pages:
        if p is not None and len((t or "").encode()) >= least:
            first[sha(t)] = min(first.get(sha(t), p), p)
    out = []
    for p, _, t in pages:
        f = first.get(sha(t))
        again = f is not None and f != p
        out.append((p, len((t or "").encode()), sha(t), "revisit" if again else "response", f if again else None))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES],
                                 "page_id long, url string, html string, digest string, record_id string")


@pytest.mark.parametrize("least,size,few", [(0, 1 << 20, 200_000), (10, 50, 200_000), (0, 1 << 20, 0)])
def test_round_trip(spark, pages, folder, least, size, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    names = warc.write_pages(pages.repartition(3), folder, min_bytes=least, file_bytes=size)
    captures = warc.assemble(warc.read_records(spark, folder, names))
    assert captures.count() == len(PAGES)
    assert rows(warc.page_summary(captures)) == want(PAGES, least)
    r = captures.where("response.target_uri like '%x?y%'").first()
    assert bytes(r.request.payload) == b"" and r.response.payload is not None and len(r.metadata) == 1


def test_empty_table(spark, pages, folder):
    names = warc.write_pages(pages.where("page_id < 0"), folder)
    assert names == []
    assert warc.page_summary(warc.assemble(warc.read_records(spark, folder, names))).count() == 0


def test_archives_follow_the_format(pages, folder):
    import gzip

    names = warc.write_pages(pages.repartition(1), folder)
    raw = gzip.open(f"{folder.removeprefix('file://')}/{names[0]}").read()
    plain = list(warc.parse(io.BytesIO(raw), False))
    assert [h["warc-type"] for h, _ in plain][:4] == ["warcinfo", "request", "response", "metadata"] or len(plain) == 31
    assert all(len(b) == int(h["content-length"]) for h, b in plain)


def test_links_in_any_direction(spark):
    def rec(i, kind, to):
        return (i, kind, to.split() if to else [], "u", "d", None, "c", b"p", 1, None)

    records = spark.createDataFrame([
        rec("r1", "response", "q1"), rec("q1", "request", None), rec("m1", "metadata", "q1"),
        rec("r2", "response", None), rec("q2", "request", "r2"), rec("m2", "metadata", "r2"), rec("m3", "metadata", "r2"),
        rec("m4", "metadata", "lost"), rec("q5", "request", None), rec("w", "warcinfo", None)], warc.RECORD_SCHEMA)
    got = {r.capture_id: (r.response and r.response.record_id, r.request and r.request.record_id,
                          [m.record_id for m in r.metadata or []]) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("r1", "q1", ["m1"]), "r2": ("r2", "q2", ["m2", "m3"]), "lost": (None, None, ["m4"]),
                   "q5": (None, "q5", [])}


def test_repeated_links(spark):
    """Concurrent-to may be repeated: a request of two captures is in both, and a capture keeps its further requests."""
    def rec(i, kind, *to):
        return (i, kind, list(to), "u", "d", None, "c", b"p", 1, None)

    records = spark.createDataFrame([
        rec("r1", "response"), rec("r2", "response", "q3", "q4"), rec("q1", "request", "r1", "r2"), rec("q3", "request"),
        rec("q4", "request"), rec("m1", "metadata", "r1", "q3"), rec("m2", "metadata", "q1")], warc.RECORD_SCHEMA)
    got = {r.capture_id: (r.request.record_id, [q.record_id for q in r.more_requests], [m.record_id for m in r.metadata])
           for r in warc.assemble(records).collect()}
    assert got == {"r1": ("q1", [], ["m1", "m2"]), "r2": ("q1", ["q3", "q4"], ["m1", "m2"])}


def test_repeated_headers_are_read():
    import io

    raw = (b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Concurrent-To: <urn:a>\r\nwarc-concurrent-to: <urn:b>\r\n"
           b"Content-Length: 2\r\n\r\nhi\r\n\r\n")
    (head, block), = warc.parse(io.BytesIO(raw), False)
    assert head["warc-concurrent-to"].split() == ["<urn:a>", "<urn:b>"] and block == b"hi"
