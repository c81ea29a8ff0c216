"""WARC: round trip and assembly."""

import gzip
import hashlib
from pathlib import Path

import pytest
from conftest import listed

from firmloom.llm.warc import assemble, build_record, capture_report, read_archive, write_archive

PAGES = [
    (1, "http://a/ü?x=\n1", "ä" * 60), (2, "http://b", "ä" * 60), (3, None, None), (4, "http://c", ""), (5, "http://d", "short"),
    (6, "http://e", "short"), (7, "http://f", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 20), (8, "http://g", "z" * 3_000_000),
    (2, "http://b", "ä" * 60), (None, "http://h", "ä" * 60), (9, "http://i", "x" * 99), (10, "http://j", "x" * 99),
    (11, "http://k", "y" * 100), (12, "http://l", "y" * 100),
]
TABLE = "page_id bigint, url string, html string, row string, digest int, part string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "r", 1, "p") for p in PAGES], TABLE).repartition(3)


@pytest.mark.parametrize("level", [0, 1])
def test_round_trip(spark, pages, level):
    manifest = write_archive(pages, level=level, file_bytes=1 << 20)
    assert manifest.agg({"records": "sum"}).first()[0] == 3 * len(PAGES)
    got = listed(capture_report(assemble(read_archive(spark, manifest))))
    want, first = [], {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        want.append((i, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, i)
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((r[5] for r in got), key=repr) == sorted((u for _, u, _ in PAGES), key=repr)


def test_payloads_come_back(spark, pages):
    captures = assemble(read_archive(spark, write_archive(pages)))
    rows = captures.selectExpr("request.http_headers as q", "response.type as kind", "response.payload as payload", "response.http_status as s").collect()
    assert len(rows) == len(PAGES) and all(r.q.startswith("GET ") and r.s == 200 for r in rows)
    kept = sorted(bytes(r.payload).decode() for r in rows if r.kind == "response")
    repeats = 4 - 1 + 2 - 1
    assert len(kept) == len(PAGES) - repeats and set(kept) == {p[2] or "" for p in PAGES}


def test_other_writers(spark, tmp_path):
    """A request may be the one that others name; parts may be missing; broken files are errors."""
    head = lambda i, to=None: [("WARC-Record-ID", i), *([("WARC-Concurrent-To", to)] if to else [])]
    http = ("Content-Type", "application/http; msgtype=response")
    records = [
        build_record("warcinfo", head("<w>"), b"software: x"), build_record("request", [*head("<q>"), http], b"GET / HTTP/1.1\r\n\r\n"),
        build_record("response", [*head("<r>", "<q>"), http], b"HTTP/1.1 404 Not Found\r\n\r\nbody"),
        build_record("metadata", head("<m>"), b"{}"),
    ]
    path = Path(tmp_path) / "a.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r) for r in records))
    frame = spark.createDataFrame([(str(path),)], "path string")
    rows = {r.capture_id: r for r in assemble(read_archive(spark, frame)).collect()}
    assert set(rows) == {"<q>", "<m>"}
    assert rows["<q>"].response.http_status == 404 and bytes(rows["<q>"].response.payload) == b"body"
    assert rows["<q>"].metadata.record_id is None and rows["<m>"].request.record_id is None
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ended before|ends early|end-of-stream"):
        read_archive(spark, frame).collect()


def test_whole_transactions(spark, tmp_path):
    """Repeated headers and chains are one capture; it does not matter in which file or order the records stand."""
    http = ("Content-Type", "application/http; msgtype=response")
    head = lambda i, *to: [*([("WARC-Record-ID", i)] if i else []), *[("WARC-Concurrent-To", t) for t in to]]
    kinds = {"q": "request", "r": "response", "m": "metadata"}
    links = {
        "<q1>": ["<r1>"], "<r1>": [], "<m1>": ["<q1>"],  # metadata -> request -> response
        "<q2>": [], "<r2>": [], "<m2>": ["<q2>", "<r2>"],  # both named by one record
        "<q3>": ["<r3>"], "<r3>": ["<q3>"], "<m3>": ["<r3>", "<r3>"],  # named both ways, and twice
        "<q4>": ["<r4>"], "<r4>": ["<m4>"], "<m4>": [],
        "<q5>": ["<gone>"], "<r5>": ["<gone>"], "<m5>": ["<m5>"],  # the named record is missing; one names itself
    }
    records = [build_record(kinds[i[1]], [*head(i, *to), http], b"HTTP/1.1 200 OK\r\n\r\n" + i.encode()) for i, to in links.items()]
    records.append(build_record("metadata", head(None), b"no identifier"))
    for n in range(2):
        (Path(tmp_path) / f"{n}.warc").write_bytes(b"".join(records[n::2][::-1]))
    frame = spark.createDataFrame([(f"{tmp_path}/{n}.warc",) for n in range(2)], "path string")
    got = assemble(read_archive(spark, frame)).selectExpr("request.record_id", "response.record_id", "metadata.record_id").collect()
    none = (None, None, "<m5>")
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(f"<q{k}>", f"<r{k}>", f"<m{k}>") for k in range(1, 5)] + [("<q5>", "<r5>", None), none], key=repr)


def test_a_hot_record(spark):
    """Thousands of records that name one record, which names another, are one capture."""
    rows = spark.range(5000).selectExpr("concat('<m', id, '>') as record_id", "'metadata' as type", "array('<q>') as concurrent_to")
    more = spark.createDataFrame([("<q>", "request", ["<r>"]), ("<r>", "response", [])], "record_id string, type string, concurrent_to array<string>")
    got = assemble(rows.unionByName(more), ["record_id", "type"]).collect()
    assert [(r.request.record_id, r.response.record_id, r.metadata.record_id) for r in got] == [("<q>", "<r>", "<m0>")]


def test_empty_archive(spark, pages):
    manifest = write_archive(pages.limit(0))
    assert capture_report(assemble(read_archive(spark, manifest))).count() == 0
