import base64
import gzip
import hashlib
import io

import pytest

from dictspark.llm import warc
from tests.llm.helpers import rng


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, rows, tmp_path, least=0, extra=False):
    from tests.llm.helpers import clashing

    df = pages(spark, rows)
    warc.write_pages(clashing(df) if extra else df, str(tmp_path / "w"), least_bytes=least)
    return sorted(map(tuple, warc.captures_of_pages(spark, str(tmp_path / "w")).collect()), key=repr)


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == body and j is not None]
        head = max(same, default=None) if len(body) >= least else i
        kind = "response" if head == i else "revisit"
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, head if kind == "revisit" else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (2, "http://b/", "same"), (3, None, "same"), (4, "http://b/\r\nX: y", "same"),
    (5, "http://c/", None), (6, "http://c/", ""), (7, "http://d/", "x" * 300_000), (8, "", "\r\n\r\n"),
    (9, "http://e/", "中" * 1000), (-5, "http://f/", "minus"), (11, "u", "\n"), (12, "u", "a\0b"),
]


def test_round_trip(spark, tmp_path):
    assert round_trip(spark, ROWS, tmp_path, extra=True) == brute(ROWS)


def test_small_payloads_may_stay_whole(spark, tmp_path):
    assert round_trip(spark, ROWS, tmp_path, least=5) == brute(ROWS, 5)


def test_repeated_rows_and_no_ids(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "u", "own"), (3, "u", "x"), (3, "u", "x")]
    assert round_trip(spark, rows, tmp_path) == brute(rows)


def test_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    assert round_trip(spark, ROWS, tmp_path) == brute(ROWS)
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 3


def test_empty(spark, tmp_path):
    warc.write_pages(pages(spark, []), str(tmp_path / "w"))
    assert warc.captures_of_pages(spark, str(tmp_path / "w")).collect() == []


def test_nested_rows_and_payloads(spark, tmp_path):
    warc.write_pages(pages(spark, ROWS), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(ROWS)
    assert records.select("record_id").distinct().count() == 3 * len(ROWS)
    made = warc.assemble(records).collect()
    assert len(made) == len(ROWS)
    text = {i: (h or "").encode() for i, _, h in ROWS}
    for c in made:
        i = int(c["metadata"][0]["fields"]["page-id"])
        (request,), (response,), (metadata,) = c["requests"], c["responses"], c["metadata"]
        assert request["concurrent_to"] == metadata["concurrent_to"] == [response["record_id"]] and c["root"] == response["record_id"] and c["part"] == 0
        if response["type"] == "response":
            assert bytes(response["payload"]) == text[i] and response["digest_ok"]
        else:
            assert response["payload"] is None


def record(kind, own, block, *more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + own + b">", *more, b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """A member per record; the response names the request, the metadata the request, a folded header, a warcinfo and binary bytes."""
    parts = [
        record(b"warcinfo", b"i", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        record(b"request", b"q", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http"),
        record(b"response", b"r", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\x00\r\n\r\nz", b"WARC-Concurrent-To: <q>", b"Content-Type: application/http;", b" msgtype=response"),
        record(b"metadata", b"m", b"k: v\r\n", b"WARC-Concurrent-To: <r>", b"Content-Type: application/warc-fields"),
        record(b"resource", b"alone", b"abc"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(record(b"response", b"late", b"x"))
    records = warc.read_records(spark, str(tmp_path))
    by = {r["record_id"]: r for r in records.collect()}
    assert bytes(by["<r>"]["payload"]) == b"\xff\x00\r\n\r\nz" and by["<r>"]["fields"] == {"a": "b"} and len(by) == 6
    whole = {c["root"]: c for c in warc.assemble(records).collect()}
    got = lambda c: [[r["record_id"] for r in c[k]] for k in ("requests", "responses", "metadata")]
    assert {k: got(c) for k, c in whole.items()} == {"<q>": [["<q>"], ["<r>"], ["<m>"]], "<alone>": [[], ["<alone>"], []], "<late>": [[], ["<late>"], []], "<i>": [[], [], []]}


def table(spark, rows):
    full = [(i, kind, None, None, list(to), None, None, 0, 0, None, None, None, {}) for i, kind, to in rows]
    return spark.createDataFrame(full, warc.RECORD_SCHEMA)


def test_records_that_name_each_other(spark):
    """Mutual naming, several headers, long chains, missing partners, null ids and a second response: components over all ids."""
    chain = [(f"c{i}", "metadata", [f"c{i + 1}"]) for i in range(20)]
    given = [("q1", "request", ["r1"]), ("r1", "response", ["q1"]), ("q2", "request", ["r2"]), ("r2", "response", ["q2"]), ("m2", "metadata", ["q2", "r2", "r2"])]
    given += [("a", "metadata", ["x", "y"]), ("b", "metadata", ["y", "z"]), ("c", "request", ["z"]), ("d", "response", ["gone"]), (None, "resource", []), (None, "resource", []), (None, "metadata", ["d"])]
    given += [("self", "response", ["self"]), ("two", "response", ["one"]), ("one", "response", []), ("null", "request", [None])] + chain
    got = sorted([sorted(r["record_id"] or "" for k in ("requests", "responses", "metadata") for r in c[k]) for c in warc.assemble(table(spark, given)).collect()])
    want = [["q1", "r1"], ["m2", "q2", "r2"], ["a", "b", "c"], ["", "d"], [""], [""], ["self"], ["one", "two"], ["null"], sorted(x for x, _, _ in chain)]
    assert got == sorted(want)
    assert warc.assemble(table(spark, [])).collect() == []


def test_large_captures_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART", 10)
    given = [(f"m{i}", "metadata", ["r"]) for i in range(95)] + [("r", "response", []), ("s", "response", [])]
    out = warc.assemble(table(spark, given)).collect()
    assert sorted(r["record_id"] for c in out for r in [*c["responses"], *c["metadata"]]) == sorted(x for x, _, _ in given)
    assert {c["root"] for c in out} == {"r", "s"} and len({(c["root"], c["part"]) for c in out}) == len(out) > 5


def test_marks_within_payloads_and_several_files(spark, tmp_path):
    """Payloads that hold what a record begins with, at every place, in files of one and of several gzip members that one task reads."""
    marks = ["WARC/", "WARC/1.1\r\n", "WWARC/ARC/WARC/", "WARC/" * 50, "xWARC", "/"]
    blocks = {f"{f}-{i}": (m + "y" * (i % 3)).encode() for f in range(4) for i, m in enumerate(marks)}
    for f in range(4):
        parts = [record(b"resource", f"{f}-{i}".encode(), blocks[f"{f}-{i}"]) for i in range(len(marks))]
        (tmp_path / f"{f}.warc.gz").write_bytes(gzip.compress(b"".join(parts)) if f % 2 else b"".join(map(gzip.compress, parts)))
    (tmp_path / "plain.warc").write_bytes(record(b"resource", b"plain", b"WARC/1.1\r\n\r\n"))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    got = {r["record_id"].strip("<>"): bytes(r["payload"]) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {**blocks, "plain": b"WARC/1.1\r\n\r\n"}


def test_chunks():
    r = rng(3)
    data = bytes(r.choice(b"ab\n") for _ in range(500))
    for _ in range(50):
        cuts = sorted(r.randrange(501) for _ in range(9))
        one, two = io.BytesIO(data), warc.Chunks(iter([x for a, b in zip([0, *cuts], [*cuts, 500], strict=True) if (x := data[a:b])]))
        for _ in range(60):
            n = r.randrange(30)
            assert one.read(n) == two.read(n) if r.random() < 0.5 else one.readline() == two.readline()


@pytest.mark.parametrize("data", [b"HTTP/1.1", b"WARC/1.0\r\nA: b\r\n", record(b"x", b"y", b"abc")[:-8]])
def test_damaged_archives_are_told(data):
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(data)))
