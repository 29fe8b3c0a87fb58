"""WARC archives: writing captures, reading archives, and assembling transactions.

A capture is written as three records: the request, the response (or, if a later capture has the same payload, a revisit that refers to
that one's response) and metadata. Request and metadata carry WARC-Concurrent-To, the response's record id. Reading gives one row per
record; assembly joins the records of a capture through these ids, whichever names which, into one nested row.

Archives are written by Spark's text writer, so any store that Spark knows will do and a lost task is simply run again; record ids follow
from the rows' content, so a repeated task writes the same ones. A file holds as many captures as make about FILE_BYTES at the mean
payload, RECORDS_PER_FILE at most, and is one gzip stream. Compressed archives are read as a stream, cut where a record may begin and
joined again by the records' lengths: a reading task holds a record at a time, whatever the size of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm.common import components, discard, few_join, map_arrow, stored

RECORDS_PER_FILE, FILE_BYTES = 20_000, 64 << 20
#: Records of one capture in a nested row; what is more goes into further rows of that capture.
PART = 1_000
_MARK = b"WARC/"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"

RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, content_type string, "
    "content_length long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary, fields map<string,string>"
)


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the text's UTF-8 bytes: 20 bits of the hash (5 hex digits) make 4 base32 digits."""
    digits = []
    for i in range(8):
        bits = F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_B32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _record(kind: str, own_id: Column, headers: list[Column | str], block: Column) -> Column:
    """A record without the two line ends that follow its block; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}") if kind else F.lit(None).cast("string"), F.concat(F.lit("WARC-Record-ID: "), own_id)]
    lines += [F.lit(h) if isinstance(h, str) else h for h in headers]
    return F.concat(F.concat_ws("\r\n", *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(_END), block)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes each row as request, response or revisit, and metadata.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least least_bytes bytes, the one with the largest id
    is the response and the others revisit it; rows that share that id and payload (repeated rows) are responses all. Rows without an id
    revisit one that has an id; if none has, they are responses. Line ends within a URL become spaces, a null URL is about:blank.
    An empty table makes an archive without records; further columns are not read.

    Equal payloads are found by digest over a stored table without payloads. Only digests that recur are joined to the rows, and rows that
    are the same in all columns are counted and written as often; payloads are shuffled only if there are many of either.
    """
    text, url = F.coalesce(F.col(text_col), F.lit("")), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("about:blank")), r"[\r\n]", " ")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), text.alias("text"))
    rows = rows.withColumn("digest", base32_sha1(F.col("text"))).withColumn("bytes", F.octet_length("text").cast("long")).withColumn("mark", F.xxhash64("url"))
    key = ["id", "mark", "digest"]
    slim = stored(rows.select(*key, "bytes"), "warc-rows")
    mean = slim.agg(F.avg("bytes")).first()[0] or 1
    per_file = int(max(1, min(RECORDS_PER_FILE, FILE_BYTES // max(1, mean))))
    own = F.struct("id", "mark")
    heads = stored(slim.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(own).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-heads")
    twice = stored(slim.groupBy(*key).count().where("count > 1").select(*[F.col(c).alias(f"same_{c}") for c in key]), "warc-twice")
    rows = rows.withColumn("copy", F.lit(1))
    if not twice.isEmpty():
        same = F.col("id").eqNullSafe(F.col("same_id")) & (F.col("mark") == F.col("same_mark")) & (F.col("digest") == F.col("same_digest"))
        counted = few_join(rows, twice, same, "left_semi").groupBy("id", "url", "text", "digest", "bytes", "mark").agg(F.count("*").alias("n"))
        rows = few_join(rows, twice, same, "left_anti").union(counted.select("id", "url", "text", "digest", "bytes", "mark", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
    rows = few_join(rows, heads, "digest", "left")
    name = lambda page, mark, copy, kind: F.concat(F.lit("<urn:dictspark:"), F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), F.col("digest"), F.hex(mark), copy.cast("string")), F.lit(f":{kind}>"))
    mine = lambda kind: name(F.col("id"), F.col("mark"), F.col("copy"), kind)
    first = F.col("head").isNull() | F.col("id").eqNullSafe(F.col("head.id"))
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    uri, when = F.concat(F.lit("WARC-Target-URI: "), F.col("url")), f"WARC-Date: {date}"
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), mine("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    header = [
        F.concat(F.lit("WARC-Type: "), kind),
        uri,
        when,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~first, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: "), name(F.col("head.id"), F.col("head.mark"), F.lit(1), "response"))),
        "Content-Type: application/http; msgtype=response",
    ]
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    page = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = [
        _record("request", mine("request"), [concurrent, uri, when, "Content-Type: application/http; msgtype=request"], get),
        _record("", mine("response"), header, F.concat(http, F.when(first, F.col("text")).otherwise(F.lit("")))),
        _record("metadata", mine("metadata"), [concurrent, uri, when, "Content-Type: application/warc-fields"], page),
    ]
    value = F.concat_ws(_END, *records)  # the writer ends the last record
    rows.select(value.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    discard(slim, heads, twice)


class _Unframed(ValueError):
    pass


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive. Raises ValueError on a damaged one."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise _Unframed(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise _Unframed("the archive ends within a record's headers")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:  # a folded header
                headers[last][-1] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers.setdefault(last, []).append(value.strip())
        length = int(headers.get("content-length", ["0"])[0])
        block = stream.read(length)
        if len(block) < length:
            raise _Unframed("the archive ends within a record's block")
        yield headers, block


class Chunks:
    """What parse() reads, from pieces of bytes as they come."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        for piece in self.pieces:
            self.held, self.at = self.held[self.at :] + piece, 0
            return True
        return False

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held) - 1
                break
        out, self.at = self.held[self.at : end + 1], end + 1
        return out

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while missing > len(self.held) - self.at:
            parts.append(self.held[self.at :])
            missing -= len(parts[-1])
            self.held, self.at = next(self.pieces, b""), 0
            if not self.held:
                return b"".join(parts)
        parts.append(self.held[self.at : self.at + missing])
        self.at += missing
        return b"".join(parts)


def _joined(fragments: Iterator[bytes]) -> Iterator[bytes]:
    """What the reader took away as the end of each piece but the last is put between them."""
    for i, x in enumerate(fragments):
        if joined := _MARK + x if i else x:
            yield joined


def _row(headers: dict[str, list[str]], block: bytes, keep: bool) -> tuple:
    first = lambda k: headers.get(k, [None])[0]
    kind, media = first("warc-type"), first("content-type") or ""
    fields: dict[str, str] = {}
    body, size = block, len(block)
    if media.startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, s, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if s}
        size = len(body)
    elif media.startswith("application/warc-fields"):
        fields = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, s, v in (x.partition(b":") for x in block.splitlines()) if s}
    stated = first("warc-payload-digest")
    if kind == "revisit":  # the payload is elsewhere: its size is the HTTP header's, its digest the record's
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        digest, ok = (stated or "").rpartition(":")[2] or None, None
    else:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ok = None if stated is None or not stated.startswith("sha1:") else stated == f"sha1:{digest}"
    return first("warc-record-id"), kind, first("warc-target-uri"), first("warc-date"), headers.get("warc-concurrent-to", []), first("warc-refers-to"), media or None, len(block), size, digest, ok, body if keep and kind != "revisit" else None, list(fields.items())


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record (RECORD_SCHEMA) of the archives in path; without payload, that column is null. payload_bytes and payload_digest
    are those of the full payload, for revisits as the record states them; digest_ok tells whether a stated SHA-1 digest holds.

    Archives whose names end in .gz (one gzip member or, as is usual, one per record) are read as streams; others are read whole, which
    Spark does up to 2 GB each."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [x.strip().split(" ")[0] for x in RECORD_SCHEMA.replace("map<string,string>", "map").split(",")]

    def rows_of(stream) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for headers, block in parse(stream):
            rows.append(_row(headers, block, payload))
            held += len(block) if payload else 0
            if len(rows) >= 5_000 or held >= 1 << 23:
                yield made()
                rows, held = [], 0
        if rows:
            yield made()

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = ((f, x.as_py()) for b in batches for f, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for _, own in groupby(fragments, key=lambda x: x[0]):
            yield from rows_of(Chunks(_joined(x for _, x in own)))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from rows_of(io.BytesIO(content.as_py()))

    cut = spark.read.option("lineSep", _MARK.decode()).option("pathGlobFilter", "*.gz").text(path)
    cut = cut.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).where("length > 0").select("content")
    return map_arrow(cut, streams, RECORD_SCHEMA).union(plain.mapInArrow(wholes, RECORD_SCHEMA))


def _roots(rows: DataFrame) -> DataFrame | None:
    """id and root for the ids that several records share only through each other: those that name further ids, and those that are named and
    name others themselves. None if there are none, as in archives where all records of a capture name the same one."""
    named = rows.where(F.size("named") > 0)
    several = named.where(F.size("named") > 1).select(F.get("named", F.lit(0)).alias("a"), F.explode(F.expr("slice(named, 2, size(named) - 1)")).alias("b"))
    targets = named.select(F.explode("named").alias("record_id")).distinct()
    both = named.select("record_id", F.get("named", F.lit(0)).alias("b")).join(targets, "record_id", "left_semi").select(F.col("record_id").alias("a"), "b")
    links = stored(several.union(both).where("a <> b").distinct(), "warc-links")
    if links.isEmpty():
        return None
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("node", F.xxhash64("id"))
    labels = components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), "warc-cc")
    known = ids.join(labels, "node")
    return stored(known.join(known.groupBy("label").agg(F.min("id").alias("whole")), "label").select("id", "whole"), "warc-roots")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: root (an id that its records share), part (from 0), requests, responses (response, revisit or resource)
    and metadata, arrays of the records with all their columns, by record id; other records are left out.

    The records of a capture are those that WARC-Concurrent-To joins, in any direction, over any number of such headers and steps. Where all
    of them name the same record (or nothing), that is one shuffle by its id; the ids that need it are joined up by components first (of
    64-bit hashes). Records whose partner is missing form a capture of their own, and a record without an id stands alone. A capture of
    more than PART records comes in parts. records is read several times: a stored table is best.
    """
    rows = records.withColumn("named", F.array_sort(F.array_distinct(F.filter("concurrent_to", lambda x: x.isNotNull()))))
    rows = rows.withColumn("root", F.coalesce(F.get("named", F.lit(0)), F.col("record_id")))
    if (whole := _roots(rows.select("record_id", "named"))) is not None:
        rows = few_join(rows, whole.withColumnRenamed("id", "root"), "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    rows = rows.withColumn("key", F.coalesce("root", F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"))))
    large = stored(rows.where("root IS NOT NULL").groupBy(F.col("root").alias("key")).count().where(F.col("count") > PART), "warc-large")
    rows = few_join(rows, large, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("record_id"), F.ceil(F.col("count") / PART)), F.lit(0)).cast("int"))
    every = F.struct(*[F.col(c) for c in records.columns])
    of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("type").isin(*kinds), F.struct(F.col("record_id").alias("o"), every.alias("r")))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    kinds = {"requests": ("request",), "responses": ("response", "revisit", "resource"), "metadata": ("metadata",)}
    nested = rows.groupBy("key", "part").agg(F.first("root").alias("root"), *[F.transform(of(*own), lambda x: x["r"]).alias(name) for name, own in kinds.items()])
    return nested.select("root", "part", *kinds)


def captures_of_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture that write_pages wrote to path: a row for each row it
    was given, repeated ones and those without an id (null) included; none from an archive without records. refers_to is the page of the
    record that a revisit refers to, which is looked up by its id."""
    records = read_records(spark, path, payload=False).select("record_id", "type", "concurrent_to", "refers_to", "payload_bytes", "payload_digest", "fields")
    made = assemble(stored(records, "warc-records"))
    as_long = lambda c: F.when(c != "", c).cast("long")
    page = as_long(F.element_at(F.get("metadata", F.lit(0)).getField("fields"), "page-id"))
    flat = made.select(page.alias("page_id"), F.get("responses", F.lit(0)).alias("r")).where("r IS NOT NULL")
    flat = stored(flat.select("page_id", "r.record_id", "r.payload_bytes", "r.payload_digest", F.col("r.type").alias("record_type"), F.col("r.refers_to").alias("named")), "warc-captures")
    heads = flat.where("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"))
    own = ("page_id", "payload_bytes", "payload_digest", "record_type")
    revisits = flat.where("record_type = 'revisit'").select(*own, "named").join(heads, "named", "left").select(*own, "refers_to")
    return flat.where("record_type <> 'revisit'").select(*own, F.lit(None).cast("long").alias("refers_to")).union(revisits)
