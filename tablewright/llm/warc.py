"""WARC archives: writing, reading back, and revisit resolution by payload digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.workspace import scratch_path, staged

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 100
#: Records of one archive file. A file is read by one task, record by record.
RECORDS_PER_FILE = 2000
#: Date of fresh headers where the caller has none.
DATE = "2024-01-01T00:00:00Z"
#: Payloads that one batch of the reader holds, in bytes.
BATCH_BYTES = 1 << 24

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "stated_digest string, payload_bytes long, payload_digest string, payload binary"
)


def resolve(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records (id long, url string, payload string) with payload_digest, payload_bytes, record_type and refers_to.

    Of equal payloads of at least `least_bytes` bytes, the one with the smallest id is
    the response; the others revisit it. Records repeated with that same id, and
    records without an id, are responses too. A null payload is empty.

    Only (digest, id) are grouped by digest, combined before the shuffle; a digest
    that a third of all records share is one row there. Repeated digests are written
    before the join back to the headers, so that no aggregate keeps Spark from
    splitting its large partitions. Payloads move once, dealt out by id and digest,
    which no copies share.
    """
    whole = records.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    whole = whole.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    headers = whole.filter(F.col("payload_bytes") >= least_bytes).select("id", "payload_digest")
    first = headers.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter("refers_to < last")
    revisits = headers.join(staged(first.drop("last"), "digests"), "payload_digest").filter("id > refers_to").distinct()
    joined = whole.join(revisits, ["id", "payload_digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """One gzipped WARC record for each row, with fresh headers; a revisit has headers only.

    The line separator of Spark's text sink is the blank lines that end a record, so
    the sink writes archives through any file system, and commits whole files only.
    """
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2)
    )
    stored = F.col("record_type") == "response"
    block = F.concat(http, F.when(stored, F.col("payload")).otherwise(""))
    kind = F.when(stored, "response").otherwise("revisit")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.concat(F.lit(f"WARC/1.1{_END}WARC-Type: "), kind),
        F.lit(f"WARC-Date: {date}"),
        _line("WARC-Record-ID: ", _urn("id")),
        _line("WARC-Target-URI: ", url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(~stored, F.concat(F.lit(f"WARC-Profile: {_PROFILE}{_END}WARC-Refers-To: "), _urn("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(_END, *lines), F.lit(_END * 2), block)
    sink = resolved.select(record.alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip")
    sink.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files (gzipped or not) in a folder; digest and length are of the payload as read.

    Records are cut by their stated length, so payloads may hold anything. The payload
    is what follows the HTTP headers of a response, else the block; `payloads=False`
    leaves it null. Cut-off archives raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, body in _records(content.as_buffer()):
                    payload = body.partition(b"\r\n\r\n")[2] if b"msgtype=" in head.get(b"content-type", b"") else body
                    rows.append(
                        (
                            _text(head, b"warc-record-id"),
                            _text(head, b"warc-type"),
                            _text(head, b"warc-target-uri"),
                            _text(head, b"warc-refers-to"),
                            _text(head, b"warc-payload-digest"),
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            payload if payloads else None,
                        )
                    )
                    size += len(payload) if payloads else 200
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _READ)


def full_records(read: DataFrame) -> DataFrame:
    """Of `read_archives`, one row for each record: id, record_type, refers_to, and digest and length of the full payload.

    A revisit takes both from the response it refers to, found by a join of headers on
    the record id and the digest that both state, so responses with different payloads
    under one id are told apart; equal ones count once. A revisit without such a
    response has neither. The headers are written first and so read from the archives
    once; a response that a third of all records revisit is split by Spark.
    """
    head = staged(
        read.select(
            _id("record_id").alias("id"), "record_type", _id("refers_to").alias("refers_to"), "stated_digest", "payload_bytes", "payload_digest"
        ),
        "headers",
    )
    stored = head.filter("record_type = 'response'")
    again = head.filter("record_type = 'revisit'").select("id", "record_type", "refers_to", "stated_digest")
    asked = again.select(F.col("refers_to").alias("id"), "stated_digest").distinct()
    seen = stored.join(asked, ["id", "stated_digest"]).groupBy(F.col("id").alias("refers_to"), "stated_digest").agg(
        F.min(F.struct("payload_bytes", "payload_digest")).alias("p")
    )
    again = again.join(staged(seen, "responses"), ["refers_to", "stated_digest"], "left")
    again = again.select("id", "record_type", "refers_to", "p.payload_bytes", "p.payload_digest")
    stored = stored.select("id", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    return stored.unionByName(again)


def deduplicate(records: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the records (id, url, payload) as deduplicated archives and reads them back as `full_records`."""
    path = path or scratch_path(records.sparkSession, "warc")
    write_archives(resolve(records), path)
    return full_records(read_archives(records.sparkSession, path, payloads=False))


def _urn(column: str) -> Column:
    return F.concat(F.lit("<urn:record:"), F.col(column).cast("string"), F.lit(">"))


def _id(column: str) -> Column:
    return F.expr(f"try_cast(substring({column}, 13, length({column}) - 13) as long)")


def _line(name: str, value: Column) -> Column:
    """Null, and so left out, if the value is null."""
    return F.concat(F.lit(name), value)


def _text(head: dict[bytes, bytes], name: bytes) -> str | None:
    value = head.get(name)
    return None if value is None else value.decode("utf-8", "replace")


def _records(content: pa.Buffer) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (names in lower case) and block of each record of one file, one at a time."""
    raw, buffer, at = _inflated(content), bytearray(), 0

    def have(n: int) -> bool:
        while len(buffer) - at < n:
            more = next(raw, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while have(2) and buffer[at : at + 2] == b"\r\n":
            at += 2
        if not have(1):
            return
        looked = at
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            looked = max(at, len(buffer) - 3)
            if not have(len(buffer) - at + 1):
                raise ValueError("an archive ends inside a record's headers")
        first, *lines = bytes(buffer[at:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(head[b"content-length"])
        at = end + 4
        if not have(size):
            raise ValueError("an archive ends inside a record's block")
        yield head, bytes(buffer[at : at + size])
        del buffer[: at + size]
        at = 0


def _inflated(content: pa.Buffer) -> Iterator[bytes]:
    """The content in pieces; any number of gzip members are undone."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20))
        return
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a gzip member")
            piece = view[at : at + (1 << 18)]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)
