"""WARC archives as tables of chunks: oversized payloads are written and read as rows of record id and segment number.

A payload is cut into segments of at most ``CHUNK`` bytes; each is a WARC record of its own (``WARC-Segment-Number``, the
later ones of type ``continuation``), so no record is ever whole in a buffer beside its cell. Every segment carries the SHA-256
of the payload up to its end, which the reader checks with a digest of its own that goes on from segment to segment.

Archives are written by Spark's text writer: a row is one record, the line separator is the record separator, and Spark's commit
protocol takes care of lost executors. A file has at most ``RECORDS`` records, hence at most ``RECORDS * CHUNK`` bytes
before compression. The reader cuts a file by the records' ``Content-Length``, so a payload may hold any bytes.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.llm.common import raw
from allelio.operators.joins import lookup_join
from allelio.session import scratch_path

#: Bytes of payload in one segment; records in one file.
CHUNK, RECORDS = 1 << 16, 4096
#: Payloads of fewer bytes are always written whole, never as a revisit.
LEAST = 100
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENTS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, segment int, segments int, running_digest string, content binary"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("segment", pa.int32()), ("segments", pa.int32()), ("running_digest", pa.string()), ("content", pa.binary()),
    ]
)
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, intact boolean"


def roles(pages: DataFrame, payload: str = "html", least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, refers_to``: rows to write, null ``refers_to`` for responses.

    Of equal payloads of at least ``least`` bytes the smallest id is the response; rows that repeat that id are responses too, and
    rows without id revisit it. Where no row of a group has an id, all are responses. Digests are counted with partial sums and only
    those that occur again are joined back, salted if they are many, so a payload of a third of all pages is in no single task.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), raw(payload).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
        .drop("n")
    )
    joined = lookup_join(rows, firsts, "payload_digest", "left", stage=True)
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _header(lines: list[tuple[str, object]]) -> bytes:
    # A line break inside a value (a broken url) would end the header.
    clean = (f"{k}: {' '.join(str(v).split())}" for k, v in lines if v is not None)
    return "\r\n".join(["WARC/1.1", *clean]).encode("utf-8", "replace") + END


def records_of(record_id: str, page_id, url, payload: bytes, digest: str, refers_to) -> Iterator[bytes]:
    """A page's records, one per segment, each without the closing separator."""
    kind = "revisit" if refers_to is not None else "response"
    body = memoryview(b"" if refers_to is not None else payload)
    n = max(1, -(-len(body) // CHUNK))
    running = hashlib.sha256()
    for k in range(n):
        part = body[k * CHUNK : (k + 1) * CHUNK]
        running.update(part)
        head = [
            ("WARC-Type", kind if k == 0 else "continuation"),
            ("WARC-Record-ID", f"<{record_id}>" if k == 0 else f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{k}').urn}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", url or None),
            ("WARC-Payload-Digest", f"sha256:{digest}" if k == 0 else None),
            ("WARC-Profile", PROFILE if kind == "revisit" else None),
            ("WARC-Segment-Number", k + 1 if n > 1 else None),
            ("WARC-Segment-Origin-ID", f"<{record_id}>" if k else None),
            ("WARC-Segment-Total-Length", len(payload) if n > 1 and k == n - 1 else None),
            ("X-Page-ID", page_id),
            ("X-Refers-To-Page-ID", refers_to),
            ("X-Payload-Length", len(payload)),
            ("X-Segments", n),
            ("X-Running-Digest", f"sha256:{running.copy().hexdigest()}"),
            ("Content-Type", "text/html"),
            ("Content-Length", len(part)),
        ]
        yield _header(head) + bytes(part)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``size`` bytes of binary columns."""
    held, some = 0, []
    for row in rows:
        some.append(row)
        held += 256 + sum(len(v) for v in row if isinstance(v, bytes))
        if held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            held, some = 0, []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def write(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the result of ``roles`` as archives below ``path``."""
    schema = pa.schema([("record", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            at = 0
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
                for i in range(batch.num_rows):
                    page, url, payload, digest, refers = (c[i].as_py() for c in columns)
                    # Repeated rows get ids of their own by their place.
                    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{at}/{page}/{digest}").urn
                    at += 1
                    for record in records_of(key, page, url, payload, digest, refers):
                        yield (record,)

        yield from _batched(found(), schema)

    records = rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(cut, "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)


class _Unzipped(io.RawIOBase):
    """The bytes of a gzip file or of a plain one, a piece at a time."""

    def __init__(self, content: bytes):
        self.rest = memoryview(content)
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.zip is None:
                part, self.rest = self.rest[: len(buffer)], self.rest[len(buffer) :]
            else:
                if self.zip.eof:
                    unused = self.zip.unused_data
                    if not unused:
                        return 0
                    self.rest, self.zip = memoryview(unused), zlib.decompressobj(31)
                pending = self.zip.unconsumed_tail
                if pending:
                    part = self.zip.decompress(pending, len(buffer))
                else:
                    piece, self.rest = self.rest[: 1 << 16], self.rest[1 << 16 :]
                    if not piece:
                        return 0
                    part = self.zip.decompress(piece, len(buffer))
                    if not part:
                        continue
            buffer[: len(part)] = part
            return len(part)


def parse(content: bytes) -> Iterator[tuple]:
    """Segments of one archive file, in the columns of ``SEGMENTS``."""
    file = io.BufferedReader(_Unzipped(content), 1 << 18)
    while first := file.readline():
        if first.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"no WARC record where one should start: {first[:40]!r}")
        head = {}
        while (line := file.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b": ")
            head[name.decode()] = value.decode("utf-8", "replace")
        length = int(head["Content-Length"])
        body = file.read(length)
        if len(body) != length or file.read(len(END)) != END:
            raise ValueError(f"record {head['WARC-Record-ID']} is cut off")
        number = lambda name: int(head[name]) if name in head else None
        origin = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]).strip("<>")
        digest = head["WARC-Payload-Digest"].partition(":")[2] if "WARC-Payload-Digest" in head else None
        running = head["X-Running-Digest"].partition(":")[2]
        yield origin, number("X-Page-ID"), head["WARC-Type"], number("X-Refers-To-Page-ID"), number("X-Payload-Length"), digest, number("WARC-Segment-Number") or 1, number("X-Segments"), running, body


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below ``path``: one row per record id and segment number, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batched(parse(content.as_py()), _ARROW)

    # One file per batch: its size is bounded by the writer.
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, SEGMENTS)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record from its segments in order; holds one digest state, never a payload."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int32()), ("intact", pa.bool_())]
    )

    def found() -> Iterator[tuple]:
        state, now = hashlib.sha256(), None
        seen, ok, first = 0, True, None
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                if row[0] != now:
                    if first is not None and seen < first[7]:
                        yield first[1], first[4], first[5], first[2], first[3], seen, False
                    state, now, seen, ok, first = hashlib.sha256(), row[0], 0, True, row
                state.update(row[9])
                seen += 1
                ok = ok and row[6] == seen and state.hexdigest() == row[8]
                if seen == row[7]:
                    whole = first[2] == "revisit" or state.hexdigest() == first[5]
                    # A response's digest is that of the bytes read; a revisit has none and names that of its payload.
                    digest = first[5] if first[2] == "revisit" else state.hexdigest()
                    yield first[1], first[4], digest, first[2], first[3], seen, ok and whole
        if first is not None and seen < first[7]:
            yield first[1], first[4], first[5], first[2], first[3], seen, False

    yield from _batched(found(), schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page read from the archives: the columns of ``RESULT``.

    Records of one segment are checked where they are read; only segments of oversized ones are shuffled by record id and sorted, so
    that their digest runs on from one to the next.
    """
    segments = read_segments(spark, path)
    alone = segments.filter("segments = 1").mapInArrow(_verified, RESULT)
    several = segments.filter("segments > 1").repartition("record_id").sortWithinPartitions("record_id", "segment")
    return alone.unionByName(several.mapInArrow(_verified, RESULT))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, html``, ``url`` if there) below ``path`` and read them back.

    A null html is an empty payload; rows without id are kept with a null id; repeated rows have a record each. Other columns
    are not read. ``path`` defaults to a new folder below the shared one.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(roles(pages), path)
    return read(spark, path)
