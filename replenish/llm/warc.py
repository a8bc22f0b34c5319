"""Web archives: a writer of one gzip member a record, and a splittable reader.

Writing: records with equal payloads of at least ``min_bytes`` bytes are stored
once; the one with the smallest id is a ``response``, the others are ``revisit``
records that refer to it and hold the HTTP header only. Every task writes files of
its own into the shared folder; a table of the files that finished tasks wrote
(the manifest) says which ones count, so files of lost or repeated tasks are
never read.

Reading: the manifest is cut into byte ranges, one row each, dealt to tasks. A
task looks in its range for the gzip magic, validates a candidate by decoding the
start of that member as a WARC header, and from there goes on member by
member. It owns the records whose member starts inside its range, reading past
the end for the last one. After a damaged member it looks for the magic
again. Payloads leave a task in batches of bounded bytes.

Defined results: a null payload is empty; empty and other short payloads are
always responses; a null id is larger than any other, so such a record is a
revisit if its payload has a record with an id; records that repeat the smallest
id of a payload are all responses; a null URL leaves the field out, line ends
in a URL are percent-encoded; other columns are ignored whatever their names; an empty
table gives no file and no record. A stored (not deflated) member that itself holds
a WARC file could be taken for members by a task that starts inside it; the
writer deflates, and text does not hold the gzip magic.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import importable, written

MIN_BYTES = 100
#: A task begins another file beyond this size.
FILE_BYTES = 1 << 30
#: Bytes of an archive that one reading task owns.
RANGE_BYTES = 32 << 20
#: Bytes read at once, and bytes of payload in an Arrow batch.
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
ID = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string())]
    + [("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_bytes", pa.int64()), ("payload", pa.binary())]
)
RECORD_TYPES = "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_bytes long, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address as Spark names it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# Writing


def with_types(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """(id, url, digest, n_bytes, first, payload): ``first`` is the record that a revisit refers to, else null."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    # One row a payload that several records share; a hot one is counted where it lies.
    shared = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(shared.select("digest", "least"), "digest", "left")
    first = F.when((F.col("n_bytes") >= min_bytes) & (F.col("id").isNull() | (F.col("id") > F.col("least"))), F.col("least"))
    out = out.withColumn("first", first)
    return out.select("id", "url", "digest", "n_bytes", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def member(record_id: str, url: str | None, digest: str, size: int, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(http + payload + b"\r\n\r\n") + deflate.flush()


def write(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    folder: str | None = None,
    min_bytes: int = MIN_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (default: one in the shared folder that goes with the program); the manifest (file, bytes, records)."""
    spark = pages.sparkSession
    importable(spark)
    folder = (folder or scratch_folder(spark, "warc")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        out, name, size, n = None, "", 0, 0
        with contextlib.ExitStack() as stack:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in range(batch.num_columns))):
                    key, url, digest, n_bytes, first, payload = (x.as_py() for x in row)
                    data = member(ID + (key or ""), url, digest, n_bytes, first and ID + first, payload or b"", date)
                    if out is not None and size + len(data) > file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "bytes": size, "records": n}], schema=done)
                        out = None
                    if out is None:
                        store.create_dir(base, recursive=True)
                        name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = stack.enter_context(store.open_output_stream(f"{base}/{name}", compression=None))
                    out.write(data)
                    size, n = size + len(data), n + 1
        if out is not None:  # closed here, so whole
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "bytes": size, "records": n}], schema=done)

    done = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
    rows = with_types(pages, id_col, url_col, body_col, min_bytes)
    rows = rows.select(F.col("id").cast("string"), "url", "digest", "n_bytes", F.col("first").cast("string"), "payload")
    return written(spark, rows.mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")


# Reading


class _Window:
    """Bytes of one archive from any place on, read forward; a bounded piece is held."""

    def __init__(self, source, at: int):
        self.source, self.at, self.held = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        data = self.source.read(READ_BYTES)
        self.held += data
        return bool(data)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def fields_of(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of a header block, without its first line."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def is_record(w: _Window) -> bool:
    """Whether the held bytes begin a gzip member whose content begins a WARC record."""
    inflate, seen, used = zlib.decompressobj(31), b"", 0
    while len(seen) < 7:
        if used == len(w.held) and not w.more():
            return False
        piece = w.held[used : used + 4_096]
        used += len(piece)
        try:
            seen += inflate.decompress(piece, 64)
        except zlib.error:
            return False
        if inflate.eof:
            break
    return seen.startswith(b"WARC/1.")


def next_member(w: _Window, end: int) -> bool:
    """Go to the next valid member that starts before ``end``; whether there is one."""
    while w.at < end:
        found = w.held.find(MAGIC)
        if found >= 0:
            w.drop(found)
            if w.at < end and is_record(w):
                return True
            w.drop(1)
        else:
            w.drop(max(0, len(w.held) - 2))
            if not w.more():
                return False
    return False


def inflated(w: _Window) -> bytes | None:
    """The content of the member that the held bytes begin; None (and one byte further) if it is damaged."""
    inflate, out, start = zlib.decompressobj(31), [], w.at
    kept = w.held  # to come back to if the member is damaged
    try:
        while True:
            out.append(inflate.decompress(w.held))
            if inflate.eof:
                w.drop(len(w.held) - len(inflate.unused_data))
                return b"".join(out)
            w.drop(len(w.held))
            if not w.more():
                break
    except zlib.error:
        pass
    w.at, w.held = start, kept
    w.drop(1)
    w.source.seek(w.at + len(w.held))
    return None


def parsed(content: bytes, file: str, offset: int) -> dict | None:
    """A row of RECORDS; None if the content is cut short."""
    head, gap, block = content.partition(b"\r\n\r\n")
    warc = fields_of(head)
    size = int(warc["content-length"]) if warc.get("content-length", "").isdigit() else -1
    if not gap or not 0 <= size <= len(block):
        return None
    block = block[:size]
    http: dict[str, str] = {}
    if warc.get("content-type", "").startswith("application/http"):
        first, _, block = block.partition(b"\r\n\r\n")
        http = fields_of(first)
    kind = warc.get("warc-type")
    return {
        "file": file,
        "offset": offset,
        "record_id": warc.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "target_uri": warc.get("warc-target-uri"),
        "refers_to": warc["warc-refers-to"].strip("<>") if "warc-refers-to" in warc else None,
        "payload_digest": warc.get("warc-payload-digest"),
        "http_bytes": int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
        "payload": None if kind == "revisit" else block,
    }


def records_between(file: str, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in [start, end) of an archive."""
    store, path = opened(file)
    with store.open_input_file(path) as source:
        w = _Window(source, start)
        while next_member(w, end):
            while w.at < end:  # members follow one another
                offset, content = w.at, None
                if not w.held and not w.more():
                    break
                if not (w.held.startswith(MAGIC) or (len(w.held) < 3 and w.more() and w.held.startswith(MAGIC))):
                    break
                content = inflated(w)
                if content is None:
                    break
                if content.startswith(b"WARC/1.") and (row := parsed(content, file, offset)) is not None:
                    yield row


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives (file, bytes): file, offset, record_id, record_type, target_uri, refers_to, payload_digest, http_bytes, payload.

    ``http_bytes`` is the length that the HTTP header states, of a revisit too;
    a revisit has no payload of its own.
    """
    importable(manifest.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.where("bytes > 0").select("file", F.explode(starts).alias("start"))
    # A task a range: the rows are tiny, so their bytes say nothing of the work, and the number is stated.
    ranges = ranges.repartition(max(1, ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in records_between(file, start, start + range_bytes):
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=RECORDS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=RECORDS)

    return ranges.mapInArrow(run, RECORD_TYPES)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the .warc.gz files in a folder that no manifest describes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def digest(records: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); of a response from the payload read back, of a revisit from its header."""
    key = lambda c: F.when(F.length(c) > len(ID), F.substring(c, len(ID) + 1, 1 << 20)).cast(kind)
    own = F.col("record_type") == "response"
    return records.select(
        key("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        key("refers_to").alias("refers_to"),
    )
