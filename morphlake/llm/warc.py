"""WARC archives, index first.

Writing: each task writes its rows as gzip members, one per record, to files of its own in a
shared folder and yields an index row per record: file, offset, length, URL and digest. The
index is a table; archives are never scanned to find a record. Reading: selected index rows
are dealt by range of (file, offset), sorted, and neighbours are read in one coalesced byte
range. Every payload read is held against its digest.

Of records with equal payloads, the one with the smallest id holds the payload (response);
the others (revisit) refer to it. A task that runs again writes a file of another name, so an
index row always points to the bytes its own attempt wrote; files without index rows are dead.

Defined cases: null html is an empty payload; a null id comes after all others, and a group
of null ids alone is all responses; rows that repeat the smallest id are all responses; a null
URL writes no WARC-Target-URI; white space and control characters in a URL are percent-encoded
in the record. Extra columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import bounded_batches, shared_dir, stored, table

#: A file is closed once it has this many bytes.
FILE_BYTES = 128 << 20
#: Records at most GAP bytes apart are read in one range of at most RANGE bytes (or one record).
GAP, RANGE = 64 << 10, 8 << 20
#: Records carry this date: the pages have none.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, path string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to, size: int) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP head, so the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields and payload of one record's bytes; a payload unlike its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x.endswith(":None>") else int(x[len("<urn:page:") : -1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload}


def _writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha, first in zip(*(batch.column(c).to_pylist() for c in ("__id", "__url", "__html", "__sha", "__first")), strict=True):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "response" if first is None or first == page_id else "revisit"
                    payload, digest = html or b"", base64.b32encode(sha).decode()
                    refers = first if kind == "revisit" else None
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(page_id, url, payload, digest, kind, refers, len(payload))) + packer.flush()
                    out.write(data)
                    rows.append((page_id, url, digest, kind, refers, f"{root}/{name}", at, len(data)))
                    at += len(data)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the index, stored."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), html.alias("__html"), F.unhex(F.sha1(html)).alias("__sha"))
    first = pages.select(F.col(id_col).cast("long").alias("__id"), F.unhex(F.sha1(html)).alias("__sha")).groupBy("__sha").agg(F.min("__id").alias("__first"))
    # Stored, so that the join deals both sides anew and the rows of a common payload can be split.
    first = stored(spark, first, "first")
    index = rows.join(first, "__sha").mapInArrow(_writer(shared_dir(spark) + "/archives"), INDEX)
    return stored(spark, index, "index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows select, read by coalesced byte ranges."""
    columns = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            i = 0
            while i < len(spans):
                path, start, length = spans[i]
                j, end = i + 1, start + length
                while j < len(spans) and spans[j][0] == path and 0 <= spans[j][1] - end <= GAP and spans[j][1] + spans[j][2] - start <= RANGE:
                    end = spans[j][1] + spans[j][2]
                    j += 1
                if path not in stores:
                    store, local = fs.FileSystem.from_uri(path)
                    stores = {path: (store.open_input_file(local),)}
                data = stores[path][0].read_at(end - start, start)
                found = [parse_record(zlib.decompress(memoryview(data)[o - start : o - start + n], 31)) for _, o, n in spans[i:j]]
                if not with_payload:
                    for x in found:
                        x["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(columns, kinds, strict=True)], names=columns)
                i = j

    places = index.select("path", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(read, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = (
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, html, hex, """
    + "".join("replace(" for _ in range(16))
    + "hex"
    + "".join(f", '{c}', '{chr(0x47 + i)}')" for i, c in enumerate("0123456789abcdef"))
    + """ AS coded FROM p
), binary_text AS (
  SELECT page_id, html, hex, """
    + "".join("replace(" for _ in range(16))
    + "coded"
    + "".join(f", '{chr(0x47 + i)}', '{i:04b}')" for i in range(16))
    + """ AS b FROM bits
), digests AS (
  SELECT page_id, hex, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + """
    + " + ".join(f"{1 << (4 - k)} * CAST(substr(b, i * 5 + {k + 1}, 1) AS INTEGER)" for k in range(5))
    + """ AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM binary_text
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
)
