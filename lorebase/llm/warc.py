"""WARC archives: one gzip member for each record, read in sequence.

Writing: payloads are grouped by SHA-1; of equal payloads of at least
``revisit_from`` bytes the largest identifier is the response, and the others
become revisit records that name it. Reading: members are inflated step by
step, records are framed by their content length, and each payload is checked
against its digest, so a task holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import shared_dir, shuffle_partitions, staged
from lorebase.llm.storage import create, open_stream

#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"
TOKEN = "urn:page:"


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit where ``refers_to`` is given: it keeps the
    HTTP header, whose length is the full payload's, and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{TOKEN}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([] if refers_to is None else [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{TOKEN}{refers_to}>")]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The members of a gzip file, each as its inflated pieces; the file is read in steps."""
    rest = stream.read(STEP)

    def pieces():
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            if not rest:
                rest = stream.read(STEP)
                if not rest:
                    raise ValueError("the archive ends within a member")
            yield z.decompress(rest, STEP) if not z.unconsumed_tail else b""
            rest = z.unconsumed_tail
            while rest and not z.eof:
                yield z.decompress(rest, STEP)
                rest = z.unconsumed_tail
        rest = z.unused_data

    while rest:
        inner = pieces()
        yield inner
        for _ in inner:  # what the reader left over
            pass
        if not rest:
            rest = stream.read(STEP)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an open archive."""
    for pieces in _members(stream):
        data = bytearray()
        for x in pieces:
            data += x
            if (cut := data.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record without a whole header")
        fields = _fields(bytes(data[:cut]))
        size = int(fields["content-length"])
        for x in pieces:
            data += x
        block = bytes(data[cut + 4 : cut + 4 + size])
        if len(block) != size or data[cut + 4 + size :] != b"\r\n\r\n":
            raise ValueError("a block that doesn't match its content length")
        yield fields, block


def parse(fields: dict[str, str], block: bytes) -> dict:
    """Row of a record: identifiers, type, payload, its full length and verified digest."""
    number = lambda x: None if x in (None, "null") else int(x)
    name = lambda x: x and x.strip("<>").removeprefix(TOKEN)
    header, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha1 = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError("a payload that doesn't match its digest")
    return {"page_id": number(name(fields["warc-record-id"])), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": sha1, "record_type": fields["warc-type"], "refers_to": number(name(fields.get("warc-refers-to"))), "payload": None if revisit else payload}


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, revisit_from: int = 1000) -> DataFrame:
    """Write every page as a record; a row per archive: ``path, records``.

    * Null html is an empty payload; payloads below ``revisit_from`` bytes are
      always responses. Of rows repeated with the identifier and payload of the
      response all are responses. A null identifier never is the response of
      others unless all are null, and then each is a response.
    * White space is taken out of URLs; a null URL becomes ``about:blank``.
    * Payloads are equal if SHA-1, length and a second, independent 64-bit hash agree.
    * Digests shared by very many pages: only (identifier, digest) pairs meet on
      the digest, in a join that splits skewed keys; pages join on both.
    * A payload of any length is one record, held whole in a task while it is
      written; an empty table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    plain = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    same = ["digest", "size", "check"]
    hashed = plain.withColumns({"size": F.octet_length("payload"), "check": F.xxhash64("payload")})
    keys = staged(hashed.where(F.col("size") >= revisit_from).select("page_id", *same))
    stays = keys.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = keys.join(stays.drop("n"), same).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).groupBy("page_id", *same).agg(F.max("refers_to").alias("refers_to"))
    equal = F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
    for c in same:
        equal = equal & (F.col(f"p.{c}") == F.col(f"r.{c}"))
    whole = hashed.alias("p").join(revisits.alias("r"), equal, "left").select("p.*", "refers_to").drop("size", "check")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, stream, path, size, count = [], None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if stream is None:
                    path, stream = create(folder, ".warc.gz")
                data = member(record(*(x.as_py() for x in row)))
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    rows.append({"path": path, "records": count})
                    stream, size, count = None, 0, 0
        if stream is not None:
            stream.close()
            rows.append({"path": path, "records": count})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return staged(whole.mapInArrow(write, "path string, records bigint"))


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of the archives of column ``path``: ``page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload``."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size = [], 0
                with open_stream(path) as stream:
                    for fields, block in records(stream):
                        rows.append(parse(fields, block))
                        size += len(block) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = shuffle_partitions(archives.sparkSession)
    types = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return archives.select("path").repartition(n, "path").mapInArrow(read, types).select(*names)
