"""Legacy archives to WARC: parse ARC, synthesise WARC records, write and read them back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, new_path, save, table

#: Field names of the two versions of the ARC format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2000, 1, 1)
RECORDS_PER_FILE = 2_000
_PLAIN = "!#$%&'()*+,/:;=?@[]~-._"


def write_arc(entries: list[tuple[str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, 14-digit date, HTTP response bytes)."""
    block = f"{version} 0 tokenledger\n{FIELDS[version]}\n".encode()
    ends = "" if version == 1 else f"200 - - 0 {name} "
    parts = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {ends}{len(block)}\n".encode(), block, b"\n"]
    for url, date, body in entries:
        parts += [f"{url} 0.0.0.0 {date} text/html {ends}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block, by the fields that the block declares; field values under their names, and body.

    A record line that doesn't fit the declared fields or a length beyond the
    file raises ValueError: there is no way to find the next record.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            size = int(line[-1])
        except ValueError:
            raise ValueError(f"no length in the ARC header line at byte {at}") from None
        if end < 0 or end + 1 + size > len(data) or size < 0:
            raise ValueError(f"the ARC record at byte {at} is cut short")
        body = data[end + 1 : end + 1 + size]
        if names is None:
            said = body.decode("utf-8", "replace").splitlines()
            version = int(said[0].split(" ")[0]) if said and said[0][:1].isdigit() else 1
            names = said[1].split(" ") if len(said) > 1 else FIELDS[version].split(" ")
        else:
            if len(line) != len(names):
                raise ValueError(f"{len(line)} fields where the version block declares {len(names)}, at byte {at}")
            yield dict(zip(names, line, strict=True)) | {"body": body}
        at = end + 1 + size


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{key}')}>"


def to_warc(arc: dict, refers_to: str | None = None) -> bytes:
    """A WARC record (without the two line ends that close it) for an ARC record.

    Responses keep the whole HTTP block; with refers_to, the key of the record
    that has the same payload, it is a revisit of the HTTP headers alone.
    Bodies without an HTTP head are resource records.
    """
    body = arc["body"]
    http = body.startswith(b"HTTP/")
    head, gap, payload = body.partition(b"\r\n\r\n") if http else (b"", b"", body)
    digest = digest_of(payload)
    key = next((x.split(b":", 1)[1].strip().decode() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), arc["URL"])
    date = datetime.strptime(arc["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S")
    kind = ("revisit" if refers_to is not None else "response") if http else "resource"
    block = head + gap if kind == "revisit" else body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(digest, key)}", f"WARC-Date: {date.isoformat()}Z", f"WARC-Target-URI: {arc['URL']}", f"WARC-IP-Address: {arc['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(digest, refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: " + ("application/http; msgtype=response" if http else arc["Content-type"]), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of the records of a WARC file, gzipped or not, by their declared lengths."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"the WARC record at byte {at} is cut short")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, first = (batch.column(i) for i in range(4))
        for at in range(0, batch.num_rows, 200):
            version, entries, refs = 1 + at // 200 % 2, [], []
            for i in range(at, min(at + 200, batch.num_rows)):
                key, html = str(ids[i].as_py()), (pages[i].as_py() or "").encode("utf-8", "surrogatepass")
                url = quote(urls[i].as_py() or f"urn:page:{key}", safe=_PLAIN)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(html)}\r\n\r\n"
                date = EPOCH + timedelta(seconds=(ids[i].as_py() or 0) % 10**9)
                entries.append((url, date.strftime("%Y%m%d%H%M%S"), head.encode() + html))
                refs.append(first[i].as_py())
            records = [to_warc(x, None if r is None else str(r)) for x, r in zip(read_arc(write_arc(entries, version)), refs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "surrogatepass") for x in records], pa.string())], ["record"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows: list[list] = [[] for _ in names]
            for fields, block in read_warc(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                key = next(x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:"))
                kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest_of(payload) != said:
                    raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
                size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                refers = fields.get("x-refers-to-page-id")
                for column, value in zip(rows, (None if key == b"None" else int(key), size, said, kind, None if refers is None else int(refers)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Write a WARC record per row of pages (page_id, url, html) under path, by way of ARC records of both versions.

    Of rows with equal payloads of least_bytes or more, those of the smallest
    page_id are responses and the others revisits of it. Only digests are
    shuffled to find it; the map from revisits to responses is broadcast
    where it is small (counted). Null html is an empty payload, a null url
    urn:page:<id>; rows of null page_id are responses. Other columns are
    ignored. The text writer puts the records' closing line ends.
    """
    small = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).where(F.col("n") >= least_bytes)
    small = save(small, "warc-digests")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("digest", "first")
    refs = save(small.join(first, "digest").where("page_id <> first").select(F.col("page_id").alias("revisit"), "first").distinct(), "warc-revisits")
    rows = pages.select("page_id", "url", "html").join(bounded(refs), F.col("page_id") == F.col("revisit"), "left").select(F.col("page_id").cast("long"), "url", "html", F.col("first").cast("long"))
    rows.mapInArrow(_convert, "record string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of write_archives; payloads are held against their digests."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives in the shared folder and back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)
