"""WARC archives: a writer, and a sequential reader with incremental decompression.

An archive is a byte string of gzip members, one per record (WARC/1.1): a warcinfo record,
then one response or revisit record per page.  Archives are rows of a Parquet table in
the cluster's shared folder, written and read by Spark, so any store and any lost
executor will do; `export` writes them as .warc.gz files and `read_files` reads such
files (also those of others).

The reader never holds more than one record: it feeds a zlib decompressor chunk by chunk,
frames the block by Content-Length, and checks block and payload digests.  A page without
html has an empty payload.  Rows that repeat an id are records of their own.  Among equal
payloads the rows with the largest id are the response; null ids count as smaller than
any other and refer like the others (a payload that only null ids have is a response).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table

ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def _line(value: str) -> str:
    return "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit if refers_to is given."""
    name = "null" if page_id is None else str(page_id)
    http = _HTTP if refers_to is None else _HTTP[:-2] + b"\r\n"
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", _DATE),
        *([("WARC-Target-URI", _line(url))] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _member(fields, block)


def warcinfo() -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:0>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, one after another.

    Raises ValueError on a broken frame, a short block or a wrong digest."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, got, head, need = zlib.decompressobj(31), bytearray(), None, -1
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            part = view[at : at + CHUNK]
            got += z.decompress(part)
            at += len(part) - len(z.unused_data)
            if head is None and (end := got.find(b"\r\n\r\n")) >= 0:
                lines = got[:end].decode("utf-8", "surrogatepass").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = int(head["content-length"])
                del got[: end + 4]
        if head is None or len(got) < need or bytes(got[need:]) != b"\r\n\r\n":
            raise ValueError("a record's block does not fit its Content-Length")
        block = bytes(got[:need])
        want = head.get("warc-block-digest")
        if want and want != "sha1:" + digest32(block):
            raise ValueError(f"wrong block digest in {head.get('warc-record-id')}")
        yield head, block


def page_of(head: dict[str, str], block: bytes) -> tuple | None:
    """The READ_SCHEMA row of a response or revisit record, None for others."""
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    want = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and want and want != digest32(payload):
        raise ValueError(f"wrong payload digest in {head.get('warc-record-id')}")
    ident = lambda x: None if x is None or x in ("<urn:page:null>",) or not x.startswith("<urn:page:") else int(x[10:-1])
    size = len(payload) if kind == "response" else int(head.get("x-payload-length", -1))
    return (ident(head.get("warc-record-id")), head.get("warc-target-uri"), size, want or digest32(payload), kind, ident(head.get("warc-refers-to")), payload if kind == "response" else None)


def _responses(digests: DataFrame) -> DataFrame:
    """(d, top, n) of the payload digests that several rows have; rows without an id count too."""
    equal = digests.groupBy("d").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    return shared_table(equal.where("n > 1 and top is not null"), "warc-responses")


def _with_response(rows: DataFrame, equal: DataFrame, total: int) -> DataFrame:
    """rows and the id of their payload's response (top).

    Payloads of a thousandth of all rows or more, such as the empty one, are at most a
    thousand: they are broadcast, and their rows are spread by url where the rest is joined
    by digest."""
    common = F.col("n") >= max(100, total // 1000)
    hot = equal.where(common).select(F.col("d").alias("_hot"), F.col("top").alias("hot_top"))
    rows = rows.join(F.broadcast(hot), F.col("d") == F.col("_hot"), "left").drop("_hot")
    key = F.when(F.col("hot_top").isNull(), F.col("d")).otherwise(F.concat(F.lit("hot"), F.xxhash64("page_id", "url").cast("string")))
    rest = equal.where(~common).select(F.col("d").alias("_d"), "top")
    return rows.withColumn("_key", key).join(rest, F.col("_key") == F.col("_d"), "left").withColumn("top", F.coalesce("hot_top", "top")).drop("_key", "_d", "hot_top")


def write_archives(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """A shared table (archive string, data binary) holding one record per row of pages.

    Which rows are responses is settled on digests alone, before any html moves."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("d"))
    equal = _responses(rows.select("page_id", "d"))
    rows = _with_response(rows, equal, pages.count())
    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    schema = "archive string, data binary"

    def run(batches):
        from uuid import NAMESPACE_URL, uuid5

        held, size, first = [warcinfo()], 0, None

        def archive():
            name = f"{uuid5(NAMESPACE_URL, str(first))}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            # column by column as Python values: ids with nulls among them stay exact
            for page_id, url, html, to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode("utf-8", "surrogatepass"), to))
                first = first or (page_id, url)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, first = [warcinfo()], 0, None
        if len(held) > 1:
            yield archive()

    out = rows.select("page_id", "url", "html", refers.alias("refers")).mapInArrow(run, schema)
    return shared_table(out, "warc")


_KINDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_archives(archives: DataFrame, data_col: str = "data", payloads: bool = True) -> DataFrame:
    """READ_SCHEMA rows of all response and revisit records, archive by archive."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in read_records(data.as_py()):
                    if (row := page_of(head, block)) is not None:
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(block) if payloads else 0
                        if len(rows) >= 512 or size >= ARCHIVE_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select(F.col(data_col).alias("data")).mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KINDS)], schema=_KINDS)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the .warc.gz files under path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return read_archives(files, "content", payloads)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files of a folder that all executors share; (archive, bytes)."""

    def run(batches):
        import os

        for pdf in batches:
            for name, data in zip(pdf["archive"], pdf["data"]):
                tmp = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(tmp, "wb") as f:
                    f.write(data)
                os.replace(tmp, os.path.join(folder, name))
                yield pd.DataFrame({"archive": [name], "bytes": [len(data)]})

    return archives.mapInPandas(run, "archive string, bytes long")
