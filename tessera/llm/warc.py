"""WARC archives: write with deduplication, index first, then read the selected records in coalesced ranges.

Writing gives an index of file, offset, length, URL and digest per record. Reading starts from the index:
the selected rows are sorted by file and offset, ranges that lie close together become one sequential read,
and each record is cut out of it, unpacked and parsed. Every attempt of a task writes a file of its own and
the index names only files of attempts that succeeded, so a lost executor leaves at most an unused file.

Defined results: a null payload is empty; among rows of equal payload those with the smallest id are
responses and all others revisits (rows that repeat that id and payload are all responses); rows with a null
id are responses unless an equal payload has an id; a null URL leaves its header out and control characters
in URLs are percent-encoded; very long payloads are single records, held in memory one at a time; an empty table gives no rows and no archive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_path, prepare, stored, table

EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tessera:record:"
#: Ranges closer than GAP are read together, up to SPAN bytes at once.
GAP, SPAN = 64 << 10, 8 << 20
#: Revisits (an id and two short strings each) that may be broadcast.
FEW = 200_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes, without Python."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, record_id: str, url: str | None, date: str, digest: str, payload: bytes, refers_to: str | None, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(quote(c) if c < " " or c == "\x7f" else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """The headers of a record, the payload length that its HTTP head states, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return headers, stated, payload


def pack(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=3, mtime=0)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """(id, url, payload, digest, kind, refers_to) of rows (id, url, payload). Only ids and digests are grouped.

    Up to FEW revisits are sent to where the pages are; if there are more, pages are dealt by id and digest."""
    keyed = pages.select("id", "url", "payload").withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("digest", base32_sha1(F.col("payload")))
    narrow = keyed.select("id", "digest")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    again = narrow.join(first, "digest").filter("id is null or id <> first").distinct().select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    again = stored(again, "warc-revisits")
    again = F.broadcast(again) if again.count() <= FEW else again
    joined = keyed.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"), F.col("first").alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = EPOCH) -> DataFrame:
    """Writes rows (id, url, payload) as gzipped archives in folder and returns the stored index."""
    id_type = pages.schema["id"].dataType.simpleString()

    def run(batches):
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        path, out, at = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            offsets, sizes = [], []
            out = out or store.open_output_stream(path, compression=None)
            for key, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                body = payload.encode()
                one = pack(record(kind, f"{URN}{'' if key is None else key}", url, date, digest, body if kind == "response" else b"", None if refers is None else f"{URN}{refers}", len(body)))
                out.write(one)
                offsets.append(at), sizes.append(len(one))
                at += len(one)
            name = folder.rstrip("/") + path[len(base) :]
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), b.column(1), b.column(3), b.column(0), b.column(4)], names=["file", "offset", "length", "url", "digest", "id", "kind"])
        if out:
            out.close()

    planned = plan_revisits(pages)
    return stored(planned.mapInArrow(run, f"file string, offset long, length long, url string, digest string, id {id_type}, kind string"), "warc-index")


def members(data: fs.FileSystem, path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record of an archive, packed record by record or not at all."""
    with data.open_input_stream(path, compression=None) as f:
        buf, at, packed = f.read(1 << 20), 0, None
        while buf:
            packed = buf[:2] == b"\x1f\x8b" if packed is None else packed
            if packed:
                z, raw, used = zlib.decompressobj(31), [], 0
                while not z.eof:
                    raw.append(z.decompress(buf))
                    used += len(buf) - len(z.unused_data)
                    buf = z.unused_data
                    if not z.eof and not (buf := f.read(1 << 20)):
                        raise ValueError(f"{path} ends within a record")
                yield at, used, b"".join(raw)
            else:
                while b"\r\n\r\n" not in buf and (more := f.read(1 << 20)):
                    buf += more
                head = buf.partition(b"\r\n\r\n")[0]
                used = len(head) + 8 + next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                while len(buf) < used and (more := f.read(1 << 20)):
                    buf += more
                yield at, used, buf[:used]
                buf = buf[used:]
            at += used
            buf = buf or f.read(1 << 20)


def index(spark: SparkSession, files: list[str]) -> DataFrame:
    """The index of archives that something else wrote: one scan of each file."""
    prepare(spark)
    schema = "file string, offset long, length long, url string, digest string, id string, kind string"

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for at, used, raw in members(*opened(uri)):
                    h = parse(raw)[0]
                    rows.append({"file": uri, "offset": at, "length": used, "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None, "id": h.get("warc-record-id", "").strip("<>"), "kind": h.get("warc-type")})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("id", pa.string()), ("kind", pa.string())]))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("id", pa.string()), ("kind", pa.string())]))

    paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return paths.mapInArrow(run, schema)


def read(selected: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of index rows: (file, offset, record_id, url, kind, refers_to, size, digest) and the payload if asked for.

    size and digest of a response are those of the bytes read; a mismatch with its header is an error.
    """
    schema = "file string, offset long, record_id string, url string, kind string, refers_to string, size long, digest string" + ", payload binary" * payloads

    def run(batches):
        for b in batches:
            files, offsets, sizes = (b.column(i).to_pylist() for i in range(3))
            i, rows = 0, []
            while i < len(files):
                j, end = i + 1, offsets[i] + sizes[i]
                while j < len(files) and files[j] == files[i] and offsets[j] - end <= GAP and offsets[j] + sizes[j] - offsets[i] <= SPAN:
                    end = max(end, offsets[j] + sizes[j])
                    j += 1
                store, path = opened(files[i])
                with store.open_input_file(path) as f:
                    data = f.read_at(end - offsets[i], offsets[i])
                for k in range(i, j):
                    raw = data[offsets[k] - offsets[i] : offsets[k] - offsets[i] + sizes[k]]
                    h, stated, payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                    said = h.get("warc-payload-digest", "").rpartition(":")[2]
                    if h["warc-type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if said and found != said:
                            raise ValueError(f"{files[k]} at {offsets[k]}: payload digest {found}, header {said}")
                        said, stated = found, len(payload)
                    row = (files[k], offsets[k], h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h["warc-type"], h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, stated, said)
                    rows.append((*row, payload) if payloads else row)
                i = j
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=names)

    ordered = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    found = read(write(pages, new_path(spark, "warc")))
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(URN) + 1}) as bigint)")
    return found.select(number("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


OP1_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages
), d as (
  select *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(5 * i + 1 as int), 5) as bigint) >> (15 - 5 * cast(j as int))) & 31 as int) + 1, 1)), '')), '') as b32 from p
)
select page_id, cast(n as bigint) as payload_bytes, b32 as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d
"""
