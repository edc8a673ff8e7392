"""WARC archives: one gzip member a record, written by tasks and read back as a stream.

Writer: a task appends records to a file of its own in the shared folder and begins another beyond ROLL_BYTES. A file
counts only once it is in the manifest, so what a lost task leaves behind is never read.

Reader: sequential. Bytes go through an incremental zlib decoder; the header ends at the first empty line, Content-Length
frames the block, and a member must end with its record. SHA-1 of block and payload are held against the headers. Memory
holds one record. A damaged archive raises ValueError with the file and the member's number.

Among payloads of at least REVISIT_BYTES that are equal, the one of the largest page_id is a response and the rest are
revisits that name it. Rows that share that largest page_id are all responses. A null id is never preferred to another.
Null html: an empty payload. Null url: an empty target. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.llm.common import cut, delete, new_folder, place, table, uri_of

ROLL_BYTES = 64 << 20
REVISIT_BYTES = 1000
LEVEL = 3
CHUNK = 1 << 16
#: Rows of duplicate digests that may be broadcast; beyond it, the join shuffles.
SMALL_ROWS = 200_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def b32(sha1: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(sha1)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The gzip member of one record. Ids travel as URNs; a target's line breaks are escaped."""
    urn = lambda i: b"<urn:page:%s>" % (b"null" if i is None else b"%d" % i)
    digest = hashlib.sha1(payload).digest()
    block = HTTP + payload if refers_to is None else HTTP
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode() if any(c in (url or "") for c in "\r\n") else (url or "").encode()
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + urn(page_id),
        b"WARC-Target-URI: " + target,
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: " + b32(digest),
        b"WARC-Block-Digest: " + b32(hashlib.sha1(block).digest()),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + urn(refers_to)]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: Iterator[bytes]) -> dict:
    """One record from the decompressed chunks of its member."""
    head = b""
    for piece in member:
        head += piece
        if b"\r\n\r\n" in head:
            break
    top, gap, rest = head.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size, parts, got = int(fields[b"content-length"]), [rest], len(rest)
    for piece in member:
        parts.append(piece)
        got += len(piece)
    if got != size + 4:
        raise ValueError(f"Content-Length {size}, but {got - 4} bytes")
    data = b"".join(parts)
    block = data[:size]
    if data[size:] != b"\r\n\r\n":
        raise ValueError("a record must end with two line ends")
    def agrees(name: bytes, part: bytes) -> bool:
        return name not in fields or fields[name] == b32(hashlib.sha1(part).digest())

    if not agrees(b"warc-block-digest", block):
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if b"application/http" in fields.get(b"content-type", b"") else block
    if fields[b"warc-type"] != b"revisit" and not agrees(b"warc-payload-digest", payload):
        raise ValueError("payload digest differs")
    return {"fields": fields, "payload": payload}


def members(stream, name: str) -> Iterator[dict]:
    """The records of a stream of gzip members."""
    number, left = 0, b""
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        unpack = zlib.decompressobj(31)

        def pieces():
            nonlocal left
            while not unpack.eof:
                left = left or stream.read(CHUNK)
                if not left:
                    raise ValueError("the archive ends within a member")
                out = unpack.decompress(left)
                left = unpack.unused_data
                if out:
                    yield out

        try:
            yield parse(pieces())
        except (ValueError, KeyError, zlib.error) as e:
            raise ValueError(f"{name}, member {number}: {e}") from e
        number += 1


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives in ``folder`` with a record for each row of pages; returns their manifest."""
    folder = uri_of(folder)
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("i"), F.col(f"`{url}`").cast("string").alias("u"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("h"))
    digest = rows.select("i", F.length("h").alias("n"), F.sha1("h").alias("d")).where(F.col("n") >= REVISIT_BYTES)
    dups = cut(digest.groupBy("d").agg(F.max("i").alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "keep"))
    side = F.broadcast(dups) if dups.count() <= SMALL_ROWS else dups
    known = rows.withColumn("d", F.when(F.length("h") >= REVISIT_BYTES, F.sha1("h"))).join(side, "d", "left")
    ready = known.select("i", "u", "h", F.when(~F.col("i").eqNullSafe(F.col("keep")), F.col("keep")).alias("r"))

    def run(batches):
        done, out, path, n, size = [], None, "", 0, 0
        store, base = place(folder)
        store.create_dir(base, recursive=True)

        def close():
            out.close()
            done.append((path, n, size))

        for batch in batches:
            for i, u, h, r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None), 0, 0
                m = record(i, u, h, r)
                out.write(m)
                n, size = n + 1, size + len(m)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(ready.mapInArrow(run, FILES))


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives whose paths are in ``manifest``; ``payload`` False leaves their bodies out."""
    number = lambda v: None if v in (None, b"<urn:page:null>") else int(v[10:-1])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = place(path)
                with store.open_input_stream(local, compression=None) as stream:
                    rows, size = [], 0
                    for r in members(stream, path):
                        f = r["fields"]
                        kind = f[b"warc-type"].decode()
                        digest = base64.b32decode(f[b"warc-payload-digest"][5:]).hex()
                        n = int(f.get(b"x-payload-length", len(r["payload"])))
                        rows.append((number(f.get(b"warc-record-id")), f.get(b"warc-target-uri", b"").decode(), kind, number(f.get(b"warc-refers-to")), n, digest, (r["payload"] if kind != "revisit" else None) if payload else None))
                        size += len(r["payload"]) if payload else 0
                        if len(rows) >= 2000 or size >= 16 << 20:
                            yield table_of(rows)
                            rows, size = [], 0
                    yield table_of(rows)

    def table_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=RECORD.names)

    return manifest.select("path").mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    back = cut(read(manifest.repartition(max(1, manifest.count())), payload=False).drop("payload", "url"))
    delete(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d HAVING count(*) > 1)
    SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN keep IS NULL OR keep IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
    FROM p LEFT JOIN k ON p.d = k.d AND n >= {REVISIT_BYTES}"""
