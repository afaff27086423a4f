"""WARC archives written from and read back as a chunked record table.

A payload is a series of rows ``(record, chunk number, bytes)``.  Writers and readers stream chunk
by chunk: a writer compresses each chunk into the record's gzip member, a reader emits a chunk row
with the length and the SHA-1 of the payload up to and including it.  Neither holds a whole record,
so one oversized payload costs no more memory than a small one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlens.llm.shared import checkpointed, shared_folder

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = ("page_id long, record_id string, record_type string, target_uri string, refers_to long, "
                "payload_digest string, chunk_no long, chunk_bytes long, bytes_so_far long, "
                "sha1_so_far string, is_last boolean, data binary")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _filesystem(uri: str):
    """File system and path of a folder by its URI; anything pyarrow knows works."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def chunk_rows(pages: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """``pages(page_id, url, html)`` as chunk rows in order, one at least per page.

    Null html counts as empty.  ``row_id`` tells rows with the same page_id apart.
    """
    body = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row_id"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    body = body.withColumns({"payload_bytes": F.octet_length("body").cast("long"), "sha1": F.sha1("body")})
    body = body.withColumn("chunk_no", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.greatest(F.col("payload_bytes") - 1, F.lit(0)) / chunk_bytes).cast("long"))))
    data = F.expr(f"substring(body, CAST(chunk_no * {chunk_bytes} AS int) + 1, {chunk_bytes})")
    return body.select("page_id", "url", "row_id", "payload_bytes", "sha1", "chunk_no", data.alias("data"))


def responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, sha1, response_id)``: the page whose record holds the payload of each page.

    Of equal payloads of at least ``min_bytes`` that with the largest page_id; smaller payloads are
    not listed.  A null page_id never is the largest unless all are null.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", F.sha1(body).alias("sha1"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    known = checkpointed(known.select("page_id", "sha1"))
    top = known.groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    return known.distinct().join(top, "sha1")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = 1 << 20,
                   archive_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` to gzipped WARC 1.1 files in ``folder`` and returns their manifest.

    A record per row: a response, or a revisit that refers to the response with the same payload.
    Manifest: ``path, n_records, n_bytes``.  A task's files carry a name of their own attempt and
    count only once the manifest lists them, so a lost or repeated task leaves no half archive in
    it.  Files end after the record that passes ``archive_bytes`` compressed.
    """
    parts = chunk_rows(pages, chunk_bytes)
    where = responses(pages, min_bytes).select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "response_id")
    parts = parts.join(where, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull(), F.lit(False))
    parts = (parts.withColumn("revisit", revisit).where(~F.col("revisit") | (F.col("chunk_no") == 0))
             .withColumn("data", F.when(~F.col("revisit"), F.col("data")))
             .select("page_id", "url", "row_id", "payload_bytes", "sha1", "chunk_no", "revisit", "response_id", "data")
             .sortWithinPartitions("page_id", "row_id", "chunk_no"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        out = path = packer = None
        records = size = 0
        done = []

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        def end_record() -> None:
            nonlocal packer
            if packer is not None:
                put(packer.compress(b"\r\n\r\n") + packer.flush())
                packer = None

        def end_file() -> None:
            nonlocal out, records, size
            if out is not None:
                out.close()
                done.append((path, records, size))
                out, records, size = None, 0, 0

        for b in batches:
            b["page_id"], b["response_id"] = b["page_id"].astype("Int64"), b["response_id"].astype("Int64")
            for r in b.itertuples(index=False):
                if r.chunk_no == 0:
                    end_record()
                    if out is not None and size >= archive_bytes:
                        end_file()
                    if out is None:
                        path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(path, compression=None)
                    records += 1
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    put(packer.compress(_head(r, date)))
                if not r.revisit:
                    view = memoryview(r.data)
                    for i in range(0, len(view), chunk_bytes):
                        put(packer.compress(view[i:i + chunk_bytes]))
        end_record()
        end_file()
        if done:
            yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    return checkpointed(parts.mapInPandas(run, "path string, n_records long, n_bytes long"))


def _name(page_id, row_id=None) -> str:
    page = "" if page_id is None or page_id is pd.NA else int(page_id)
    return f"<urn:page:{page}>" if row_id is None else f"<urn:page:{page}:{row_id}>"


def _head(r, date: str) -> bytes:
    """Header block and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    uri = "".join(c for c in (r.url or "") if c > " ")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if r.revisit else 'response'}", f"WARC-Record-ID: {_name(r.page_id, r.row_id)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(r.sha1))}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (0 if r.revisit else r.payload_bytes)}"]
    if r.revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(r.response_id)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _page(name: str | None) -> int | None:
    page = (name or "").strip("<>").split(":")[2:3]
    return int(page[0]) if page and page[0] else None


def _fields(stream) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, and their length in bytes."""
    out, n = {}, 0
    while (line := stream.readline()) not in (b"\r\n", b""):
        n += len(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, n + len(line)


def read_archives(manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Chunk rows (``CHUNK_SCHEMA``) of the archives in ``manifest(path)``.

    ``sha1_so_far`` is the bare base32 SHA-1 of the payload up to the chunk; the row with
    ``is_last`` has that of the whole.  Records without payload have one empty chunk.
    """
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        fs, top = _filesystem(path)
        with fs.open_input_stream(top, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while version := stream.readline():
                if not version.strip():
                    continue
                head, _ = _fields(stream)
                left = int(head["content-length"])
                http = _fields(stream)[1] if head.get("content-type", "").startswith("application/http") else 0
                left -= http
                kind, sha, k, n = head["warc-type"], hashlib.sha1(), 0, 0
                while True:
                    data = stream.read(min(left, chunk_bytes)) if left else b""
                    if left and not data:
                        raise EOFError(f"{path}: a record ends early")
                    left -= len(data)
                    n += len(data)
                    sha.update(data)
                    yield (_page(head.get("warc-record-id")), head.get("warc-record-id"), kind, head.get("warc-target-uri"),
                           _page(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:"), k,
                           len(data), n, base32_sha1(sha.digest()), left == 0, data if with_data else None)
                    k += 1
                    if not left:
                        break

    def frame(some: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(some, columns=names)
        out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, held = [], 0
        for b in batches:
            for path in b["path"]:
                for row in rows(path):
                    some.append(row)
                    held += row[7] if with_data else 0
                    if len(some) >= 5000 or held >= 8 << 20:
                        yield frame(some)
                        some, held = [], 0
        if some:
            yield frame(some)

    return manifest.select("path").mapInPandas(run, CHUNK_SCHEMA)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk; a revisit takes length and digest of its response."""
    last = checkpointed(chunks.where("is_last").drop("data"))
    full = last.where("record_type <> 'revisit'").select(
        F.col("page_id").alias("_page"), F.col("sha1_so_far").alias("_sha1"), F.col("bytes_so_far").alias("_bytes")).distinct()
    held = last.where("record_type = 'revisit'").join(
        full, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_sha1")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = last.where("record_type <> 'revisit'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(held.select("page_id", F.col("_bytes").alias("payload_bytes"),
                                       F.col("_sha1").alias("payload_digest"), "record_type", "refers_to").select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    spread = manifest.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return page_records(read_archives(spread, with_data=False))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS d,
        max(page_id) OVER (PARTITION BY sha1(h)) AS m FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(d, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)) AS c FROM q)
SELECT page_id, n AS payload_bytes, list_aggregate(c, 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to FROM b
"""
