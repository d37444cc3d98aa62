"""WARC archives: written with one gzip member a record, and read by tasks that each own a range of bytes.

A reader task looks for gzip magic in its range, takes a place for a record if its member decodes and begins with a
WARC version line, owns the records that start inside its range, and reads past the range's end to finish the last
one. Archives lie in a folder that all executors see; a file counts once its row of the manifest is written, so a
task that is run again leaves at most a file that nothing reads.

Defined cases: a null payload is empty; of equal payloads of at least `least_bytes`, the smallest id is the response
and the others revisit it (rows that repeat that id with that payload are responses as well); smaller payloads are
all responses; a row without id is a response unless another row with its payload has one; a table without rows
gives no archive and no record; a record may be longer than a range; input columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperflow.llm.common import durable

MAGIC, BLOCK = b"\x1f\x8b\x08", 1 << 18
RECORD = "file string, offset bigint, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary"
FIELDS = ("file", "offset", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: object) -> str:
    return f"<urn:page:{page_id}>"


def member(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = " ".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    raw = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decide(pages: DataFrame, *, page_id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, response) for each distinct id and payload: the id that the payload's records refer to, null for a response."""
    raw = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n")).distinct()
    least = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first_id"))
    return rows.join(least, ["digest", "n"], "left").select("page_id", "digest", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("response"))


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The manifest (file, bytes, records) of the archives written to `folder`, one a task; it is computed once."""
    raw = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), raw.alias("raw")).withColumn("digest", F.sha1("raw"))
    found = decide(pages, page_id=page_id, payload=payload, least_bytes=least_bytes).select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), "response")
    rows = rows.join(found, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2"))).select("page_id", "url", "raw", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, name = None, 0, 0, f"{uuid.uuid4().hex}.warc.gz"
        fs, base = opened(folder)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.part")
                data = member(*row, date)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    return durable(rows.mapInArrow(run, "file string, bytes bigint, records bigint"))


def parse(raw: bytes) -> dict | None:
    """The fields of a decoded member, or None if it is no WARC record of its stated length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode(errors="replace").partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    body = block.partition(b"\r\n\r\n")[2]
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri")}
    if out["record_type"] == "revisit":
        return out | {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(fields.get("x-payload-length", 0)), "payload": None}
    return out | {"payload_digest": digest(body), "payload_bytes": len(body), "payload": body}


def records(stream, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(place, fields) of the records that begin in [start, end) of a seekable stream of gzip members."""
    stream.seek(start)
    data, base, over = b"", start, False

    def more() -> bool:
        nonlocal data, over
        got = b"" if over else stream.read(BLOCK)
        over = not got
        data += got
        return bool(got)

    at = 0
    while True:
        at_next = data.find(MAGIC, at)
        while at_next < 0:
            at = max(at, len(data) - len(MAGIC) + 1)
            if base + at >= end or not more():
                return
            at_next = data.find(MAGIC, at)
        at = at_next
        if base + at >= end:
            return
        unpacker, out, fed, good = zlib.decompressobj(31), [], at, True
        try:
            while not unpacker.eof:
                if fed == len(data) and not more():
                    good = False
                    break
                out.append(unpacker.decompress(data[fed : fed + BLOCK]))
                fed = min(len(data), fed + BLOCK)
                begun = b"".join(out[:2])[:7]
                if len(begun) == 7 and begun != b"WARC/1.":
                    good = False
                    break
        except zlib.error:
            good = False
        got = parse(b"".join(out)) if good else None
        if got is None:
            at += 1
            continue
        yield base + at, got
        at = fed - len(unpacker.unused_data)
        data, base, at = data[at:], base + at, 0


def read(spark: SparkSession, files: DataFrame | list[tuple[str, int]], *, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """RECORD rows of archives (file, bytes), by tasks of `split_bytes` each. Without `payloads` that column is null."""
    manifest = files if isinstance(files, DataFrame) else spark.createDataFrame(files, "file string, bytes bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("file", "bytes", starts.alias("start")).select("file", "start", F.least("bytes", F.col("start") + split_bytes).alias("stop"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 1
    df = ranges.repartition(int(n), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start >= stop:
                    continue
                fs, path = opened(file)
                with fs.open_input_file(path) as stream:
                    rows, size = [], 0
                    for offset, got in records(stream, start, stop):
                        rows.append({"file": file, "offset": offset} | got | ({} if payloads else {"payload": None}))
                        size += got["payload_bytes"]
                        if size > BLOCK or len(rows) >= 1000:
                            yield as_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield as_batch(rows)

    return df.mapInArrow(run, RECORD)


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(FIELDS, kinds, strict=True)], list(FIELDS))


def archive_folder(spark: SparkSession) -> str:
    """A new folder among the checkpoints, which all executors share."""
    durable(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, *, page_id: str = "page_id", **options) -> DataFrame:
    """Pages written as records and read back: (page_id string, payload_bytes, payload_digest, record_type, refers_to string)."""
    spark = pages.sparkSession
    manifest = write(pages, archive_folder(spark), page_id=page_id, **options)
    rows = read(spark, manifest.select("file", "bytes"), payloads=False)
    name = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(.*)>$", 1)
    return rows.select(name("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"))
