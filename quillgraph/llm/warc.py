"""WARC archives: write, read, and rewrite with repeated payloads as revisit records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import as_uri, cut, narrow_batches, shared_dir
from quillgraph.llm.text import map_batches
from quillgraph.operators.skew import SHARES, look_up

#: Payloads of fewer bytes are never turned into revisits.
LEAST_REVISIT = 1000
#: Compressed bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 8 << 20
COMPRESSION = 1
_IDS = uuid.UUID("6f1d7c0e-0000-4000-8000-51a9c3d20b11")
_CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    """The same page and payload get the same id in every run."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{digest}')}>"


def _one_line(value: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value or "")


def pack_record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, date: str, original: tuple | None = None) -> bytes:
    """A WARC/1.1 record as a gzip member: a response, or a revisit of ``original`` (page_id, url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if original else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if original:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original[0], digest)}"]
        if original[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(original[1])}")
        if original[0] is not None:
            head.append(f"X-Refers-To-Page-Id: {original[0]}")
    raw = "\r\n".join(head).encode() + _CRLF * 2 + body + _CRLF * 2
    squeeze = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def members(data) -> list:
    """(offset, length, bytes) of the gzip members of an archive, one at a time."""
    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        unpack, start, parts = zlib.decompressobj(31), at, []
        while not unpack.eof:
            chunk = view[at : at + 65_536]
            if not len(chunk):
                raise ValueError("archive breaks off inside a record")
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield start, at - start, b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict((k.lower(), v) for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]))
    size = int(head["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("record is shorter than its Content-Length")
    http_end = block.index(b"\r\n\r\n")
    http = dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:]))
    return {"head": head, "http": http, "payload": block[http_end + 4 :]}


def payload_digest(head: dict) -> str:
    return base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()


class ArchiveWriter:
    """Rolls archives in a folder of any store that Arrow opens; a file appears whole or not at all."""

    def __init__(self, folder: str, stem: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.stem, self.count, self.parts, self.size = stem, 0, [], 0

    def add(self, record: bytes) -> tuple[str, int]:
        if self.size and self.size + len(record) > ARCHIVE_BYTES:
            self.close()
        at = (f"{self.stem}-{self.count:05d}.warc.gz", self.size)
        self.parts.append(record)
        self.size += len(record)
        return at

    def close(self) -> None:
        if self.parts:
            name = f"{self.root}/{self.stem}-{self.count:05d}.warc.gz"
            part = f"{self.root}/_{uuid.uuid4().hex}.part"
            with self.store.open_output_stream(part, compression=None) as out:
                for record in self.parts:
                    out.write(record)
            self.store.move(part, name)
            self.count, self.parts, self.size = self.count + 1, [], 0


def _folder(spark: SparkSession, folder: str, make: bool) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path) if make else store.delete(path, True)


def write_archives(pages: DataFrame, folder: str, date: str, key: str = "page_id") -> DataFrame:
    """Write one response record per row and return their headers, materialised.

    (key, url, payload_bytes, digest, file, offset): null html is an empty payload. A task that runs
    twice writes the same files again.
    """
    folder = as_uri(folder)
    _folder(pages.sparkSession, folder, True)
    narrow_batches(pages.sparkSession)

    def run(batches):
        writer = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}")
        for batch in batches:
            ids, urls, htmls = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for page_id, url, page in zip(ids, urls, htmls, strict=True):
                payload = (page or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                file, offset = writer.add(pack_record(page_id, url, payload, digest, len(payload), date))
                rows.append((len(payload), digest, file, offset))
            if rows:
                size, digest, file, offset = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest), pa.array(file), pa.array(offset, pa.int64())], names=[key, "url", "payload_bytes", "digest", "file", "offset"])
        writer.close()

    kind = dict(pages.dtypes)[key]
    return cut(pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url string, payload_bytes long, digest string, file string, offset long"))


def resolve_revisits(headers: DataFrame, key: str = "page_id") -> DataFrame:
    """(file, offset, original): the records that repeat another's payload, with the record to refer to.

    Headers alone are shuffled, by payload digest. Of equal payloads of LEAST_REVISIT bytes or more
    the row of the largest key stays a response (of several such rows, the last written); the largest
    is found by a pre-aggregated maximum, and that of a payload that many headers share is broadcast,
    so a payload of any frequency costs no single task.
    """
    long = headers.where(F.col("payload_bytes") >= LEAST_REVISIT).withColumn("payload", F.concat_ws("/", "digest", "payload_bytes"))
    last = long.groupBy("payload").agg(F.max(F.struct(F.col(key).alias("id"), "file", "offset", "url")).alias("original"), F.count("*").alias("copies"))
    last = cut(last.where("copies > 1"))
    rows = headers.count()
    hot = last.where(F.col("copies") > max(1, rows // SHARES))
    table = lambda t: t.select(F.col("payload").alias("p"), "original")
    joined = look_up(long, "payload", table(last), "p", table(hot))
    other = (F.col("file") != F.col("original.file")) | (F.col("offset") != F.col("original.offset"))
    return joined.where(other).select("file", "offset", F.struct("original.id", "original.url").alias("original"))


def rewrite_archives(headers: DataFrame, revisits: DataFrame, source: str, target: str, date: str) -> DataFrame:
    """Write every archive of ``source`` anew in ``target``, repeated payloads as revisit records.

    An archive is streamed by one task with the decisions on its own records; payloads are not
    shuffled. All records get fresh headers. Gives (file, records, revisits), materialised.
    """
    spark = headers.sparkSession
    source, target = as_uri(source), as_uri(target)
    _folder(spark, target, True)
    files = headers.select("file").distinct()
    mine = revisits.groupBy("file").agg(F.collect_list(F.struct("offset", "original")).alias("again")).withColumnRenamed("file", "f")
    # A row stands for a whole archive: the number of tasks follows the archives, not the rows' bytes.
    tasks = max(1, min(files.count(), 100_000))
    work = files.join(mine, F.col("file") == F.col("f"), "left").select("file", "again").repartition(tasks, "file")

    def run(batches):
        store, root = fs.FileSystem.from_uri(source)
        for batch in batches:
            for file, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {x["offset"]: (x["original"]["id"], x["original"]["url"]) for x in again or ()}
                writer, records = ArchiveWriter(target, file.removesuffix(".warc.gz")), 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as f:
                    data = f.read()
                for offset, _, raw in members(data):
                    r = parse_record(raw)
                    head = r["head"]
                    size = int(r["http"]["content-length"])
                    writer.add(pack_record(head.get("x-page-id"), head.get("warc-target-uri"), r["payload"], payload_digest(head), size, date, refers.get(offset)))
                    records += 1
                writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([records], pa.int64()), pa.array([len(refers)], pa.int64())], names=["file", "records", "revisits"])

    return cut(work.mapInArrow(run, "file string, records long, revisits long"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record.

    Size and digest of a response are measured on the payload read and held against its headers;
    those of a revisit come from its headers.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def make():
        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def each(batch: pa.RecordBatch):
            for value in batch.column(0):
                rows, held = [], 0
                for _, _, raw in members(value.as_buffer()):
                    r = parse_record(raw)
                    head, payload = r["head"], r["payload"]
                    digest, size, kind = payload_digest(head), int(r["http"]["content-length"]), head["warc-type"]
                    if kind == "response":
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError("a payload differs from its digest")
                    ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((ids[0], head.get("warc-target-uri"), kind, size, digest, ids[1], payload if kind == "response" else None))
                    held += size
                    if held > 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

        return each

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return map_batches(files, ["content"], make, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def dedup_archives(pages: DataFrame, folder: str, date: str | None = None) -> str:
    """Write ``pages`` as archives without repeated payloads under ``folder``; gives their folder."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw, final = f"{folder}/raw", f"{folder}/dedup"
    headers = write_archives(pages, raw, date)
    rewrite_archives(headers, resolve_revisits(headers), raw, final, date)
    _folder(pages.sparkSession, raw, False)
    return final


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all ``pages`` with revisit records, written and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    final = dedup_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = cut(read_archives(spark, final).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    _folder(spark, folder, False)
    return found


OP5_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.*, CASE WHEN m.last IS NOT NULL AND p.page_id <> m.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.last IS NOT NULL AND p.page_id <> m.last THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""
