"""WARC archives of Zstandard frames: one record a frame, dictionary in a leading skippable frame.

Writing tasks put whole archives into a folder that Pyarrow's file systems reach from the
executors, each under a name given by its partition and number, by renaming a finished file:
a task that runs again writes the same files again.  Reading is Spark's binary file source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, small_batches

#: Payload bytes of an archive, about; a longer record has one of its own.
ARCHIVE_BYTES = 16 << 20
#: Pages that the dictionary is trained on, chosen by hash, and its size.
SAMPLE, DICTIONARY_BYTES = 300, 64 << 10
#: Characters of each that are read for it.
SAMPLE_CHARS = 1 << 16
#: Payloads from this size on are stored once.
LEAST_SHARED = 1000

SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_STEP = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest (SHA-1), record_type, refers_to: of equal payloads of at least
    LEAST_SHARED bytes the largest page_id's is the response, and others revisit it.

    pages: page_id, url, html; other columns are ignored.  Null html is empty.  Rows without
    page_id may revisit, but no row refers to them; rows that repeat the largest page_id and
    its payload are all responses.  A row for each input row; no rows give none.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    facts = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"))
    shared = facts.where(F.col("n") >= LEAST_SHARED)
    last = shared.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    revisits = shared.join(last, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()
    pages = pages.withColumn("digest", F.sha1("html"))
    out = pages.join(small(cut(revisits), 200_000), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of a bounded sample of pages; empty if the sample is too small for one.

    The pages with the smallest hashes are chosen by id, and then only these are fetched, each
    up to `SAMPLE_CHARS`: what reaches the driver is bounded.
    """
    key = F.xxhash64("page_id", F.octet_length("html"))
    some = pages.where("html is not null")
    last = some.select(key.alias("key")).orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0]
    rows = some.where(key <= last).select(F.substring("html", 1, SAMPLE_CHARS)).limit(2 * SAMPLE).collect() if last is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[0].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _uri(page_id: object) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, record_type: str, refers_to: object) -> bytes:
    """One WARC record: an HTTP response, or a revisit with the response's headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response"]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        fs.create_dir(root, recursive=True)
        words = dictionary.value
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        lead = struct.pack("<II", SKIPPABLE_DICTIONARY, len(words)) + words if words else b""
        part, number, frames, size = TaskContext.get().partitionId(), 0, [], 0

        written = []
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "record_type", "refers_to"))
            for cells in zip(*columns, strict=True):
                page_id, url, html, kind, refers = (c.as_py() for c in cells)
                payload = html.encode()
                frames.append(packer.compress(record(page_id, url, payload, kind, refers)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    written.append(_close(fs, root, part, number, lead, frames))
                    number, frames, size = number + 1, [], 0
        if frames:
            written.append(_close(fs, root, part, number, lead, frames))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in written], pa.string()), pa.array([n for _, n in written], pa.int64())], ["path", "records"])

    return run


def _close(fs: pafs.FileSystem, root: str, part: int, number: int, lead: bytes, frames: list[bytes]) -> tuple[str, int]:
    path = f"{root}/part-{part:07d}-{number:05d}.warc.zst"
    draft = f"{root}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft) as out:
        out.write(lead + b"".join(frames))
    fs.move(draft, path)
    return path, len(frames)


def write(planned: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write the pages of `plan` as archives; returns path and records of each.  It is lazy:
    an action on the result writes.  Rows are sorted in tasks, so that reruns write the same."""
    rows = small_batches(planned).sortWithinPartitions("page_id", "digest")
    return rows.mapInArrow(_writer(folder, planned.sparkSession.sparkContext.broadcast(dictionary)), "path string, records bigint")


def frames(content: bytes) -> Iterator[bytes | str]:
    """Records of an archive, decoded frame by frame; a text instead where one is broken.

    A dictionary frame itself may be compressed.  Other skippable frames are passed over.
    What follows a broken frame can't be found, so the archive ends there.
    """
    at, words = 0, None
    view = memoryview(content)
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at) if at + 8 <= len(content) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == SKIPPABLE_DICTIONARY and at == 0:
                words = content[8 : 8 + size]
                if words[:4] == ZSTD_MAGIC:
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
            at += 8 + size
            continue
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompressobj()
        out = []
        try:
            while not one.eof:
                if at >= len(content):
                    yield "frame: cut short"
                    return
                step = view[at : at + _STEP]
                out.append(one.decompress(step))
                at += len(step) - len(one.unused_data)
        except zstandard.ZstdError as e:
            yield f"frame: {e}"
            return
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Fields of a record; `error` says what is wrong with it, or is None."""
    out = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"error": "header: not a WARC record"}
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return out | {"error": f"header: no colon in {line[:40]!r}"}
        fields[k.strip().lower()] = v.strip()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing or not fields["content-length"].isdigit():
        return out | {"error": f"header: {', '.join(missing) or 'content-length'}"}
    n = int(fields["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or len(block) != n:
        return out | {"error": f"length: {len(rest) - 4} bytes for {n}"}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    if fields.get("warc-block-digest", "sha1:" + sha(block)) != "sha1:" + sha(block):
        return out | {"error": "digest: block"}
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "sha1:" + sha(payload)).removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (digest != sha(payload) or stated != len(payload)):
        return out | {"error": "digest: payload"}
    number = lambda uri: None if not uri or uri.endswith(":null>") else int(uri[len("<urn:x-page:") : -1])
    return out | {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": stated, "payload_digest": base64.b32decode(digest).hex(),
        "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


RECORD = "path string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, error string"


_KINDS = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, rows, size = path.as_py(), [], 0
                for raw in frames(content.as_py()):
                    row = parse(raw) if isinstance(raw, bytes) else {"error": raw}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row | {"path": path})
                    size += len(raw)
                    if size > ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(rows, _KINDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _KINDS)

    return run


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the folder's archives (`RECORD`), payload null for revisits.

    Frames that can't be decoded and records whose headers, lengths or digests are wrong are
    rows with `error`; the archive's later records follow unless a frame itself is broken.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(_reader(payloads), RECORD)
