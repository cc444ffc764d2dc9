"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: the page of smallest id among those with equal payloads is a `response`, the others `revisit` it and store no payload.
Which is which is settled on digests alone, aggregated before they are joined; each task then packs its rows into archives of
about ARCHIVE_BYTES, which are rows of a table in the shared folder (executors have no other file system in common);
`export` copies archives to files where a folder is reachable from all executors.  Reading works on such rows and on
Spark's binaryFile rows alike: each frame is found by its block headers, decoded by itself, and its headers, lengths and
digest are checked.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id is kept as null; rows that
repeat one page_id and payload are all responses if it is the smallest id, else all revisits; equal payloads compare by
SHA-1; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import give_back, sample, spool

#: Magic number of the skippable frame that holds a dictionary, and of any frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, LEVEL, SAMPLE, DICTIONARY_BYTES = 4 << 20, 3, 300, 32 << 10
#: Payloads that a reader holds before it hands records on.
PART_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Upper halves of record ids: the lower half is the page's id.
NAMED, NAMELESS = 0x7175696C6C004000, 0x7175696C6C004001


class WarcError(ValueError):
    pass


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(NAMELESS << 64) if page_id is None else (NAMED << 64) | (page_id & (1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    if n >> 64 == NAMELESS:
        return None
    low = n & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A whole record.  The HTTP head of a revisit still tells the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n " else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its block headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        flags = data[at + 4]
        single, size_flag = flags >> 5 & 1, flags >> 6
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[size_flag]
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            if len(data) < at + 3:
                raise WarcError("a frame is cut off")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        at += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise WarcError("a frame is cut off") from None
    if at > len(data):
        raise WarcError("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; raises WarcError where headers, lengths or digests are wrong."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise WarcError("the dictionary is cut off")
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        try:
            whole = reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at {at}: {error}") from None
        yield parse_record(whole, at)
        at = end


def parse_record(whole: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    head, gap, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"record at {at}: no WARC head")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"record at {at}: can't read {line!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in headers]
    if missing or not headers["content-length"].isdigit():
        raise WarcError(f"record at {at}: {missing or 'content-length'} is missing")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"record at {at}: {len(rest) - 4} bytes, not {n}")
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        payload = rest[:n].partition(b"\r\n\r\n")[2]
        if headers["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
            raise WarcError(f"record at {at}: the payload isn't what its digest tells")
    return headers, rest[:n]


def decide(pages: DataFrame) -> DataFrame:
    """page_id, sha1 and refers_to of the revisits."""
    seen = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1")).distinct()
    first = seen.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return seen.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to")


def write_archives(pages: DataFrame) -> DataFrame:
    """archive, content: the archives, written in the shared folder."""
    drawn = sample(pages.select("page_id", "url", F.substring("html", 1, 4096).alias("html")), SAMPLE, "page_id", "url").collect()
    dictionary = train_dictionary([record(0, r["url"], (r["html"] or "").encode()) for r in drawn])
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    rows = keyed.join(decide(pages), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.col("s").isNotNull().alias("revisit"), F.spark_partition_id().alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
        frames: list[bytes] = []
        size = made = part = 0

        def archive() -> pa.RecordBatch:
            nonlocal size, made
            content = dictionary_frame(dictionary) + b"".join(frames)
            out = pa.record_batch([pa.array([f"pages-{part:05d}-{made:05d}.warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])
            frames.clear()
            size, made = 0, made + 1
            return out

        for batch in batches:
            for page_id, url, html, refers_to, revisit, part in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                frames.append(writer.compress(record(page_id, url, (html or "").encode(), refers_to, revisit)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
        if frames:
            yield archive()

    return spool(rows.mapInArrow(pack, "archive string, content binary"), "archives")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive to a file in a folder that every executor can open; archive and bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with open(os.path.join(folder, f".{name}.part"), "wb") as f:
                    f.write(content)
                os.replace(os.path.join(folder, f".{name}.part"), os.path.join(folder, name))
            yield pa.record_batch([batch.column("archive"), pa.array([len(x) for x in batch.column("content").to_pylist()], pa.int64())], ["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(put, "archive string, bytes bigint")


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of archives (column content, as from write_archives or binaryFile): RECORDS, and payload (binary) if asked for."""

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names, n = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), 7 if payload else 6

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names[:n])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for headers, block in read_archive(content.as_py()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                    kind = headers["warc-type"]
                    if kind == "response" and size != len(body):
                        raise WarcError(f"{headers['warc-record-id']}: payload of {len(body)} bytes, not {size}")
                    refers = headers.get("warc-refers-to")
                    rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, headers.get("warc-payload-digest", "").removeprefix("sha1:"), kind, page_of(refers) if refers else None, body if payload else None))
                    held += len(body) if payload else 256
                    if held >= PART_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)
        give_back()

    return archives.select("content").mapInArrow(read, RECORDS + (", payload binary" if payload else ""))


def report(pages: DataFrame) -> DataFrame:
    """The columns of query op9, read back from the archives."""
    return read_records(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
