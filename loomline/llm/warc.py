"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own.  After the frames come
an index in a skippable frame, which maps each record's identifier to its frame and
its offset within that frame, and the seek table of the seekable format, which gives
the frames' sizes.  So a record is read by its identifier from the file's end and one
frame, and an ordinary decompressor still reads the whole archive.

Payloads that are equal and long enough are stored once: the record with the smallest
id is the response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .exchange import landed, shared_dir
from .files import read_file, write_file

#: Fixed values of the seekable format and of skippable frames.
_SEEKABLE, _TABLE_FRAME, _INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, FILE_BYTES, LEAST_REVISIT = 256 << 10, 16 << 20, 100
#: Groups of more equal payloads are joined by a broadcast; there are at most rows / LARGE_GROUP of them.
LARGE_GROUP = 1_000_000


def _header_text(value: str | None) -> str:
    """A header's value: control characters, which could end the line, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place after) of the record at a place."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, data[stop + 4 : end], end + 4


def bundle(records, frame_bytes: int = FRAME_BYTES) -> list[bytes]:
    """The parts of a bundle of (identifier, record) pairs."""
    packer, out, table, index, held, size = zstandard.ZstdCompressor(level=3), [], [], [], [], 0

    def close():
        out.append(packer.compress(b"".join(held)))
        table.append((len(out[-1]), size))

    for name, data in records:
        if size and size + len(data) > frame_bytes:
            close()
            held, size = [], 0
        index.append((name, len(table), size))
        held.append(data)
        size += len(data)
    if held:
        close()
    names = packer.compress(json.dumps(index).encode())
    out.append(struct.pack("<II", _INDEX_FRAME, len(names)) + names)
    seek = b"".join(struct.pack("<II", *x) for x in [*table, (len(out[-1]), 0)])
    foot = seek + struct.pack("<IBI", len(table) + 1, 0, _SEEKABLE)
    return [*out, struct.pack("<II", _TABLE_FRAME, len(foot)) + foot]


def frames(path: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """((start, compressed size, size) of each frame, (identifier, frame, offset) of each record), from a bundle's end."""
    count, _, magic = struct.unpack("<IBI", read_file(path, -9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    foot = 9 + 8 * count
    sizes = list(struct.iter_unpack("<II", read_file(path, -foot, 8 * count)))
    at, places = 0, []
    for packed, size in sizes:
        places.append((at, packed, size))
        at += packed
    start, packed, _ = places.pop()
    index = json.loads(zstandard.ZstdDecompressor().decompress(read_file(path, start + 8, packed - 8)))
    return places, [tuple(x) for x in index]


def lookup(path: str, name: str) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record with an identifier; one frame is read."""
    places, index = frames(path)
    frame, offset = next((f, o) for n, f, o in index if n == name)
    start, packed, size = places[frame]
    return parse(zstandard.ZstdDecompressor().decompress(read_file(path, start, packed), max_output_size=size), offset)[:2]


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload_digest and refers_to of the records that revisit another.

    Only ids and digests are shuffled.  The smallest id of each digest is found with
    partial sums.  The join back deals both sides by digest; the few groups too large
    for a task are joined where their rows are, by a broadcast of a row for each.  Rows
    that repeat the response's id stay responses; a null id never is the smallest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = landed(pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.length(payload).alias("n")).where(F.col("n") >= least).drop("n"))
    first = landed(rows.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL"))
    groups = (first.where(F.col("n") <= LARGE_GROUP), F.broadcast(first.where(F.col("n") > LARGE_GROUP)))
    found, large = (rows.join(g.drop("n"), "payload_digest").where("NOT (page_id <=> refers_to)") for g in groups)
    return found.union(large).select("page_id", "payload_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) and gives a table of the bundles' paths.

    A null html is an empty payload, a null url an empty target; other columns aren't
    written.  A record's identifier is made of its id alone, so lookup() finds the first
    of rows that repeat an id, or have none; read_archives() gives all of them.
    """
    again = revisits(pages).select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.join(again, F.expr("page_id <=> again_id AND payload_digest = again_digest"), "left").drop("again_id", "again_digest")

    def run(stream):
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close(count):
            path = f"{folder}/pages-{part:07d}-{count:05d}.warc.zst"
            write_file(path, bundle(held))
            return pa.record_batch({"path": pa.array([path])})

        for block in stream:
            for page_id, url, payload, digest, refers_to in zip(*(block[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                data = record(page_id, url, payload, digest, refers_to, date)
                held.append((f"urn:page:{'null' if page_id is None else page_id}", data))
                size += len(data)
                if size >= FILE_BYTES:
                    yield close(count)
                    held, size, count = [], 0, count + 1
        if held:
            yield close(count)

    return landed(rows.mapInArrow(run, "path string"))


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text not in ("", "null") else None


def read_archives(paths: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record; digests of responses are checked."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(stream):
        for block in stream:
            for path in block["path"].to_pylist():
                places, index = frames(path)
                data, starts, out = read_file(path), {}, []
                for _, frame, offset in index:
                    starts.setdefault(frame, []).append(offset)
                for frame, offsets in starts.items():
                    at, packed, size = places[frame]
                    text = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)
                    for offset in offsets:
                        head, body, _ = parse(text, offset)
                        stop = body.index(b"\r\n\r\n") + 4
                        length = int(body[:stop].rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (len(body) - stop != length or hashlib.sha256(body[stop:]).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        out.append((_number(head["WARC-Record-ID"]), head["WARC-Target-URI"], length, digest, head["WARC-Type"], _number(head.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return paths.repartition(tasks).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """The records of pages, written to the shared folder and read back: a row for every row of pages, repeated ones too.

    Nulls and other columns are as of write_archives(); an empty table has no rows.
    """
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
