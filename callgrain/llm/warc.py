"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends in a skippable frame with the seek table (compressed
and raw size of each frame), so that one frame can be read without the ones before it. An index maps each record to its
bundle, its frame and its place inside the frame. Of records with equal payloads of at least ``least`` bytes, the one
with the largest id is a response and the others are revisits that name it and hold no payload.

Bundles are rows of bytes of about ``bundle_bytes`` raw size, so any store that Spark writes to can hold them; ``save``
writes them as a table. A null payload is empty. A null id takes no part in finding copies: such a record is a response
of its own. Rows that repeat an id with the same payload are all responses if the id is the largest. A record is never
split, so a very long page makes a frame of its own. An empty table gives no bundles. Only the id, the address and the
payload are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(key: str, url: str, payload: bytes, digest: str, date: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. The digest and length of the whole payload are named in the head of revisits too."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", date),
        ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, head and payload of each record of a frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin, size = stop + 4, int(head["Content-Length"])
        block = data[begin : begin + size]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = begin + size + 4


def bundle(frames: list[bytes], level: int = 3) -> bytes:
    """Frames one after another, then the seek table."""
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    packed = [packer.compress(f) for f in frames]
    table = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames))
    foot = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, read from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle without checksums")
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(data: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, raw = entry
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=raw)


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Copies are found on digests alone; pages move once, and only if some are revisits."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least)).select("digest", "page_id")
    heads = large.groupBy("digest").agg(F.max("page_id").alias("head"), F.min("page_id").alias("first")).where("head <> first").select("digest", "head")
    joined = rows.join(heads, "digest", "left")
    own = F.col("page_id").isNull() | (F.col("page_id") == F.col("head")) | (F.octet_length("payload") < least)
    return joined.select("page_id", "url", "payload", "digest", F.when(~own, F.col("head")).alias("refers_to"))


def bundles(roles: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 23, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """(bundle_id, data, index): index is a list of (record, frame, place). A task holds one bundle at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        frames: list[bytes] = []
        open_frame: list[bytes] = []
        index: list[dict] = []
        size = total = 0

        def close_frame() -> None:
            nonlocal open_frame, size
            if open_frame:
                frames.append(b"".join(open_frame))
            open_frame, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal frames, index, made, total
            close_frame()
            out = pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()), pa.array([bundle(frames)], pa.binary()),
                 pa.array([index], pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("place", pa.int32())])))],
                names=["bundle_id", "data", "index"],
            )
            frames, index, total, made = [], [], 0, made + 1
            return out

        for batch in batches:
            for k, u, p, d, r in zip(*batch.columns):
                k, r = k.as_py(), r.as_py()
                got = record(str(k) if k is not None else "", u.as_py(), p.as_py(), d.as_py(), date, None if r is None else str(r))
                index.append({"record": None if k is None else str(k), "frame": len(frames), "place": size})
                open_frame.append(got)
                size, total = size + len(got), total + len(got)
                if size >= frame_bytes:
                    close_frame()
                if total >= bundle_bytes:
                    yield flush()
        if frames or open_frame:
            yield flush()

    return roles.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        run, "bundle_id long, data binary, index array<struct<record: string, frame: int, place: int>>"
    )


def save(made: DataFrame, folder: str) -> DataFrame:
    """Writes bundles and index as a table and reads it back."""
    made.write.mode("overwrite").parquet(folder)
    return made.sparkSession.read.schema(made.schema).parquet(folder)


def read_records(stored: DataFrame) -> DataFrame:
    """The records of all bundles, frame by frame through the seek table; digests are computed from payloads where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                for entry in seek_table(data):
                    rows = []
                    for _, head, payload in parse(read_frame(data, entry)):
                        kind, named = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != named:
                            raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
                        ref = head.get("WARC-Refers-To")
                        rows.append((head["WARC-Record-ID"][10:-1] or None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), named, kind, ref and ref[10:-1], payload))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))],
                        names=["record", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                    )

    return stored.select("data").mapInArrow(
        run, "record string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )


def locate(stored: DataFrame, record_id: str) -> bytes | None:
    """The payload of one record: its bundle and frame from the index, then that frame alone is unpacked."""
    hit = stored.where(F.exists("index", lambda x: x["record"] == record_id)).select("data", F.filter("index", lambda x: x["record"] == record_id)[0].alias("at")).first()
    if hit is None:
        return None
    frame = read_frame(bytes(hit["data"]), seek_table(bytes(hit["data"]))[hit["at"]["frame"]])
    return next(p for place, _, p in parse(frame) if place == hit["at"]["place"])
