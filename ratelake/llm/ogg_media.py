"""Ogg media columns: payloads stored as 8-bit samples in two logical streams, and the reader for such bytes.

The reader verifies each page's checksum, reassembles packets from lacing values, demultiplexes the logical
streams by serial number and derives each packet's time span from granule positions.

A null or empty text is stored as one block of padding. Null media give null results; pages with a wrong
checksum are left out and counted, and packets that lack a part are dropped with them. Equal texts give equal bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the container format (RFC 3533).
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

BLOCK, RATE, SERIALS = 192, 8000, (1, 2)
#: Samples in a packet, segments in a page.
PACKET, SEGMENTS = 4 * BLOCK, 64
IDENT = struct.Struct("<8sIBB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, most significant bit first, from 0; zlib's runs over mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda checksum: HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, checksum, len(lacing)) + lacing
    return head(page_checksum(head(0) + body)) + body


def _pages(serial: int, packets: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(granule to sort by, page) of one logical stream; packets are (granule at their end, bytes)."""
    segments = []  # (bytes, granule if the segment ends a packet)
    for granule, data in packets:
        whole = len(data) // 255 * 255
        segments += [(data[i : i + 255], -1) for i in range(0, whole, 255)] + [(data[whole:], granule)]
    out, reached, at = [], 0, 0
    while at < len(segments):
        part = segments[at : at + (1 if not out else SEGMENTS)]
        granule = max(g for _, g in part)
        reached = max(reached, granule)
        flags = (FIRST if not out else 0) | (CONTINUED if at and segments[at - 1][1] < 0 else 0) | (LAST if at + len(part) == len(segments) else 0)
        out.append((reached, _page(serial, len(out), flags, granule, bytes(len(x) for x, _ in part), b"".join(x for x, _ in part))))
        at += len(part)
    return out


def encode(payload: bytes) -> bytes:
    """Packets of 8-bit mono samples dealt in turn to the logical streams, whose pages are interleaved by time."""
    streams: list[list[tuple[int, bytes]]] = [[(0, IDENT.pack(b"\x80pcm8   ", RATE, 1, k))] for k in range(len(SERIALS))]
    for i, start in enumerate(range(0, len(payload), PACKET)):
        data, stream = payload[start : start + PACKET], streams[i % len(SERIALS)]
        stream.append((stream[-1][0] + len(data), data))
    pages = [(k > 0, granule, serial, k, page) for serial, packets in zip(SERIALS, streams) for k, (granule, page) in enumerate(_pages(serial, packets))]
    return b"".join(p[-1] for p in sorted(pages))


def read_packets(media: bytes) -> tuple[list[tuple[float, float, int, bytes]], dict[str, int]]:
    """(start in s, end in s, serial, bytes) of every whole packet, by time; counts of streams, pages and bad pages."""
    held: dict[int, bytes | None] = {}
    sequence: dict[int, int] = {}
    rate: dict[int, int] = {}
    packets, n_pages, bad, at = [], 0, 0, media.find(CAPTURE)
    while 0 <= at and at + HEADER.size <= len(media):
        _, _, flags, granule, serial, number, checksum, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        lacing = media[at + HEADER.size : body]
        end = body + sum(lacing)
        if end > len(media) or page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            bad += 1
            at = media.find(CAPTURE, at + 4)
            continue
        n_pages += 1
        data = held.get(serial) if flags & CONTINUED and sequence.get(serial) == number - 1 else (None if flags & CONTINUED else b"")
        sequence[serial], done = number, []
        for size in lacing:
            data = None if data is None else data + media[body : body + size]
            body += size
            if size < 255:
                if data is not None:
                    done.append(data)
                data = b""
        held[serial] = data
        # The granule position is the time at the end of the last packet that ends here; those before it are counted back.
        spans, to = [], granule
        for data in reversed(done):
            if len(data) == IDENT.size and data[:1] == b"\x80":
                rate[serial] = IDENT.unpack(data)[1]
            else:
                spans.append((to - len(data), to, serial, data))
                to -= len(data)
        packets += spans[::-1]
        at = end if media[end : end + 4] == CAPTURE else media.find(CAPTURE, end)
    packets = [(a / rate.get(s, RATE), b / rate.get(s, RATE), s, x) for a, b, s, x in sorted(packets, key=lambda p: (p[0], p[2]))]
    return packets, {"streams": len(sequence), "pages": n_pages, "bad_pages": bad}


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK)


def ogg_encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes and media: each text, padded with spaces, as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = pa.array([encode(payload_of(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), media], [id_column, "n_bytes", "media"])

    out = T.StructType([docs.schema[id_column], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(id_column, text).mapInArrow(run, out)


def ogg_decode(media: DataFrame, column: str = "media") -> DataFrame:
    """The input's columns with the samples read back (``payload``) and ``feature``: stream, page and packet counts, seconds, mean and RMS level."""

    def read(data: bytes | None) -> tuple[bytes | None, str | None]:
        if data is None:
            return None, None
        packets, n = read_packets(data)
        payload = b"".join(p[3] for p in packets)
        level = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
        shape = (float(level.mean()), float(np.sqrt((level * level).mean()))) if len(level) else (0.0, 0.0)
        seconds = max((p[1] for p in packets), default=0.0)
        return payload, f"streams={n['streams']};pages={n['pages']};bad={n['bad_pages']};packets={len(packets)};seconds={seconds:.6f};mean={shape[0]:.4f};rms={shape[1]:.4f}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "payload", "feature"])

    out = T.StructType([*media.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])
    return media.mapInArrow(run, out)


def ogg_digest(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and features of every text's payload after storing it and reading it back."""
    found = ogg_decode(ogg_encode(docs))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
