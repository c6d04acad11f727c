"""Media columns in Ogg: payloads stored as 8-bit samples in paged, checksummed packets.

A file holds two logical streams: one of samples, one that tells how many of the samples
belong to the payload. Reading verifies each page's checksum, reassembles
packets from lacing values, takes the streams apart by serial number and
derives times from granule positions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4096
SAMPLES, EXTENT = b"pcm8", b"size"
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, neither mirrored nor inverted.

    zlib's CRC mirrors bits and inverts at both ends; mirrored input, a start
    value that cancels the inversion and a mirrored result give this one.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets: (data, granule position at its end). The first packet has a page of its own."""
    pages, lacing, body, flags, granule = [], [], [], FIRST, -1

    def flush(more: int, last: bool) -> None:
        nonlocal lacing, body, flags, granule
        head = _HEAD.pack(b"OggS", 0, flags | LAST * last, granule, serial, len(pages), 0, len(lacing))
        page = head + bytes(lacing) + b"".join(body)
        pages.append(page[:22] + struct.pack("<I", page_checksum(page)) + page[26:])
        lacing, body, flags, granule = [], [], more, -1

    for k, (data, at) in enumerate(packets):
        cuts = [data[i : i + 255] for i in range(0, len(data) + 1, 255)]  # a multiple of 255 ends with an empty cut
        for n, part in enumerate(cuts):
            if len(lacing) == 255:
                flush(CONTINUED * (n > 0), False)
            lacing.append(len(part))
            body.append(part)
        granule = at
        if k == 0 and len(packets) > 1:
            flush(0, False)
    flush(0, True)
    return pages


def write_ogg(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of the payload's bytes as samples; n_bytes of them are the payload proper."""
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    samples = [(SAMPLES + struct.pack("<IB", rate, 1), 0)]
    samples += [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    first, *rest = _pages(serial, samples)
    other, *tail = _pages(serial + 1, [(EXTENT, 0), (struct.pack("<Q", n_bytes), 0)])
    return b"".join([first, other, *tail, *rest])


def read_pages(data: bytes):
    """(flags, granule, serial, sequence, lacing, body) of each page; ValueError where the file is damaged."""
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError("page header cut off")
        mark, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if mark != b"OggS" or version or len(lacing) < n or end > len(data):
            raise ValueError("no whole page here")
        page = data[at:end]
        if page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError("page checksum differs")
        yield flags, granule, serial, sequence, lacing, page[27 + n :]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """The packets (data, granule of the page on which it ends) of each logical stream by serial number."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    opened: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    for flags, granule, serial, sequence, lacing, body in read_pages(data):
        if sequence != following.get(serial, 0) or bool(flags & FIRST) != (serial not in streams) or bool(flags & CONTINUED) != bool(opened.get(serial)):
            raise ValueError("a page is missing")
        following[serial] = sequence + 1
        packets, parts, at = streams.setdefault(serial, []), opened.setdefault(serial, []), 0
        for n in lacing:
            parts.append(body[at : at + n])
            at += n
            if n < 255:
                packets.append((b"".join(parts), granule))
                parts.clear()
    if any(opened.values()):
        raise ValueError("a packet is cut off")
    return streams


def read_ogg(data: bytes) -> dict:
    """payload, n_bytes, packets, seconds (the last granule's time) and features of the samples."""
    payload, rate, n_bytes, count, last = b"", RATE, 0, 0, 0
    for packets in demultiplex(data).values():
        head, *rest = packets
        if head[0].startswith(SAMPLES):
            rate, payload, count = struct.unpack_from("<I", head[0], 4)[0], b"".join(x for x, _ in rest), len(rest)
            last = max((g for _, g in rest), default=0)
        elif head[0].startswith(EXTENT):
            (n_bytes,) = struct.unpack("<Q", rest[0][0])
    if last != len(payload):
        raise ValueError("granule positions don't fit the samples")
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    turns = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    feature = f"rate={rate};packets={count};seconds={last / rate:.6f};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={turns}" if len(x) else ""
    return {"payload": payload, "n_bytes": n_bytes, "packets": count, "seconds": last / rate, "feature": feature}


def padded(text: str | None, multiple: int = 64) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple, and their number before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(1, -(-len(data) // multiple)) * multiple - len(data)), len(data)


def to_media(text: Column, rate: int = RATE) -> Column:
    """A binary column of Ogg files, one for each text; null counts as empty. Equal texts give equal bytes."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([write_ogg(*padded(t), rate) for t in texts], dtype=object)

    return of(text)


def from_media(media: Column) -> Column:
    """struct(payload, n_bytes, packets, seconds, feature, error) read from Ogg files.

    Null gives null fields. A damaged file gives null fields and the reason
    in error, so that one does not stop the job.
    """
    names = ("payload", "n_bytes", "packets", "seconds", "feature")

    @F.pandas_udf("struct<payload:binary,n_bytes:long,packets:long,seconds:double,feature:string,error:string>")
    def of(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                rows.append({"error": None, **(read_ogg(bytes(data)) if data is not None else dict.fromkeys(names))})
            except (ValueError, struct.error, IndexError) as e:
                rows.append({**dict.fromkeys(names), "error": str(e)})
        frame = pd.DataFrame(rows, columns=[*names, "error"], dtype=object)
        return frame.astype({"seconds": "float64"}).assign(n_bytes=frame.n_bytes.astype("Int64"), packets=frame.packets.astype("Int64"))

    return of(media)
