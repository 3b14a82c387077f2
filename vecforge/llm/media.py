"""Media columns: payloads in MPEG transport streams, multiplexed and parsed back without loss."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm.common import prepare

#: Payloads are padded with spaces to a positive multiple of this.
FRAME = 192
#: Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
#: Bytes of an access unit, its samples at 8 kHz giving the timestamps; every so many units may be seeked to.
UNIT, RATE, SEEK_EVERY = 60 * FRAME, 8_000, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def section(table: int, ident: int, body: bytes) -> bytes:
    data = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return data + section_crc(data).to_bytes(4, "big")


def section_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + data).ljust(PACKET, b"\xff")


_TABLES = section_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + section_packet(PMT_PID, section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 1 | (pts << 1) & 0xFE])


def pts_value(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _stuffed(pid: int, counter: int, start: bool, data: bytes, flags: int = 0, clock: bytes = b"") -> bytes:
    """One packet whose adaptation field fills what data leaves."""
    length = PACKET - 5 - len(data)
    field = bytes([length]) + (bytes([flags]) + clock if length else b"")
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, 0x30 | counter]) + field.ljust(length + 1, b"\xff") + data


def multiplex(payload: bytes) -> bytes:
    """The payload as one elementary stream: PAT, PMT, then a PES packet per access unit.

    Each unit starts a packet with a program clock and, every SEEK_EVERY units, the random-access flag.
    """
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = at * CLOCK // RATE & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + pts_bytes(pts) + unit
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        flags = 0x10 | (0x40 if k % SEEK_EVERY == 0 else 0)
        first = min(len(pes), PACKET - 12)
        out.append(_stuffed(ES_PID, counter, True, pes[:first], flags, clock))
        counter = counter + 1 & 15
        n, rest = divmod(len(pes) - first, PACKET - 4)
        if n:
            full = np.empty((n, PACKET), np.uint8)
            full[:, 0], full[:, 1], full[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            full[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
            full[:, 4:] = np.frombuffer(pes, np.uint8, n * (PACKET - 4), first).reshape(n, PACKET - 4)
            out.append(full.tobytes())
            counter = counter + n & 15
        if rest:
            out.append(_stuffed(ES_PID, counter, False, pes[len(pes) - rest :]))
            counter = counter + 1 & 15
    return b"".join(out)


class BadStream(ValueError):
    """Bytes that are no such transport stream."""


def payload_starts(a: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; PACKET for one without payload."""
    kind = a[:, 3] >> 4 & 3  # 1 payload, 2 adaptation field, 3 both
    begin = np.where(kind & 2, 5 + a[:, 4].astype(np.int64), 4)
    if (kind == 0).any() or (begin > PACKET).any():
        raise BadStream("a packet's adaptation field is damaged")
    return np.where(kind & 1, begin, PACKET)


def parse_section(packets: np.ndarray, begins: np.ndarray, starts: np.ndarray, table: int) -> bytes:
    """The body of the first whole section of a table on one PID, its CRC checked; it may span packets."""
    for at in np.flatnonzero(starts & (begins < PACKET)).tolist():
        data = packets[at, begins[at] :].tobytes()
        data = data[1 + data[0] :]
        following = at + 1
        while len(data) < 3 or len(data) < 3 + ((data[1] & 0x0F) << 8 | data[2]):
            if following == len(packets) or starts[following]:
                raise BadStream(f"table {table} is cut off")
            data += packets[following, begins[following] :].tobytes()
            following += 1
        end = 3 + ((data[1] & 0x0F) << 8 | data[2])
        if data[0] == table:
            if end < 12 or section_crc(data[:end]):
                raise BadStream(f"table {table} is damaged")
            return data[8 : end - 4]
    raise BadStream(f"no table {table}")


def elementary(own: np.ndarray, begins: np.ndarray) -> dict:
    """payload, units (pts or None, offset, random access), breaks and duplicates of one PID's packets.

    Packets without payload don't count; a packet may be sent twice, and the second is left out. A break
    is a counter that doesn't follow the last, unless the packet says that it is discontinuous.
    """
    has = begins < PACKET
    own, begins = own[has], begins[has]
    counter = own[:, 3] & 15
    field = ((own[:, 3] & 0x20) != 0) & (own[:, 4] > 0)
    flags = np.where(field, own[:, 5], 0)
    again = np.zeros(len(own), bool)
    for i in (np.flatnonzero(counter[1:] == counter[:-1]) + 1).tolist():
        again[i] = not again[i - 1] and bool((own[i, begins[i] :] == own[i - 1, begins[i] :]).all() and begins[i] == begins[i - 1])
    own, begins, counter, flags = own[~again], begins[~again], counter[~again].astype(np.int64), flags[~again]
    breaks = int((((counter[1:] - counter[:-1]) % 16 != 1) & ((flags[1:] & 0x80) == 0)).sum())
    starts = (own[:, 1] & 0x40) != 0
    edges = [*np.flatnonzero(starts).tolist(), len(own)]
    units, parts, offset = [], [], 0
    for x, y in zip(edges, edges[1:], strict=False):
        short = np.flatnonzero(begins[x:y] != 4) + x
        pes, done = [], x
        for k in short.tolist():
            if k > done:
                pes.append(own[done:k, 4:].tobytes())
            pes.append(own[k, begins[k] :].tobytes())
            done = k + 1
        if y > done:
            pes.append(own[done:y, 4:].tobytes())
        data = b"".join(pes)
        length = int.from_bytes(data[4:6], "big")  # 0: up to the next packet
        if len(data) < 9 or data[:3] != b"\x00\x00\x01" or length and length + 6 != len(data) or data[6] & 0xC0 != 0x80 or len(data) < 9 + data[8]:
            raise BadStream("an elementary packet is damaged")
        body = data[9 + data[8] :]
        units.append((pts_value(data[9:14]) if data[7] & 0x80 else None, offset, bool(flags[x] & 0x40)))
        parts.append(body)
        offset += len(body)
    return {"payload": b"".join(parts), "units": units, "breaks": breaks, "duplicates": int(again.sum())}


def demultiplex(stream: bytes, strict: bool = False) -> dict:
    """Parse a stream: its programs' elementary streams, each with payload, units (pts, offset, random access) and counts.

    The program tables lead to the elementary streams, whose continuity counters are checked; ``strict``
    refuses a stream with breaks, since its payload isn't whole. payload and units are those of the
    first stream of the first program, breaks and duplicates of all; ``elementary`` lists all of them.
    """
    if not stream or len(stream) % PACKET:
        raise BadStream("no whole packets")
    a = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != SYNC).any():
        raise BadStream("a sync byte is missing")
    pid = (a[:, 1] & 0x1F).astype(np.int32) << 8 | a[:, 2]
    begins = payload_starts(a)

    def table(p: int, t: int) -> bytes:
        rows = pid == p
        return parse_section(a[rows], begins[rows], (a[rows, 1] & 0x40) != 0, t)

    pat = table(PAT_PID, 0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat), 4)}
    found = []
    for number, at_pid in sorted(programs.items()):
        if not number:  # the network's own table
            continue
        pmt = table(at_pid, 2)
        at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
        while at < len(pmt):
            p = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
            rows = pid == p
            found.append({"program": number, "type": pmt[at], "pid": p} | elementary(a[rows], begins[rows]))
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    if not found:
        raise BadStream("no elementary stream")
    breaks = sum(x["breaks"] for x in found)
    if strict and breaks:
        raise BadStream(f"{breaks} continuity errors")
    return {"payload": found[0]["payload"], "units": found[0]["units"], "packets": len(a), "programs": len([n for n in programs if n]), "streams": len(found), "breaks": breaks, "duplicates": sum(x["duplicates"] for x in found), "elementary": found}


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def features(parsed: dict) -> str:
    """Timestamps, random-access points and sample statistics of a parsed stream, as one string."""
    x = np.frombuffer(parsed["payload"], np.uint8).astype(np.int64)
    units = parsed["units"]
    seek = [(p, o) for p, o, s in units if s]
    return f"packets={parsed['packets']};programs={parsed['programs']};streams={parsed['streams']};breaks={parsed['breaks']};units={len(units)};pts={units[0][0]}-{units[-1][0]};seek={len(seek)}@{seek[-1][1]};sum={x.sum()};energy={(x * x).sum()};steps={np.abs(np.diff(x)).sum()}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            both = [padded(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([multiplex(p) for _, p in both], pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) in UTF-8, padded, as a transport stream."""
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_FIELDS = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_units", pa.int64()), ("first_pts", pa.int64()), ("last_pts", pa.int64()), ("seek_points", pa.list_(pa.int64())), ("continuity_errors", pa.int64()))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, blob in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
            media = blob.as_py()
            got = demultiplex(media, strict=True)
            p, units = got["payload"], got["units"]
            rows.append((doc.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(got), len(units), units[0][0], units[-1][0], [o for _, o, s in units if s], got["breaks"]))
        cols = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [k for k, _ in _FIELDS])


def read_media(media: DataFrame) -> DataFrame:
    """Parse the media column back: digests of what was stored, timestamps, random-access offsets, features.

    A stream that is damaged or has lost packets raises BadStream.
    """
    return media.mapInArrow(_parse, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, first_pts long, last_pts long, seek_points array<long>, continuity_errors long")


def media_columns(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """A row per row of ``docs``: stored and read back.

    A null or empty text is a payload of 192 spaces. Equal texts give equal values in all columns but
    doc_id; a null doc_id stays null; repeated rows repeat. Extra columns are ignored. Nothing is
    shuffled, and a task holds one batch of rows.
    """
    return read_media(to_media(docs, spark))

