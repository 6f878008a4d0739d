"""Byte payloads as MPEG transport streams (ISO/IEC 13818-1), written and parsed in tasks.

A stream carries one program: PAT on PID 0, PMT on PID 0x1000, and one private elementary stream
(stream type 6, stream id 0xBD) on PID 0x100 that also holds the clock. The payload is cut into
access units of UNIT bytes, one packetised elementary packet each, with a time stamp TICKS after
the one before; every GOP-th unit starts with a random-access point and a clock reference.

The parser takes any stream of 188-byte packets: it follows PAT and PMT (sections of one or several
packets, several in one, with their checksums), checks continuity counters per PID (a packet may
be repeated once, which is ignored), reassembles elementary packets, and returns time stamps and
random-access points. Where a packet does not begin with the sync byte, it goes on at the next place
where two packets do.

Defined results: a null text has the empty payload's stream; equal texts give equal streams, and
repeated rows have one each; a null id stays null; a very long text is one stream, in memory of a few
times its bytes; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.blocks import row_blocks, texts
from tidewater.llm.storage import bounded

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, NULL_PID = 188, 0x47, 0, 0x1000, 0x100, 0x1FFF
PRIVATE_TYPE, PRIVATE_ID = 6, 0xBD
UNIT, TICKS, GOP, ALIGN = 9216, 3600, 8, 576


def _crc_table() -> list[int]:
    """The checksum of program tables: polynomial 0x04C11DB7, most significant bit first."""
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID,
    _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def _clock(base: int) -> bytes:
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The transport stream that carries the payload."""
    out, counter = [TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data, pts = payload[at : at + UNIT], unit * TICKS & (1 << 33) - 1
        body = _stamp(pts) + data
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(body) + 3).to_bytes(2, "big") + b"\x84\x80\x05" + body
        field_ = b"\x07\x50" + _clock(pts) if unit % GOP == 0 else b""
        start, pos = 0x40, 0
        while pos < len(pes):
            room = 184 - len(field_)
            part = pes[pos : pos + room]
            if short := room - len(part):
                if not field_:
                    field_ = b"\x00" if short == 1 else bytes([short - 1, 0]) + b"\xff" * (short - 2)
                else:
                    field_ = bytes([field_[0] + short]) + field_[1:] + b"\xff" * short
            out.append(bytes([SYNC, start | DATA_PID >> 8, DATA_PID & 255, (0x30 if field_ else 0x10) | counter]) + field_ + part)
            counter, start, pos, field_ = counter + 1 & 15, 0, pos + room, b""
    return b"".join(out)


@dataclass
class Stream:
    """What a parsed transport stream holds of its first program's elementary streams."""

    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, bool, bytes]] = field(default_factory=list)
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    bad_tables: int = 0

    def payload(self, pid: int) -> bytes:
        return b"".join(u[3] for u in self.units if u[0] == pid)


class _Sections:
    """Sections of one table PID, which may begin anywhere in a packet and go over several."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def add(self, body: bytes, start: bool) -> tuple[list[bytes], int]:
        """Whole sections that a packet's payload ends, and how many it breaks off."""
        out, broken = [], 0
        if start and body:
            self._take(out, body[1 : 1 + body[0]])
            broken = int(self.held is not None)
            self.held = b""
            body = body[1 + body[0] :]
        self._take(out, body)
        return out, broken

    def _take(self, out: list[bytes], more: bytes) -> None:
        if self.held is None:
            return
        self.held += more
        while self.held is not None and len(self.held) >= 3:
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if self.held[0] == 0xFF:  # stuffing up to the packet's end
                self.held = None
            elif len(self.held) < size:
                return
            else:
                out.append(self.held[:size])
                self.held = self.held[size:] or None
        if self.held is not None and self.held[:1] in (b"", b"\xff"):
            self.held = None


def _next_sync(stream: bytes, at: int) -> int:
    """The next place from which two packets begin with the sync byte, or the last one does."""
    while (at := stream.find(SYNC, at)) >= 0:
        if at + PACKET >= len(stream) or stream[at + PACKET] == SYNC:
            return at
        at += 1
    return len(stream)


def demux(stream: bytes) -> Stream:
    """Parse a transport stream; damaged parts are counted, and never raise."""
    s = Stream()
    last: dict[int, tuple[int, bytes, bool]] = {}
    open_: dict[int, tuple[list[bytes], bool]] = {}
    tables: dict[int, _Sections] = {}
    sound: dict[bytes, bool] = {}

    def close(pid: int) -> None:
        parts, access = open_.pop(pid, ([], False))
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            return
        size, begin = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        end = 6 + size if size else len(pes)
        pts = None
        if pes[7] & 0x80 and len(pes) >= 14:
            pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
        s.units.append((pid, pts, access, pes[begin:end]))

    at = -PACKET
    while (at := at + PACKET) <= len(stream) - PACKET:
        p = stream[at : at + PACKET]
        if p[0] != SYNC:
            s.gaps += 1
            at = _next_sync(stream, at + 1) - PACKET
            continue
        s.packets += 1
        if p[1] & 0x80:
            s.gaps += 1
            continue
        pid, control, counter = (p[1] & 0x1F) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        if pid == NULL_PID or not control & 1:
            continue
        begin, access, jump = 4, False, False
        if control & 2:
            begin += 1 + p[4]
            if p[4]:
                access, jump = bool(p[5] & 0x40), bool(p[5] & 0x80)
        body = p[begin:]
        if pid in last and not jump:
            if counter == last[pid][0] and body == last[pid][1] and not last[pid][2]:
                s.repeats += 1
                last[pid] = counter, body, True
                continue
            if counter != last[pid][0] + 1 & 15:
                s.gaps += 1
                open_.pop(pid, None)
                tables.pop(pid, None)
        last[pid] = counter, body, False
        if pid == PAT_PID or pid in s.programs.values():
            found, broken = tables.setdefault(pid, _Sections()).add(body, bool(p[1] & 0x40))
            s.bad_tables += broken
            for section in found:
                if section not in sound:
                    sound[section] = len(section) >= 12 and crc32_mpeg(section) == 0
                if not sound[section]:
                    s.bad_tables += 1
                elif pid == PAT_PID:
                    for i in range(8, len(section) - 4, 4):
                        if number := int.from_bytes(section[i : i + 2], "big"):
                            s.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
                else:
                    i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                    while i + 5 <= len(section) - 4:
                        s.types[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                        i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
        elif pid in s.types:
            if p[1] & 0x40:
                close(pid)
                open_[pid] = [body], access
            elif pid in open_:
                open_[pid][0].append(body)
    for pid in list(open_):
        close(pid)
    return s


def pad(text: bytes, multiple: int = ALIGN) -> bytes:
    """The text and bytes 255 up to a positive multiple of `multiple`."""
    return text.ljust(max(1, -(-len(text) // multiple)) * multiple, b"\xff")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in row_blocks(batch, "text"):
            raw = texts(block.column(1))
            yield pa.RecordBatch.from_arrays(
                [block.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64())]))
READ_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_packets long, n_gaps long, units array<struct<pts:long,random_access:boolean,offset:long,size:long>>"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(9)]
        for media in texts(batch.column(2)):
            s = demux(media)
            pid = min(s.types, default=DATA_PID)
            own = [u for u in s.units if u[0] == pid]
            payload, offset, units = b"".join(u[3] for u in own), 0, []
            for _, pts, access, data in own:
                units.append({"pts": pts, "random_access": access, "offset": offset, "size": len(data)})
                offset += len(data)
            stamps = [u["pts"] for u in units if u["pts"] is not None]
            feature = (
                f"mpegts programs={len(s.programs)} type={s.types.get(pid, 0)} packets={s.packets} units={len(units)} access={sum(u['random_access'] for u in units)} "
                f"pts={min(stamps, default=-1)}..{max(stamps, default=-1)} gaps={s.gaps} repeats={s.repeats} bad_tables={s.bad_tables}"
            )
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.packets, s.gaps, units)
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), UNITS]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [f.split()[0] for f in READ_SCHEMA.split(", ")])


def to_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes and its text as a transport stream."""
    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the streams of a media column hold: digests, and units with time stamps, random-access
    flags and places in the payload."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ_SCHEMA)
