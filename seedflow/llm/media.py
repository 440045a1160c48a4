"""Media columns: payload bytes kept as MPEG transport streams, and read back from them.

Writing: a payload is cut into access units of ``UNIT`` bytes, each one a PES packet of a private
data stream with a 33-bit PTS (90 kHz, ``TICKS`` apart); PES packets are cut into 188-byte transport
packets with continuity counters; PAT and PMT open the stream, and a private descriptor of the elementary
stream tells the payload's length; every ``GOP``-th unit is a random-access point (adaptation field with the
random-access flag and a PCR).

Reading: packets are found on the sync byte; program tables are reassembled from one or more packets and
parsed (section length and CRC-32/MPEG checked); continuity counters are checked on every PID, with announced
discontinuities let pass and legal duplicates skipped; elementary packets of one stream of the program are
reassembled from payload-unit starts; PTS, PCR and random-access points are stored with packet number and
payload offset. Nothing is lost without a mark: units that are shorter than their header says, a first unit
without its start and packets with the transport error flag count as ``damaged``, and ``missing`` is what the
payload lacks of the announced length (in a column: of the document's own length). Everything is vectorised
over the packets of one stream with numpy.

The query writes the media column as Parquet to the shared folder, and reads it back from there.

Defined cases: a null text is empty; the payload is padded with zero bytes to a positive multiple of
64, so it is never empty; equal texts give equal streams; an empty table gives an empty result; a
stream with a lost sync byte, a bad table, no program, no elementary packet, or a header that runs out of its
packet raises ``ValueError``, while continuity errors and damage only count; other columns are not read. A task holds one Arrow batch of rows, and of streams and
payloads those of at most ``HELD`` bytes of text, or of one text that is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint_table, load

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private PES data, private_stream_1
LENGTH_TAG = 0x81  # a user-private descriptor: the payload's length in eight bytes
NULL_PID = 0x1FFF
UNIT, TICKS, GOP = 4096, 3600, 8
#: Bytes of texts or streams that are worked on at a time.
HELD = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, table_ext: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + table_ext.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _psi(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _psi(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))


def _pmt(length: int) -> bytes:
    told = bytes([LENGTH_TAG, 8]) + length.to_bytes(8, "big")
    stream = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000 | len(told)).to_bytes(2, "big") + told
    return _psi(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + stream))


def _pes_header(size: int, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (size + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp


def _pcr(base: int) -> bytes:
    return bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])


def mux(payload: bytes, unit: int = UNIT, ticks: int = TICKS, gop: int = GOP) -> bytes:
    """The transport stream of a payload."""
    if not 0 < unit <= 65000:
        raise ValueError("a unit holds 1 to 65000 bytes")
    out, counter = [_PAT, _pmt(len(payload))], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        pts = k * ticks % (1 << 33)
        data = payload[at : at + unit]
        pes = _pes_header(len(data), pts) + data
        field_ = b"\x50" + _pcr(pts) if k % gop == 0 else b""  # random access and PCR
        first = PACKET - 4 - (1 + len(field_) if field_ else 0)
        cuts = [pes[:first], *(pes[i : i + PACKET - 4] for i in range(first, len(pes), PACKET - 4))]
        for i, part in enumerate(cuts):
            flags = field_ if i == 0 else b""
            room = PACKET - 4 - len(part)
            if room:  # adaptation field: its length byte, then flags and stuffing
                flags = (flags or (b"\x00" if room > 1 else b"")).ljust(room - 1, b"\xff")
                adapt = bytes([room - 1]) + flags
            else:
                adapt = b""
            out.append(bytes([SYNC, (0x40 if i == 0 else 0) | ES_PID >> 8, ES_PID & 0xFF, (0x30 if adapt else 0x10) | counter]) + adapt + part)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Demuxed:
    payload: bytes
    packets: int
    program: int
    pid: int
    stream_type: int
    #: (pid, stream type) of all elementary streams of the program
    streams: list[tuple[int, int]] = field(default_factory=list)
    continuity_errors: int = 0
    duplicates: int = 0
    units: int = 0
    #: units whose bytes are fewer than announced or lack their start, and packets with the error flag
    damaged: int = 0
    #: announced bytes that the payload lacks (0 where none are announced)
    missing: int = 0
    pts: list[int] = field(default_factory=list)
    #: (packet number, clock reference) of the stream's clock PID
    pcr: list[tuple[int, int]] = field(default_factory=list)
    #: (pts, packet number, offset in the payload) of every random-access point
    access_points: list[tuple[int, int, int]] = field(default_factory=list)


class Packets:
    """Transport packets as arrays."""

    def __init__(self, stream: bytes):
        if not stream or len(stream) % PACKET:
            raise ValueError("not whole transport packets")
        self.cells = p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
        if (p[:, 0] != SYNC).any():
            raise ValueError("sync byte lost")
        self.pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        self.error, self.start = (p[:, 1] & 0x80) > 0, (p[:, 1] & 0x40) > 0
        self.adapted, self.filled, self.counter = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0, (p[:, 3] & 0x0F).astype(np.int32)
        self.offset = np.where(self.adapted, 5 + p[:, 4].astype(np.int32), 4)
        if (self.offset > PACKET).any():
            raise ValueError("an adaptation field runs out of its packet")
        self.flags = np.where(self.adapted & (p[:, 4] > 0), p[:, 5], 0)
        self.duplicate = np.zeros(len(p), bool)
        self.continuity_errors = self._count()

    def _count(self) -> int:
        """Marks duplicates (a counter and bytes again, once) and counts the steps of counters that are wrong, on every PID."""
        own = np.flatnonzero(self.filled & (self.pid != NULL_PID))
        own = own[np.argsort(self.pid[own], kind="stable")]
        before, after = own[:-1], own[1:]
        plain = self.cells.copy()
        clocked = (self.flags & 0x10) > 0
        plain[clocked, 6:12] = 0  # a duplicate's clock reference may differ
        follows = self.pid[before] == self.pid[after]
        again = follows & (self.counter[before] == self.counter[after]) & (plain[before] == plain[after]).all(axis=1)
        again[1:] &= ~again[:-1]  # twice is not legal
        self.duplicate[after[again]] = True
        step = (self.counter[after] - self.counter[before]) % 16
        return int((follows & ~again & (step != 1) & ((self.flags[after] & 0x80) == 0)).sum())

    def of(self, pid: int) -> np.ndarray:
        return np.flatnonzero((self.pid == pid) & self.filled & ~self.duplicate)

    def section(self, pid: int) -> bytes:
        """The first whole section on a PID, from as many packets as it takes."""
        own = self.of(pid)
        first = np.flatnonzero(self.start[own])
        if not len(first):
            raise ValueError(f"no table on PID {pid}")
        data = bytearray()
        for k in range(first[0], len(own)):
            part = self.cells[own[k], self.offset[own[k]] :].tobytes()
            if self.start[own[k]]:
                if not part or 1 + part[0] > len(part):
                    raise ValueError("a pointer runs out of its packet")
                part = part[1 + part[0] :] if k == first[0] else part[1 : 1 + part[0]]
            elif len(data) >= 3 and (self.counter[own[k]] - self.counter[own[k - 1]]) % 16 != 1:
                break
            data += part
            if len(data) >= 3 and len(data) >= (size := 3 + ((data[1] & 0x0F) << 8 | data[2])):
                if crc32_mpeg(bytes(data[:size])):
                    break
                return bytes(data[:size])
            if self.start[own[k]] and k > first[0]:
                break
        raise ValueError("a program table is damaged")


def _streams(pmt: bytes) -> Iterator[tuple[int, int, int | None]]:
    """pid, type and announced length (if any) of the elementary streams."""
    at, end = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF), len(pmt) - 4
    while at + 5 <= end:
        kind, pid, more = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF
        told, k = None, at + 5
        at = k + more
        if at > end:
            raise ValueError("a program table is damaged")
        while k + 2 <= at:
            if pmt[k] == LENGTH_TAG and pmt[k + 1] == 8 and k + 10 <= at:
                told = int.from_bytes(pmt[k + 2 : k + 10], "big")
            k += 2 + pmt[k + 1]
        yield pid, kind, told


def demux(stream: bytes, program: int | None = None, pid: int | None = None) -> Demuxed:
    """Parse one elementary stream: the given one, or the first of the given or least program."""
    p = Packets(stream)
    pat = p.section(0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    programs.pop(0, None)  # the network table
    if not programs or (program is not None and program not in programs):
        raise ValueError("no program")
    program = min(programs) if program is None else program
    pmt = p.section(programs[program])
    streams = list(_streams(pmt))
    chosen = next((s for s in streams if pid is None or s[0] == pid), None)
    if chosen is None:
        raise ValueError("no elementary stream")
    pid, kind, told = chosen

    own = p.of(pid)
    units = np.flatnonzero(p.start[own])
    if not len(units):
        raise ValueError("no elementary packet")
    keep = np.arange(PACKET)[None, :] >= p.offset[own][:, None]
    data = p.cells[own][keep].tobytes()
    begins = np.concatenate([[0], np.cumsum(PACKET - p.offset[own])])
    out = Demuxed(b"", len(p.cells), program, pid, kind, [s[:2] for s in streams], p.continuity_errors, int(p.duplicate.sum()))
    out.damaged = int(p.error[own].sum()) + int(units[0] > 0)
    parts, done = [], 0
    random_access = (p.flags[own] & 0x40) > 0
    for u, k in enumerate(units):
        a, b = int(begins[k]), int(begins[units[u + 1]] if u + 1 < len(units) else begins[-1])
        pes = data[a:b]
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("no PES start code")
        if len(pes) < 9 or len(pes) < 9 + pes[8] or (pes[7] & 0x80 and pes[8] < 5):
            raise ValueError("a PES header runs out of its packets")
        if pes[7] & 0x80:
            s = pes[9:14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
            out.pts.append(pts)
            if random_access[k]:
                out.access_points.append((pts, int(own[k]), done))
        size = int.from_bytes(pes[4:6], "big")
        part = pes[9 + pes[8] : 6 + size if size else None]
        out.units += 1
        out.damaged += size > 0 and len(pes) < 6 + size
        parts.append(part)
        done += len(part)
    out.payload = b"".join(parts)
    out.missing = told - done if told is not None else 0
    clock = int.from_bytes(pmt[8:10], "big") & 0x1FFF
    for i in np.flatnonzero((p.pid == clock) & ((p.flags & 0x10) > 0) & (p.cells[:, 4] >= 7)):
        c = p.cells[i, 6:12].astype(np.int64)
        out.pcr.append((int(i), int((c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7) * 300 + ((c[4] & 1) << 8 | c[5]))))
    return out


def padded(n: int) -> int:
    """Bytes of the payload of a text of n bytes."""
    return max(-(-n // 64), 1) * 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(padded(len(raw)), b"\0")


def held(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in slices of at most ``HELD`` bytes in one column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the stored transport stream ``media`` of every row."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in held(batch, 1):
                made = [payload_of(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(x) for _, x in made], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(write, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


READ = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, program int, stream_type int, packets long, "
    "continuity_errors long, units long, damaged long, missing long, first_pts long, last_pts long, access_points array<struct<pts:long,packet:long,offset:long>>"
)


def read_media(media: DataFrame, id_col: str = "doc_id", payload: bool = True) -> DataFrame:
    """Demultiplex a media column: digests, tables, counters, timestamps, access points and, if asked for, the payload.

    ``missing``: bytes that the payload lacks of the document's padded length; below 0 if it has more.
    """
    ship(media.sparkSession)
    points = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("offset", pa.int64())]))
    names = [x.split()[0] for x in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in held(batch, 2):
                raw = [m.as_py() for m in b.column(2)]
                got = [demux(m) for m in raw]
                columns = [
                    pa.array([len(d.payload) for d in got], pa.int64()), pa.array([hashlib.sha256(d.payload).hexdigest() for d in got], pa.string()),
                    pa.array([zlib.crc32(d.payload[-64:]) for d in got], pa.int64()), pa.array([len(m) for m in raw], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in raw], pa.string()), pa.array([d.program for d in got], pa.int32()),
                    pa.array([d.stream_type for d in got], pa.int32()), pa.array([d.packets for d in got], pa.int64()),
                    pa.array([d.continuity_errors for d in got], pa.int64()), pa.array([d.units for d in got], pa.int64()),
                    pa.array([d.damaged for d in got], pa.int64()), pa.array([padded(n) - len(d.payload) for n, d in zip(b.column(1).to_pylist(), got, strict=True)], pa.int64()), pa.array([min(d.pts, default=None) for d in got], pa.int64()),
                    pa.array([max(d.pts, default=None) for d in got], pa.int64()),
                    pa.array([[dict(zip(("pts", "packet", "offset"), x, strict=True)) for x in d.access_points] for d in got], points),
                ]
                if payload:
                    columns.append(pa.array([d.payload for d in got], pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "n_bytes", *names, *(["payload"] if payload else [])])

    return media.select(id_col, "n_bytes", "media").mapInArrow(read, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes long, {READ}" + ", payload binary" * payload)


def feature() -> Column:
    """One line on a read stream: packets, units, damaged units, missing bytes, continuity errors, access points, first and last timestamp."""
    return F.format_string("packets=%d;units=%d;damaged=%d;missing=%d;cc=%d;rap=%d;pts=%d-%d", "packets", "units", "damaged", "missing", "continuity_errors", F.size("access_points"), "first_pts", "last_pts")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = checkpoint_table(media_column(load(spark, sf_dir, "documents")), "op3-media")
    read = read_media(stored, payload=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature().alias("feature"))


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES: dict[str, str] = {}
