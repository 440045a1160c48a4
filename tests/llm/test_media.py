import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seedflow.llm import media
from tests.llm.conftest import ROWS


@given(st.binary(max_size=9000), st.integers(1, 5000), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_round_trip(payload, unit, gop):
    if not payload:
        return
    stream = media.mux(payload, unit=unit, gop=gop)
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    got = media.demux(stream)
    units = -(-len(payload) // unit)
    assert got.payload == payload and got.continuity_errors == 0 and (got.program, got.pid) == (1, media.ES_PID)
    assert got.pts == [k * media.TICKS for k in range(units)]
    assert [(p, o) for p, _, o in got.access_points] == [(k * media.TICKS, k * unit) for k in range(0, units, gop)]


def test_every_length_round_trips():
    for n in range(1, 420):
        assert media.demux(media.mux(b"x" * n, unit=400)).payload == b"x" * n


def test_damage_is_seen():
    stream = media.mux(b"abc" * 3000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demux(b"".join(packets[:8] + packets[9:])).continuity_errors == 1
    with pytest.raises(ValueError):
        media.demux(b"\0" + stream[1:])
    with pytest.raises(ValueError):
        media.demux(packets[0][:12] + b"\xff" + packets[0][13:] + b"".join(packets[1:]))
    with pytest.raises(ValueError):
        media.demux(stream[:-1])
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_odd_rows(spark, empty, sf_dir):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.op3_media_columns(spark, sf_dir).collect()}
    for doc, text, *_ in ROWS:
        raw = (text or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = got[doc, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.mux(pad)).hexdigest() and r["media_bytes"] == len(media.mux(pad))
    assert got[5, 7]["feature"] == got[8, 7]["feature"]
    assert media.read_media(media.media_column(empty)).count() == 0


def plain_parser(stream):
    """A transport-stream reader of its own, packet by packet, for whole streams: program, stream type, payload, timestamps and access points."""
    psi, pes, starts = {}, {}, {}
    for number in range(len(stream) // 188):
        packet = stream[188 * number : 188 * number + 188]
        assert packet[0] == 0x47
        pid, control = int.from_bytes(packet[1:3], "big") & 8191, packet[3] >> 4 & 3
        at, access = 4, False
        if control & 2:
            at, access = 5 + packet[4], bool(packet[4] and packet[5] & 64)
        if not control & 1:
            continue
        body, first = packet[at:], bool(packet[1] & 64)
        if pid in (0, 4096):
            psi[pid] = body[1 + body[0] :] if first else psi[pid] + body
        elif first:
            pes.setdefault(pid, []).append(body)
            starts.setdefault(pid, []).append((number, access))
        else:
            pes[pid][-1] += body
    pat, pmt = psi[0], psi[4096]
    assert pat[0] == 0 and pmt[0] == 2 and int.from_bytes(pat[10:12], "big") & 8191 == 4096
    program, kind, pid = int.from_bytes(pat[8:10], "big"), pmt[12], int.from_bytes(pmt[13:15], "big") & 8191
    payload, pts, points = b"", [], []
    for unit, (number, access) in zip(pes[pid], starts[pid], strict=True):
        assert unit[:4] == bytes([0, 0, 1, 0xBD])
        bits = "".join(f"{b:08b}" for b in unit[9:14])
        pts.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        if access:
            points.append((pts[-1], number, len(payload)))
        payload += unit[9 + unit[8] : 6 + int.from_bytes(unit[4:6], "big")]
    return program, kind, pid, payload, pts, points


@given(st.binary(min_size=1, max_size=20000), st.integers(1, 6000), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_an_independent_parser_reads_the_same(payload, unit, gop):
    stream = media.mux(payload, unit=unit, gop=gop)
    got = media.demux(stream)
    assert plain_parser(stream) == (got.program, got.stream_type, got.pid, payload, got.pts, got.access_points)
    assert got.payload == payload and (got.continuity_errors, got.duplicates, got.damaged, got.missing) == (0, 0, 0, 0)
    assert [c for _, c in got.pcr] == [300 * p for p, *_ in got.access_points]


def flagged(stream):
    try:
        got = media.demux(stream)
    except ValueError:
        return True
    return bool(got.continuity_errors or got.damaged or got.missing)


def test_no_packet_or_unit_is_lost_without_a_mark():
    stream = media.mux(b"abc" * 3000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    for k in range(len(packets)):
        assert flagged(b"".join(packets[:k] + packets[k + 1 :])), k
    units = [k for k, x in enumerate(packets) if x[1] == 0x41] + [len(packets)]
    for a, b in zip(units, units[1:], strict=False):
        assert flagged(b"".join(packets[:a] + packets[b:])), a
    assert flagged(b"".join(packets[:2])) and flagged(b"".join(packets[: units[-2]]))
    assert media.demux(b"".join(packets[: units[-2]])).missing == len(media.demux(stream).payload) - 8192
    damaged = packets[5][:1] + bytes([packets[5][1] | 0x80]) + packets[5][2:]
    assert media.demux(b"".join(packets[:5] + [damaged] + packets[6:])).damaged == 1


def test_legal_duplicates_are_skipped_and_discontinuities_pass():
    stream = media.mux(bytes(range(256)) * 40)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    for k in range(len(packets)):
        got = media.demux(b"".join(packets[: k + 1] + packets[k:]))
        assert got.payload == bytes(range(256)) * 40 and (got.duplicates, got.continuity_errors, got.damaged, got.missing) == (1, 0, 0, 0)
    assert media.demux(b"".join(packets[:5] + [packets[4]] * 2 + packets[5:])).continuity_errors == 1
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    got = media.demux(b"".join(x + null for x in packets))
    assert got.payload == bytes(range(256)) * 40 and got.continuity_errors == 0
    packets = [x for s in [media.mux(bytes(range(256)) * 40, gop=1)] for x in (s[i : i + 188] for i in range(0, len(s), 188))]
    unit = next(k for k in range(3, len(packets)) if packets[k][1] == 0x41 and packets[k][5] & 0x40)
    jump = packets[:unit] + [packets[unit][:3] + bytes([packets[unit][3] & 0xF0 | 9]) + packets[unit][4:5] + bytes([packets[unit][5] | 0x80]) + packets[unit][6:]]
    assert media.demux(b"".join(jump)).continuity_errors == 0


def table(pid, section, pointer=0):
    """A section over as many packets as it takes."""
    data, out = bytes([pointer]) + b"\xff" * pointer + section, []
    for k, at in enumerate(range(0, len(data), 184)):
        out.append(bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x10 | k & 15]) + data[at : at + 184].ljust(184, b"\xff"))
    return b"".join(out)


def test_tables_of_several_packets_and_several_streams():
    """A program table with 60 streams and descriptors; the stream of the payload stands in the middle."""
    own = media.mux(b"payload " * 900)
    packets = [own[i : i + 188] for i in range(0, len(own), 188)][2:]
    entry = lambda pid, kind: bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | 6).to_bytes(2, "big") + b"\x0a\x04eng\x00"
    body = (0xE100).to_bytes(2, "big") + b"\xf0\x00" + b"".join(entry(0x200 + k if k != 30 else media.ES_PID, 0x1B if k != 30 else 6) for k in range(60))
    pmt = media._section(2, 7, body)
    assert len(pmt) > 3 * 184
    pat = media._section(0, 1, (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big") + (7).to_bytes(2, "big") + (0xE000 | 0x1000).to_bytes(2, "big"))
    other = [bytes([0x47, 0x42, k, 0x10]) + media._pes_header(100, 5) + b"x" * 100 + b"\xff" * 70 for k in (1, 2)]
    stream = table(0, pat, 9) + table(0x1000, pmt, 100) + b"".join(x + other[k % 2] if k < 2 else x for k, x in enumerate(packets))
    got = media.demux(stream, pid=media.ES_PID)
    assert got.payload == b"payload " * 900 and got.program == 7 and len(got.streams) == 60 and (got.stream_type, got.continuity_errors) == (6, 0)
    assert media.demux(stream, program=7, pid=0x201).payload == b"x" * 100
    for bad in ({"program": 3}, {"pid": 0x55}, {"pid": 0x250}):
        with pytest.raises(ValueError):
            media.demux(stream, **bad)
    for cut in range(1, 4):  # a packet of the table lost
        whole = table(0x1000, pmt, 100)
        with pytest.raises(ValueError):
            media.demux(table(0, pat) + whole[: 188 * cut] + whole[188 * cut + 188 :] + b"".join(packets), pid=media.ES_PID)


def test_headers_that_run_out_raise():
    stream = bytearray(media.mux(b"abc" * 100))
    stream[4] = 200  # pointer of the program association table
    with pytest.raises(ValueError):
        media.demux(bytes(stream))
    short = bytes([0x47, 0x41, 0, 0x30, 177, 0x50]) + b"\0" * 176 + b"\x00\x00\x01\xbd\x00\x00"
    assert len(short) == 188
    with pytest.raises(ValueError):
        media.demux(media.mux(b"abc")[:376] + short)
    with pytest.raises(ValueError):
        media.demux(media.mux(b"abc")[:376] + bytes([0x47, 0x41, 0, 0x30, 184]) + b"\0" * 183)


def test_missing_bytes_of_a_column(spark):
    docs = spark.createDataFrame([(1, "x" * 9000), (2, "y")], "doc_id long, text string")
    stored = media.media_column(docs).collect()
    cut = [(r["doc_id"], r["n_bytes"], bytes(r["media"])[: 188 * 24] if r["doc_id"] == 1 else bytes(r["media"])) for r in stored]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame(cut, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["missing"] > 0 and got[1]["payload_bytes"] + got[1]["missing"] == media.padded(9000) and got[2]["missing"] == 0
