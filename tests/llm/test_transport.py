import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remembrix.llm import transport as ts


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 255))
def test_round_trip_of_any_size(blocks, byte):
    payload = bytes([byte, 0x47, 0, 1]) * 16 * blocks
    streams = ts.demux(ts.mux(payload)).streams
    assert list(streams) == [ts.STREAM_PID]
    found = streams[ts.STREAM_PID]
    assert b"".join(found.units) == payload and found.gaps == 0 and found.kind == ts.PRIVATE_DATA
    assert found.ticks == [ts.FIRST_TICK + ts.TICKS * i for i in range(len(found.units))]
    assert found.access == [i % ts.KEY == 0 for i in range(len(found.units))]


@given(st.integers(1, 600))
def test_round_trip_of_odd_sizes(n):
    assert b"".join(ts.demux(ts.mux(b"x" * n)).streams[ts.STREAM_PID].units) == b"x" * n


def test_faults():
    good = bytearray(ts.mux(b"y" * 3000))
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7
    with pytest.raises(ValueError):
        ts.demux(bytes(good[:-1]))
    for at, wrong in ((188 * 2, 0), (10, 9)):
        bad = bytearray(good)
        bad[at] = wrong
        with pytest.raises(ValueError):
            ts.demux(bytes(bad))
    cut = ts.demux(bytes(good[: 188 * 4] + good[188 * 5 :])).streams[ts.STREAM_PID]
    assert cut.gaps == 1 and cut.damaged == [True] and len(cut.units[0]) == 3000 - 184
    with pytest.raises(ValueError, match="cut short"):
        ts.demux(bytes(good[: 188 * 4]))
    gap = bytearray(ts.mux(b"z" * 20000))
    gap[188 * 5 + 3] ^= 4
    assert ts.demux(bytes(gap)).streams[ts.STREAM_PID].gaps == 2
    wrong = bytearray(good)
    wrong[188 * 4 + 1] |= 0x80
    parsed = ts.demux(bytes(wrong))
    assert parsed.errors == 1 and parsed.streams[ts.STREAM_PID].gaps == 1
    twice = bytes(good[: 188 * 4] + good[188 * 3 : 188 * 4] + good[188 * 4 :])
    assert b"".join(ts.demux(twice).streams[ts.STREAM_PID].units) == b"y" * 3000


def plain_parse(stream):
    """A parser of its own, packet by packet and bit by bit: PIDs of the streams, and (payload, ticks, access) of each elementary packet."""
    sections, pes, program, entries = {}, {}, None, {}
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid, unit, control = (p[1] & 31) * 256 + p[2], p[1] // 64 % 2, p[3] // 16 % 4
        data, access = p[4:], False
        if control >= 2:
            access = p[4] > 0 and p[5] // 64 % 2 == 1
            data = p[5 + p[4] :]
        if control % 2 == 0:
            continue
        if pid == 0 or pid == program:
            data = data[1 + data[0] :] if unit else data
            size = 3 + data[1] % 16 * 256 + data[2]
            section = data[:size]
            value = 0xFFFFFFFF
            for byte in section:
                for bit in range(7, -1, -1):
                    top = (value >> 31) ^ (byte >> bit & 1)
                    value = (value << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
            assert value == 0
            if pid == 0:
                program = section[10] % 32 * 256 + section[11]
            else:
                entries[section[13] % 32 * 256 + section[14]] = section[12]
        elif pid in entries:
            if unit:
                pes.setdefault(pid, []).append([b"", access])
            pes[pid][-1][0] += data
    out = []
    for pid, packets in pes.items():
        for data, access in packets:
            assert data[:3] == b"\0\0\1" and len(data) == 6 + data[4] * 256 + data[5]
            bits = "".join(f"{b:08b}" for b in data[9:14])
            out.append((data[9 + data[8] :], int(bits[4:7] + bits[8:23] + bits[24:39], 2), access))
    return entries, out


@pytest.mark.parametrize("size", [64, 183, 8192, 8193, 100_000, 300_001])
def test_against_a_plain_parser(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    stream = ts.mux(payload)
    entries, packets = plain_parse(stream)
    found = ts.demux(stream).streams[ts.STREAM_PID]
    assert entries == {ts.STREAM_PID: ts.PRIVATE_DATA}
    assert packets == list(zip(found.units, found.ticks, found.access, strict=True))
    assert b"".join(p[0] for p in packets) == payload
    # entered at any random-access point, the rest is read
    tables = [i for i in range(0, len(stream), 188) if stream[i + 1] & 0x5F == 0x40 and stream[i + 2] == 0]
    assert len(tables) == sum(found.access)
    for k, at in enumerate(tables):
        assert b"".join(ts.demux(stream[at:]).streams[ts.STREAM_PID].units) == payload[k * ts.KEY * ts.UNIT :]


def packet(pid, begins, counter, payload, flags=None):
    """A packet with an adaptation field as long as needed."""
    if flags is None and len(payload) == 184:
        return ts._header(pid, begins, 1, counter) + payload
    field = bytes([flags or 0]) if len(payload) < 183 or flags else b""
    field += b"\xff" * (184 - len(payload) - 1 - len(field))
    return ts._header(pid, begins, 3, counter) + bytes([len(field)]) + field + payload


def test_sections_that_span_packets_and_flagged_jumps():
    body = (1).to_bytes(2, "big") + (0xE000 | 0x30).to_bytes(2, "big")
    long_ = b"".join((n).to_bytes(2, "big") + (0xE000 | 0x1F0).to_bytes(2, "big") for n in range(2, 60))
    head = lambda table, body: (s := bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body) + ts.crc32_mpeg(s).to_bytes(4, "big")
    association = b"\0" + head(0, body + long_)
    out = packet(0, True, 14, association[:184]) + packet(0, False, 15, association[184:])
    streams = (0x06E040).to_bytes(3, "big") + b"\xf0\0"
    out += packet(0x30, True, 3, b"\0" + head(2, b"\xe0\x40\xf0\0" + streams))
    data = [bytes([k]) * 100 for k in range(3)]
    pes = [b"\0\0\1\xbd" + (103).to_bytes(2, "big") + b"\x80\0\0" + d for d in data]
    out += packet(0x40, True, 5, pes[0]) + packet(0x40, True, 9, pes[1], flags=0x80) + packet(0x1FFF, False, 0, b"\xff" * 184) + packet(0x40, True, 11, pes[2])
    parsed = ts.demux(out)
    found = parsed.streams[0x40]
    assert found.units == data and found.ticks == [None] * 3 and found.gaps == 1 and parsed.table_gaps[0] == 0
    with pytest.raises(ValueError, match="CRC"):
        ts.demux(out[:30] + b"\x77" + out[31:])


def test_very_long_text(spark):
    text = "é" * 1_500_000
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, ticks int")
    r = ts.with_streams(df).select(ts.inspect("media").alias("x")).first().x
    assert r.payload_bytes == 3_000_000 and len(r.ticks) == -(-3_000_000 // ts.UNIT) and len(r.access_ticks) == -(-len(r.ticks) // ts.KEY)
    assert r.payload_sha256 == hashlib.sha256(ts.padded(text)).hexdigest()


def test_query_nulls_repeats_and_clashes(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = ts.op1_transport(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = ts.padded(texts[r.doc_id])
        stream = ts.mux(payload)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == texts[r.doc_id].encode().rstrip(b"\0")
        assert tuple(r)[1:7] == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
    df = spark.createDataFrame([(1, None, "m"), (1, "", "m"), (None, "a" * 64, None)], "doc_id long, text string, media string")
    got = ts.with_streams(df).collect()
    assert [bytes(r.media) for r in got] == [ts.mux(bytes(64)), ts.mux(bytes(64)), ts.mux(b"a" * 64)]
    assert ts.with_streams(df.limit(0)).collect() == []
