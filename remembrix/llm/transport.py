"""Media columns: payloads in MPEG transport streams.

mux() carries bytes in a single-program transport stream: packets of 188 bytes with continuity counters, and a private
elementary stream in timestamped packets of at most UNIT bytes, of which every KEY-th begins a random-access point
with a clock reference. The program association and program map tables, with their CRC, stand before each of these, so
that a reader can enter there. demux() parses any such stream: it puts sections together that span packets, reads the
tables, checks the counters of tables and streams, reassembles elementary packets, and gives their timestamps and
random-access points.

Defined cases: null and empty texts are 64 bytes 0; whole texts of any length; equal texts, equal streams; an empty
table gives no rows; only the text column is read and columns named as the result are replaced. A stream that breaks a
rule (sync byte, table CRC, packet length) raises ValueError. A gap in a counter is counted, and an elementary packet
that it cuts short is given as damaged; a jump that the discontinuity flag announces is no gap; packets flagged as
erroneous are counted and left out; a packet that repeats its predecessor's counter is read once.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

PACKET = 188
BLOCK = 64
#: Payload bytes of an elementary packet, and how many such packets lie between random-access points.
UNIT, KEY = 8192, 4
MAP_PID, STREAM_PID, PRIVATE_DATA = 0x1000, 0x100, 0x06
#: Ticks of the 90 kHz clock: of the first packet, and between packets.
FIRST_TICK, TICKS = 126_000, 3600


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value >> 31 else 0)
            value &= 0xFFFFFFFF
        out.append(value)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ _CRC[value >> 24 ^ byte]
    return value


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    """A packet's payload: pointer field, section with CRC, stuffing."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    return (b"\x00" + section + crc32_mpeg(section).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


def _header(pid: int, begins: bool, fields: int, counter: int) -> bytes:
    return bytes([0x47, begins << 6 | pid >> 8, pid & 0xFF, fields << 4 | counter & 15])


_ASSOCIATION = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
_MAP = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _tables(counter: int) -> bytes:
    return _header(0, True, 1, counter) + _ASSOCIATION + _header(MAP_PID, True, 1, counter) + _MAP


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def _clock(ticks: int) -> bytes:
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def _unit(data: bytes, number: int, counter: int) -> np.ndarray:
    """The packets of one elementary packet, as rows."""
    ticks = FIRST_TICK + number * TICKS & (1 << 33) - 1
    body = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + data
    key = number % KEY == 0
    field_ = bytes([0x50 if key else 0]) + (_clock(ticks) if key else b"")  # flags: random access and clock reference
    room = PACKET - 5 - len(field_)
    rest = max(0, len(body) - room)
    n = 1 + -(-rest // (PACKET - 4))
    rows = np.full((n, PACKET), 0xFF, np.uint8)
    counters = np.arange(counter, counter + n) & 15
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | counters
    rows[0, 1] |= 0x40
    rows[0, 3] |= 0x20
    bytes_ = np.frombuffer(body, np.uint8)
    first = min(room, len(body))
    rows[0, 4] = PACKET - 5 - first
    rows[0, 5 : 5 + len(field_)] = np.frombuffer(field_, np.uint8)
    rows[0, PACKET - first :] = bytes_[:first]
    whole = rest // (PACKET - 4)
    rows[1 : 1 + whole, 4:] = bytes_[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    if left := rest % (PACKET - 4):
        rows[-1, 3] |= 0x20
        rows[-1, 4] = PACKET - 5 - left
        if rows[-1, 4]:
            rows[-1, 5] = 0
        rows[-1, PACKET - left :] = bytes_[len(body) - left :]
    return rows


def mux(payload: bytes) -> bytes:
    out, counter = [] if payload else [_tables(0)], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        if number % KEY == 0:
            out.append(_tables(number // KEY))
        rows = _unit(payload[at : at + UNIT], number, counter)
        counter += len(rows)
        out.append(rows.tobytes())
    return b"".join(out)


@dataclass
class Elementary:
    """An elementary stream: its type, the payloads, timestamps, random-access flags and damage of its packets, and counter gaps."""

    kind: int
    units: list[bytes] = field(default_factory=list)
    ticks: list[int | None] = field(default_factory=list)
    access: list[bool] = field(default_factory=list)
    damaged: list[bool] = field(default_factory=list)
    gaps: int = 0


@dataclass
class Parsed:
    """Elementary streams by PID, counter gaps of tables by PID, and erroneous packets."""

    streams: dict[int, Elementary] = field(default_factory=dict)
    table_gaps: dict[int, int] = field(default_factory=dict)
    errors: int = 0


@functools.lru_cache(64)
def _checked(section: bytes) -> bytes:
    if crc32_mpeg(section) != 0:  # over its own CRC too
        raise ValueError("a table's CRC is wrong")
    return section


def sections(packets: Iterable[tuple[bool, bytes]]) -> list[bytes]:
    """The sections in packets (whether one begins there, payload): they may share packets, and span them."""
    out: list[bytes] = []
    held = None

    def take() -> bytes:
        rest = held
        while len(rest) >= 3 and rest[0] != 0xFF:
            end = 3 + (int.from_bytes(rest[1:3], "big") & 0xFFF)
            if len(rest) < end:
                break
            out.append(_checked(rest[:end]))
            rest = rest[end:]
        return rest

    for begins, payload in packets:
        if begins:
            start = 1 + payload[0]
            if held is not None:
                held += payload[1:start]
                take()
            held = payload[start:]
        elif held is not None:
            held += payload
        if held is not None:
            held = take()
    return out


def demux(stream: bytes) -> Parsed:
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("a packet lacks its sync byte")
    wrong = rows[:, 1] & 0x80 > 0
    parsed = Parsed(errors=int(wrong.sum()))
    rows = rows[~wrong]
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins, fields = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3
    start = np.where(fields & 2, 5 + rows[:, 4].astype(np.int32), 4)
    flags = np.where((fields & 2 > 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    if (start[fields & 1 == 1] > PACKET).any():
        raise ValueError("an adaptation field is too long")

    def payloads(of: int) -> tuple[np.ndarray, np.ndarray]:
        """The packets of a PID that have a payload, each once, and before which of them packets are missing."""
        own = np.nonzero((pid == of) & (fields & 1 == 1))[0]
        step = np.r_[1, np.diff(rows[own, 3] & 15) & 15][: len(own)]
        announced = flags[own] & 0x80 > 0
        again = (step == 0) & ~announced
        return own[~again], ((step != 1) & ~announced)[~again]

    def tables(of: int) -> list[bytes]:
        own, gaps = payloads(of)
        parsed.table_gaps[of] = int(gaps.sum())
        return list(dict.fromkeys(sections((bool(begins[i]), rows[i, start[i] :].tobytes()) for i in own)))

    for association in tables(0):
        for at in range(8, len(association) - 4, 4):
            if int.from_bytes(association[at : at + 2], "big"):
                for program in tables(int.from_bytes(association[at + 2 : at + 4], "big") & 0x1FFF):
                    at_ = 12 + (int.from_bytes(program[10:12], "big") & 0xFFF)
                    while at_ < len(program) - 4:
                        parsed.streams[int.from_bytes(program[at_ + 1 : at_ + 3], "big") & 0x1FFF] = Elementary(program[at_])
                        at_ += 5 + (int.from_bytes(program[at_ + 3 : at_ + 5], "big") & 0xFFF)
    for of, found in parsed.streams.items():
        own, gaps = payloads(of)
        found.gaps = int(gaps.sum())
        first = np.nonzero(begins[own])[0]
        sizes = PACKET - start[own]
        body = rows[own][np.arange(PACKET) >= start[own][:, None]].tobytes()
        at = np.r_[np.cumsum(sizes) - sizes, len(body)]
        lost = np.r_[0, np.cumsum(gaps)]
        for i, k in enumerate(first.tolist()):
            end = int(first[i + 1]) if i + 1 < len(first) else len(own)
            packet = body[at[k] : at[end]]
            if packet[:3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet lacks its start code")
            length, skip = int.from_bytes(packet[4:6], "big"), 9 + packet[8]
            damaged = bool(lost[end] > lost[k + 1])
            if length and length + 6 > len(packet) and not (damaged or end < len(own) and gaps[end]):
                raise ValueError("an elementary packet is cut short")
            found.units.append(packet[skip : length + 6 if length else len(packet)])
            p = packet[9:14]
            found.ticks.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if packet[7] & 0x80 else None)
            found.access.append(bool(flags[own[k]] & 0x40))
            found.damaged.append(damaged or bool(length and length + 6 > len(packet)))
    return parsed


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\x00")


@text_udf("binary")
def store(texts: list[str | None]) -> list[bytes]:
    """A text column's payloads as transport streams."""
    return [mux(padded(t)) for t in texts]


@text_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, ticks array<bigint>, access_ticks array<bigint>")
def inspect(media: list[bytes | None]) -> list[dict | None]:
    """What a column of transport streams holds: digests of its payload, timestamps of packets and of random-access points."""
    out: list[dict | None] = []
    for stream in media:
        if stream is None:
            out.append(None)
            continue
        parsed = demux(stream)
        streams = parsed.streams
        payload = b"".join(u for s in streams.values() for u in s.units)
        ticks = [t for s in streams.values() for t in s.ticks if t is not None]
        access = [t for s in streams.values() for t, a in zip(s.ticks, s.access, strict=True) if a and t is not None]
        feature = ";".join(f"pid={k},type={s.kind},packets={len(s.units)},gaps={s.gaps},damaged={sum(s.damaged)},ticks={s.ticks[0] if s.ticks else '-'}..{s.ticks[-1] if s.ticks else '-'},access={sum(s.access)}" for k, s in sorted(streams.items()))
        feature += f";table_gaps={sum(parsed.table_gaps.values())},errors={parsed.errors}"
        out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "feature": feature, "ticks": ticks, "access_ticks": access})
    return out


def with_streams(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with each text's transport stream; a column named out is replaced."""
    return df.withColumn(out, store(F.col(text)))


def op1_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = with_streams(docs).withColumn("read", inspect(F.col("media")))
    return read.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", "read.media_bytes", "read.media_sha256", "read.feature", "read.ticks", "read.access_ticks")
