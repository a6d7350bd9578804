"""MPEG transport streams: multiplexing bytes into packets, and reading packets back."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import held_id, pieces, real_id, small_batches, table

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, PRIVATE = 188, 0x47, 0, 0x1000, 0x100, 0x06
#: Bytes of an access unit, 90 kHz ticks from one to the next, and how often one is a random-access point.
UNIT, TICKS, RANDOM_ACCESS, ALIGN = 3072, 3600, 8, 192

_CRC = np.zeros(256, np.uint64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else _c << 1
    _CRC[_i] = _c
_CRC_LIST = [int(x) for x in _CRC]


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as program tables carry it: most significant bit first, all ones at the start, not inverted."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC_LIST[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 255, extension >> 8, extension & 255, 0xC1, 0, 0]) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])))


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def mux(payload: bytes, unit: int = UNIT, random_access: int = RANDOM_ACCESS) -> bytes:
    """One program with one stream of private data. Each access unit is an elementary packet with a time stamp;
    every `random_access`-th one is a random-access point, with a clock reference and the program tables before it."""
    data = np.frombuffer(payload, np.uint8)
    out, counter, tables = [], 0, 0
    for i, at in enumerate(range(0, len(data), unit)):
        body = data[at : at + unit]
        t = i * TICKS % (1 << 33)
        size = len(body) + 8
        head = b"\x00\x00\x01\xbd" + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(t)
        point = i % random_access == 0
        if point:
            for packet in (_PAT, _PMT):
                packet = packet.copy()
                packet[3] |= tables % 16
                out.append(packet[None])
            tables += 1
        es = np.concatenate([np.frombuffer(head, np.uint8), body])
        field_ = bytes([7, 0x50, t >> 25 & 255, t >> 17 & 255, t >> 9 & 255, t >> 1 & 255, (t & 1) << 7 | 0x7E, 0]) if point else b""
        room = 184 - len(field_)
        first, rest = es[:room], es[room:]
        n = 1 + -(-len(rest) // 184)
        p = np.zeros((n, PACKET), np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter += n
        whole = len(rest) // 184
        if len(first) == room:
            p[0, 4 : 4 + len(field_)] = np.frombuffer(field_, np.uint8)
            p[0, 3] |= 0x20 if field_ else 0
            p[0, PACKET - len(first) :] = first
        else:
            _stuffed(p[0], first, field_)
        if whole:
            p[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(-1, 184)
        if len(rest) % 184:
            _stuffed(p[n - 1], rest[whole * 184 :], b"")
        out.append(p)
    return np.concatenate(out).tobytes() if out else b""


def _stuffed(packet: np.ndarray, body: np.ndarray, field_: bytes) -> None:
    """A packet whose adaptation field is filled up with stuffing bytes."""
    length = 183 - len(body)
    packet[3] |= 0x20
    packet[4] = length
    if length:
        packet[5] = 0
        packet[6 : 5 + length] = 255
        if field_:
            packet[5 : 4 + len(field_)] = np.frombuffer(field_[1:], np.uint8)
    packet[PACKET - len(body) :] = body


@dataclass
class Stream:
    """One elementary stream: a row for each whole elementary packet, and their bodies joined."""

    program: int
    pid: int
    kind: int
    stamps: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    payload: bytes = b""


@dataclass
class Media:
    """What a transport stream held: its streams in the order of the program tables, and how much was wrong."""

    streams: list[Stream] = field(default_factory=list)
    errors: int = 0

    @property
    def payload(self) -> bytes:
        return b"".join(s.payload for s in self.streams)


@lru_cache(4096)
def _sound(section: bytes) -> bool:
    return crc_mpeg(section) == 0


class _Packets:
    """The packets of one PID that carry a payload, without duplicates: their bodies, and where the counter breaks.

    A packet repeated once, with the counter and the bytes of the one before it, is legal and dropped. A break is
    where the counter does not go on by one, unless the packet announces a discontinuity.
    """

    def __init__(self, p: np.ndarray, begin: np.ndarray):
        counter = (p[:, 3] & 15).astype(np.int64)
        same = np.zeros(len(p), bool)
        for i in np.flatnonzero(counter[1:] == counter[:-1]) + 1:
            same[i] = not same[i - 1] and begin[i] == begin[i - 1] and bytes(p[i, begin[i] :]) == bytes(p[i - 1, begin[i] :])
        self.p, self.begin = p[~same], begin[~same]
        counter, adapted = counter[~same], (self.p[:, 3] & 0x20 > 0) & (self.p[:, 4] > 0)
        self.starts = (self.p[:, 1] & 0x40) > 0
        self.breaks = np.zeros(len(self.p), bool)
        self.breaks[1:] = ((counter[1:] - counter[:-1]) % 16 != 1) & ~(adapted & (self.p[:, 5] & 0x80 > 0))[1:]
        self.random = adapted & (self.p[:, 5] & 0x40 > 0)


def _sections(packets: _Packets) -> tuple[list[bytes], int]:
    """The whole sections with a right CRC of a table's packets, however many packets each takes, and the errors met."""
    out, errors, held = [], int(packets.breaks.sum()), b""
    for row, begin, starts, broken in zip(packets.p, packets.begin, packets.starts, packets.breaks, strict=True):
        body = row[begin:].tobytes()
        if broken:
            held = b""
        if starts:
            pointer = body[0] if body else 0
            if held:
                held += body[1 : 1 + pointer]
                errors += _whole(held, out)[1] + int(len(held) < 3 or len(held) < 3 + _size(held))
            held = body[1 + pointer :]
        elif held:
            held += body
        held, wrong = _whole(held, out)
        errors += wrong
    return out, errors + int(bool(held))


def _size(section: bytes) -> int:
    return (section[1] & 15) << 8 | section[2]


def _whole(held: bytes, out: list[bytes]) -> tuple[bytes, int]:
    """Moves the whole sections at the front of `held` to `out`; what is left, and how many had a wrong CRC."""
    wrong = 0
    while len(held) >= 3 and held[0] != 0xFF and len(held) >= 3 + _size(held):
        section, held = held[: 3 + _size(held)], held[3 + _size(held) :]
        if len(section) >= 12 and _sound(section):
            out.append(section)
        else:
            wrong += 1
    return (b"" if held[:1] == b"\xff" else held), wrong


def _programs(sections: list[bytes]) -> list[tuple[int, int]]:
    """(program, PID of its table) of all sections of a program association table."""
    found: dict[int, int] = {}
    for s in sections:
        if s[0] == 0:
            for i in range(8, len(s) - 7, 4):
                if s[i] << 8 | s[i + 1]:
                    found.setdefault(s[i] << 8 | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3])
    return list(found.items())


def _streams(sections: list[bytes], program: int) -> list[tuple[int, int]]:
    """(PID, kind) of the streams that a program's table names."""
    found: dict[int, int] = {}
    for s in sections:
        if s[0] == 2 and s[3] << 8 | s[4] == program and len(s) >= 16:
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                found.setdefault((s[at + 1] & 31) << 8 | s[at + 2], s[at])
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    return list(found.items())


def _units(packets: _Packets, out: Stream) -> int:
    """Reads the elementary packets of one PID into `out`; returns the errors met.

    A unit is what runs from one start to the next, or to the first break of the counter. Units without the start
    code or shorter than they say are left out, and so are those of no stated size with a break; bytes beyond a
    unit's size are dropped; all are errors.
    """
    taken = np.arange(PACKET) >= packets.begin[:, None]
    raw = packets.p[taken].tobytes()
    ends = np.cumsum(PACKET - packets.begin)
    unit = np.flatnonzero(packets.starts)
    errors = int(packets.breaks.sum()) + int(len(packets.p) > 0 and (not len(unit) or unit[0] > 0))
    first = np.where(unit > 0, ends[unit - 1], 0)
    last = np.append(first[1:], len(raw))[: len(unit)]
    # what a unit has before its first break is sure; a break at a start may have taken the end of the unit before it
    owner, sure = np.cumsum(packets.starts) - 1, last.copy()
    for k in np.flatnonzero(packets.breaks & (owner >= 0) & ~packets.starts)[::-1].tolist():
        sure[owner[k]] = ends[k - 1]
    cut_off = set((owner[packets.breaks & packets.starts] - 1).tolist())
    bodies = []
    for i, (u, a, b) in enumerate(zip(unit.tolist(), first.tolist(), sure.tolist(), strict=True)):
        if b - a < 9 or raw[a : a + 3] != b"\x00\x00\x01":
            errors += 1
            continue
        size = raw[a + 4] << 8 | raw[a + 5]
        end, begin = (a + 6 + size if size else b), a + 9 + raw[a + 8]
        if end > b or begin > end or (not size and (b < last[i] or i in cut_off)):
            errors += 1
            continue
        errors += int(end < b == last[i])
        has = raw[a + 7] & 0x80 and begin >= a + 14
        out.stamps.append((raw[a + 9] & 14) << 29 | raw[a + 10] << 22 | (raw[a + 11] & 254) << 14 | raw[a + 12] << 7 | raw[a + 13] >> 1 if has else -1)
        out.sizes.append(end - begin)
        out.random_access.append(bool(packets.random[u]))
        bodies.append(raw[begin:end])
    out.payload = b"".join(bodies)
    return errors


def demux(media: bytes) -> Media:
    """Reads a stream, however damaged: all programs of the tables, continuity counters, elementary packets.

    Counted as errors: bytes after the last whole packet; packets without the sync byte, marked as damaged or
    with an adaptation field beyond their end (none of these is read); breaks of a counter; sections with a wrong
    CRC or cut off; missing tables; elementary packets left out or longer than they say, and bytes before the first.
    """
    out = Media()
    p = np.frombuffer(media[: len(media) // PACKET * PACKET], np.uint8).reshape(-1, PACKET)
    adapted = (p[:, 3] & 0x20) > 0
    begin = np.where(adapted, 5 + p[:, 4].astype(np.int64), 4)
    sound = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0) & (begin <= PACKET)
    out.errors += int(len(media) % PACKET > 0) + int((~sound).sum())
    read = sound & (p[:, 3] & 0x10 > 0)
    p, begin = p[read], begin[read]
    pids = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    of = lambda pid: _Packets(p[pids == pid], begin[pids == pid])
    sections, errors = _sections(of(PAT_PID))
    programs = _programs(sections)
    out.errors += errors + int(not programs and len(media) > 0)
    tables: dict[int, list[bytes]] = {}
    for program, table_pid in programs:
        if table_pid not in tables:
            tables[table_pid], errors = _sections(of(table_pid))
            out.errors += errors
        named = _streams(tables[table_pid], program)
        out.errors += int(not named)
        for pid, kind in named:
            stream = Stream(program, pid, kind)
            out.errors += _units(of(pid), stream)
            out.streams.append(stream)
    return out


def padded(text: str | None, align: int = ALIGN) -> tuple[bytes, int]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // align)) * align, b" "), len(raw)


def _write(batches):
    for x in batches:
        texts = x["text"].tolist()
        for a, b in pieces(texts, 2 << 20):
            made = [padded(t) for t in texts[a:b]]
            yield pd.DataFrame({"doc_id": x["doc_id"].iloc[a:b].to_numpy(), "n_bytes": [n for _, n in made], "media": [mux(p) for p, _ in made]})


def _read(batches):
    for x in batches:
        rows = []
        for media in x["media"]:
            m = demux(media)
            payload = m.payload
            units = [{"pid": s.pid, "stamp": t, "bytes": n, "random_access": r} for s in m.streams for t, n, r in zip(s.stamps, s.sizes, s.random_access, strict=True)]
            streams = [{"program": s.program, "pid": s.pid, "kind": s.kind, "bytes": len(s.payload)} for s in m.streams]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), units, streams, m.errors))
        got = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "units", "streams", "errors"])
        yield pd.concat([x[["doc_id", "n_bytes"]].reset_index(drop=True), got], axis=1)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded with spaces to a positive multiple of ALIGN, as a transport stream.

    Null texts are empty; equal texts give equal streams; null ids and repeated rows stay; an empty table gives
    an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(held_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(_write, "doc_id long, n_bytes long, media binary").withColumn("doc_id", real_id("doc_id"))


def read_media(stored: DataFrame) -> DataFrame:
    """Parses media: the payload's size and hashes (of all streams, in the tables' order), the elementary packets
    (PID, time stamp, bytes, random access), the streams (program, PID, kind, bytes) and the number of errors.

    A null value counts as empty; one without program tables has no packets and an error; damage is counted, and
    what it touches is left out (see `demux`).
    """
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, units array<struct<pid: int, stamp: long, bytes: long, random_access: boolean>>, streams array<struct<program: int, pid: int, kind: int, bytes: long>>, errors long"
    rows = stored.select(held_id("doc_id").alias("doc_id"), "n_bytes", F.coalesce("media", F.lit(b"")).alias("media"))
    return rows.mapInPandas(_read, kind).withColumn("doc_id", real_id("doc_id"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_media(store_media(table(spark, sf_dir, "documents", "doc_id", "text")))
    one = lambda c: F.get("streams", F.lit(0))[c]
    points = F.filter("units", lambda u: u["random_access"])
    feature = F.format_string(
        "program=%d;pid=%d;kind=%d;units=%d;random_access=%d;first=%d;last=%d;errors=%d",
        one("program"), one("pid"), one("kind"), F.size("units"), F.size(points), F.coalesce(F.get("units", F.lit(0))["stamp"], F.lit(-1)), F.coalesce(F.try_element_at("units", F.lit(-1))["stamp"], F.lit(-1)), "errors",
    )
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
