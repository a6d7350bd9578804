import hashlib
import zlib

from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import transport_stream as TS


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([64, 192, 150, 171, 176, 200, 3072, 70000]), st.integers(1, 9))
def test_round_trip(payload, unit, points):
    media = TS.mux(payload, unit, points)
    s = TS.demux(media)
    assert s.payload == payload and len(media) % 188 == 0 and set(media[::188]) <= {0x47}
    if payload:
        n = -(-len(payload) // unit)
        (one,) = s.streams
        assert s.errors == 0 and len(one.sizes) == n and one.random_access == [i % points == 0 for i in range(n)]
        assert one.stamps == [i * TS.TICKS for i in range(n)] and (one.program, one.pid, one.kind) == (1, TS.DATA_PID, TS.PRIVATE)


def test_every_length():
    for n in range(1, 800):
        assert TS.demux(TS.mux(bytes(i % 251 for i in range(n)), 400)).payload == bytes(i % 251 for i in range(n))


def test_damage_is_counted():
    media = TS.mux(bytes(range(256)) * 40)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert TS.demux(b"".join(packets[:5] + packets[6:])).errors >= 1
    assert TS.demux(media[:-3]).errors >= 1 and TS.demux(b"").payload == b"" and TS.demux(b"x" * 188 * 3).errors > 0
    broken = bytearray(media)
    broken[20] ^= 1  # within the first program table's body: its CRC fails, and later ones serve or nothing does
    TS.demux(bytes(broken))
    assert TS.crc_mpeg(b"123456789") == 0x0376E6E7


PAYLOAD = bytes(i * 7 % 251 for i in range(400 * 12))


def packets(unit=400, points=4):
    media = TS.mux(PAYLOAD, unit, points)
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def bodies(packets):
    """Which 400-byte units of PAYLOAD the reader gives, in order, and its errors."""
    m = TS.demux(b"".join(packets))
    units = [PAYLOAD[i : i + 400] for i in range(0, len(PAYLOAD), 400)]
    at, out = 0, []
    for n in (n for s in m.streams for n in s.sizes):
        out.append(units.index(m.payload[at : at + n]))
        at += n
    assert at == len(m.payload)
    return out, m.errors


def of(pid, packets):
    return [i for i, p in enumerate(packets) if (p[1] & 31) << 8 | p[2] == pid]


def starts(packets):
    return [i for i in of(TS.DATA_PID, packets) if packets[i][1] & 0x40]


def test_a_lost_packet_costs_its_unit_alone():
    p = packets()
    data = of(TS.DATA_PID, p)
    unit = {i: sum(s <= i for s in starts(p)) - 1 for i in data}
    for i in data:
        got, errors = bodies(p[:i] + p[i + 1 :])
        assert got == [u for u in range(12) if u != unit[i]] and errors >= 1, i


def test_a_duplicate_packet_is_legal_once():
    p = packets()
    for i in range(len(p)):
        got, errors = bodies(p[: i + 1] + p[i:])
        assert got == list(range(12)) and errors == 0, i
    i = of(TS.DATA_PID, p)[5]
    assert bodies(p[: i + 1] + [p[i], p[i]] + p[i + 1 :])[1] >= 1


def test_fields_beyond_their_end():
    p = packets()
    for i in range(len(p)):
        for size in (184, 255):
            broken = bytearray(p[i])
            broken[3] |= 0x20
            broken[4] = size
            got, errors = bodies(p[:i] + [bytes(broken)] + p[i + 1 :])
            assert errors >= 1 and len(got) >= 11


def test_no_start_at_all():
    p = [q if i not in starts(packets()) else bytes([q[0], q[1] & ~0x40, *q[2:]]) for i, q in enumerate(packets())]
    assert bodies(p) == ([], 1)


def test_announced_discontinuity():
    p = packets()
    first, second = starts(p)[:2]
    drop = [i for i in of(TS.DATA_PID, p) if i < second]
    marked = bytearray(p[first + 0])
    assert marked[3] & 0x20 and bodies([q for i, q in enumerate(p) if i not in drop]) == (list(range(1, 12)), 0)
    shifted = [bytes([*q[:3], q[3] & 0xF0 | (q[3] + 5) & 15, *q[4:]]) if i in of(TS.DATA_PID, p) and i >= starts(p)[4] else q for i, q in enumerate(p)]
    assert bodies(shifted) == (list(range(12)), 1)
    at = starts(p)[4]
    told = bytearray(shifted[at])
    told[5] |= 0x80
    assert bodies(shifted[:at] + [bytes(told)] + shifted[at + 1 :]) == (list(range(12)), 0)


def section_packets(pid, section, counter=0):
    """A section over as many packets as it takes."""
    out, data = [], b"\0" + section
    for i, at in enumerate(range(0, len(data), 184)):
        out.append(bytes([0x47, (0x40 if i == 0 else 0) | pid >> 8, pid & 255, 0x10 | (counter + i) % 16]) + data[at : at + 184].ljust(184, b"\xff"))
    return out


def test_two_programs_and_tables_longer_than_a_packet():
    p = packets()
    other = [bytes([q[0], q[1] & 0xE0 | 0x1F, 0x01, *q[3:]]) for q in (p[i] for i in of(TS.DATA_PID, p))]
    pat = TS._section(0, 1, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xE0 | 0x10, 0, 0, 2, 0xE0 | 0x11, 0]))
    filler = bytes([0x52, 200]) + bytes(200)  # a descriptor that makes the section longer than a packet
    one = TS._section(2, 1, bytes([0xE1, 0, 0xF0, len(filler)]) + filler + bytes([6, 0xE1, 0, 0xF0, 0]))
    two = TS._section(2, 2, bytes([0xFF, 1, 0xF0, 0, 15, 0xFF, 1, 0xF0, 3, 1, 1, 1, 27, 0xFF, 2, 0xF0, 0]))
    tables = section_packets(0, pat) + section_packets(0x1000, one) + section_packets(0x1100, two)
    m = TS.demux(b"".join(tables + [x for pair in zip((p[i] for i in of(TS.DATA_PID, p)), other, strict=True) for x in pair]))
    assert [(s.program, s.pid, s.kind) for s in m.streams] == [(1, 0x100, 6), (2, 0x1F01, 15), (2, 0x1F02, 27)]
    assert m.streams[0].payload == m.streams[1].payload == PAYLOAD and m.streams[2].payload == b"" and m.errors == 0


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_any_damage_is_survived(r):
    media = bytearray(b"".join(packets()))
    for _ in range(r.randint(1, 12)):
        at = r.randrange(len(media))
        if r.random() < 0.5:
            media[at] = r.randrange(256)
        else:
            del media[at : at + r.choice((1, 188, 188 * 3))]
    assert TS.demux(bytes(media)).errors >= 0


def test_query(spark):
    got = {r["doc_id"]: r for r in TS.op5_media(spark, str(DATA)).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert x["media_sha256"] == hashlib.sha256(TS.mux(payload)).hexdigest() and x["feature"].endswith("errors=0")


def test_odd_documents(odd, nothing):
    got = TS.read_media(TS.store_media(odd)).collect()
    assert len(got) == odd.count() and all(r["errors"] == 0 and r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in got)
    assert TS.read_media(TS.store_media(nothing)).count() == 0
