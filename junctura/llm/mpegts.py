"""MPEG transport streams as media columns.

``mux`` stores bytes (8-bit samples of one stream, zero-padded) as a transport
stream of 188-byte packets: a program association and a program map table before
each random access point, and packetised elementary stream (PES) units with
presentation times, the first packet of every ``access_every``-th unit marked as
random access and carrying a clock reference. ``parse`` reads any such stream
back: tables (with their CRC; sections may run over packets, and several may be
in one), continuity counters, the units of each elementary stream, their
timestamps and the random access points.

Defined cases: null media or fewer than a packet's bytes parse to no programs
and no units; packets without the sync byte, or that claim more header than
they have, are counted as damaged and skipped; a repeated packet (same counter
and bytes) counts once; a counter that jumps without the discontinuity flag is
an error and the unit goes on with what came; a section that is too short for
its own fields, or never ends, is counted as damaged and skipped, one with a
wrong CRC is counted as such and skipped, and one that isn't in force yet is
skipped; a null text is stored as padding alone; a very long one is one row,
muxed and parsed in memory of a few times its size. Rows are independent, so repeated rows, null ids and empty tables need no
care; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC, PAYLOAD = 188, 0x47, 184
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xC0
# Stream ids of padding, and of those whose units have no optional header.
PADDING_ID, BARE_IDS = 0xBE, frozenset({0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF})
UNIT, RATE, CLOCK = 16384, 65536, 90000  # bytes of a unit, samples and ticks a second


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
    return np.stack([_table_packet(0, pat), _table_packet(PMT_PID, pmt)])


def _stamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def mux_bytes(payload: bytes, unit: int = UNIT, access_every: int = 8) -> bytes:
    """A transport stream that holds ``payload``."""
    starts = range(0, len(payload), unit)
    data, sizes, first = [], [], []
    for j, at in enumerate(starts):
        part = payload[at : at + unit]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(at * CLOCK // RATE) + part
        room = PAYLOAD - 8 * (j % access_every == 0)
        rest = max(0, len(pes) - room)
        n = [min(room, len(pes))] + [PAYLOAD] * (rest // PAYLOAD) + [rest % PAYLOAD] * (rest % PAYLOAD > 0)
        first.append(len(sizes))
        sizes += n
        data.append(pes)
    size, count = np.array(sizes, np.int64), len(sizes)
    out = np.full((count, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[first, 1] |= 0x40
    short = size < PAYLOAD
    out[:, 3] = np.where(short, 0x30, 0x10) | (np.arange(count) & 15)
    out[short, 4] = (PAYLOAD - 1 - size[short]).astype(np.uint8)
    long_field = size < PAYLOAD - 1
    out[long_field, 5] = 0
    access = first[::access_every]
    for j, i in zip(range(0, len(first), access_every), access, strict=True):
        out[i, 5] = 0x50
        base = j * unit * CLOCK // RATE & 0x1FFFFFFFF
        out[i, 6:12] = np.frombuffer((base << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[np.arange(PACKET) >= PACKET - size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    tables = np.repeat(_tables()[None], len(access), 0)
    tables[:, :, 3] |= (np.arange(len(access)) & 15).astype(np.uint8)[:, None]
    return np.insert(out, np.repeat(access, 2), tables.reshape(-1, PACKET), axis=0).tobytes()


@lru_cache(256)
def _table_rows(s: bytes) -> tuple[int, int, tuple, str]:
    """(table id, program or stream number, ((number or type, pid), ...), what is wrong) of a whole section."""
    at = 8 if len(s) > 0 and s[0] == 0 else 12
    if len(s) < at + 4 or not s[1] & 0x80:
        return -1, -1, (), "damaged"
    number, rows, end = s[3] << 8 | s[4], [], len(s) - 4
    if crc32_mpeg(s):
        return s[0], number, (), "crc"
    if not s[5] & 1:
        return s[0], number, (), "later"
    if s[0] == 0:
        rows = [((s[i] << 8) | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3]) for i in range(at, end - 3, 4)]
    else:
        at += (s[10] & 15) << 8 | s[11]
        while at + 5 <= end:
            rows.append((s[at], (s[at + 1] & 31) << 8 | s[at + 2]))
            at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    return s[0], number, tuple(rows), "" if at <= end else "damaged"


def _sections(rows: np.ndarray, heads: list[int]) -> tuple[list[bytes], int]:
    """The whole sections that packets of a table's stream carry, and how many are damaged."""
    found, damaged, held = [], 0, None  # bytes since a section's start; None: wait for the next start

    def taken(data: bytes) -> bytes | None:
        while len(data) >= 3 and data[0] != 0xFF:
            size = ((data[1] & 15) << 8 | data[2]) + 3
            if len(data) < size:
                return data
            found.append(data[:size])
            data = data[size:]
        return data if data and data[0] != 0xFF else None

    for row, head in zip(rows, heads, strict=True):
        data = row[head:].tobytes()
        if row[1] & 0x40:
            skip = data[0] + 1 if data else PACKET
            if skip > len(data):
                damaged, held = damaged + 1, None
                continue
            if held is not None:
                damaged += taken(held + data[1:skip]) is not None
            held = taken(data[skip:])
        elif held is not None:
            held = taken(held + data)
    return found, damaged + (held is not None)


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse_bytes(media: bytes | None) -> dict:
    """programs, streams, units, payload (of the units in order of stream and time of arrival), error counts."""
    raw = np.frombuffer(media or b"", np.uint8)
    p = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    field = np.where(p[:, 3] & 0x20, p[:, 4].astype(np.int64) + 1, 0)
    good = (p[:, 0] == SYNC) & (field <= PAYLOAD)
    damaged = int(len(p) - good.sum())
    if damaged:
        p, field = p[good], field[good]
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    out = {"programs": [], "streams": [], "units": [], "payload": b"", "packets": len(p), "damaged": damaged, "continuity_errors": 0, "crc_errors": 0}

    def packets(of: int) -> tuple[np.ndarray, np.ndarray]:
        """This stream's packets with a payload, less repeated ones, and their header sizes."""
        at = np.flatnonzero((pid == of) & (p[:, 3] & 0x10 > 0))
        if len(at) > 1:
            c = p[at, 3].astype(np.int64) & 15
            step = np.diff(c) & 15
            flagged = (p[at[1:], 3] & 0x20 > 0) & (field[at[1:]] > 1) & (p[at[1:], 5] & 0x80 > 0)
            odd = np.flatnonzero(~flagged & (step != 1))
            if len(odd):
                twice = odd[[bool(step[i] == 0 and (p[at[i]] == p[at[i + 1]]).all()) for i in odd]]
                out["continuity_errors"] += len(odd) - len(twice)
                at = np.delete(at, twice + 1)
        return p[at], field[at] + 4

    def sections(of: int) -> list[tuple]:
        rows, head = packets(of)
        whole, broken = _sections(rows, head.tolist())
        found = [_table_rows(x) for x in whole]
        out["damaged"] += broken + sum(x[3] == "damaged" for x in found)
        out["crc_errors"] += sum(x[3] == "crc" for x in found)
        return [x for x in found if not x[3]]

    programs = dict.fromkeys(r for t, _, rows, _ in sections(0) if t == 0 for r in rows if r[0])
    payload = []
    for number, pmt in programs:
        streams = dict.fromkeys(r for t, n, rows, _ in sections(pmt) if t == 2 and n == number for r in rows)
        out["programs"].append({"program": number, "pid": pmt})
        for kind, es in streams:
            rows, head = packets(es)
            out["streams"].append({"program": number, "pid": es, "type": kind, "packets": len(rows)})
            data = rows[np.arange(PACKET) >= head[:, None]].tobytes()
            ends = np.cumsum(PACKET - head)
            begin = np.flatnonzero(rows[:, 1] & 0x40)
            at = (ends[begin] - (PACKET - head[begin])).tolist()
            for i, a, b in zip(begin.tolist(), at, [*at[1:], len(data)][: len(at)], strict=True):
                if b - a < 9 or data[a : a + 3] != b"\0\0\1":
                    out["damaged"] += 1
                    continue
                flags, size, said = data[a + 7], data[a + 8], int.from_bytes(data[a + 4 : a + 6], "big")
                if data[a + 3] == PADDING_ID:
                    continue
                if data[a + 3] in BARE_IDS:  # no header fields: the bytes begin at once
                    flags, size = 0, -3
                stop = min(b, a + 6 + said) if said else b
                pts = _ticks(data[a + 9 : a + 14]) if flags & 0x80 and size >= 5 else None
                dts = _ticks(data[a + 14 : a + 19]) if flags & 0xC0 == 0xC0 and size >= 10 else pts
                unit = data[a + 9 + size : stop]
                access = bool(rows[i, 3] & 0x20 and rows[i, 4] and rows[i, 5] & 0x40)
                out["units"].append({"pid": es, "pts": pts, "dts": dts, "random_access": access, "bytes": len(unit)})
                payload.append(unit)
    out["payload"] = b"".join(payload)
    return out


PARSED = (
    "programs array<struct<program:int,pid:int>>, streams array<struct<program:int,pid:int,type:int,packets:int>>, "
    "units array<struct<pid:int,pts:long,dts:long,random_access:boolean,bytes:int>>, payload binary, packets int, damaged int, continuity_errors int, crc_errors int"
)


def mux(docs: DataFrame, pad: int = 64, unit: int = UNIT, access_every: int = 8) -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8 bytes, zero-padded to a positive multiple of ``pad``, as a transport stream."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            media = [mux_bytes(t + bytes(max(pad, -len(t) // pad * -pad) - len(t)), unit, access_every) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*map(len, texts)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def parse(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with its stream column parsed: the columns of ``PARSED`` take its place beside the others."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(PARSED)
    kept = [c for c in media.columns if c not in {*made.names}]
    others = [f for f in media.select(*kept).schema if f.name != column]
    target = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_pylist([parse_bytes(x) for x in b[column].to_pylist()], schema=target).combine_chunks()
            arrays = [b[f.name] for f in others] + [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in others] + target.names)

    return media.select(*kept).mapInArrow(run, StructType([*others, *made]))


def feature() -> F.Column:
    """A line that sums up the parsed columns."""
    times = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: u["pts"].cast("string"))
    return F.format_string(
        "programs=%s;streams=%s;packets=%d;units=%d;pts=%d-%d;access=%s;continuity_errors=%d;crc_errors=%d;damaged=%d",
        F.array_join(F.transform("programs", lambda x: F.concat_ws("@", x["program"], x["pid"])), ","),
        F.array_join(F.transform("streams", lambda x: F.concat_ws("@", x["type"], x["pid"])), ","),
        "packets", F.size("units"), F.array_min(F.col("units.pts")), F.array_max(F.col("units.pts")), F.array_join(times, ","), "continuity_errors", "crc_errors", "damaged",
    )
