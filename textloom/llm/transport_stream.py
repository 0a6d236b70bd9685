"""MPEG transport streams in a binary column: write payloads as elementary streams, and read streams back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0x0000
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000
# What this writer puts in.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES, UNIT_TICKS = 32_768, 3_003
#: Payloads are zero-filled to a positive multiple of this.
ALIGN = 64

_crc_table = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _crc_table.append(_c)


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _crc_table[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def _stuffed(head: bytes, field: bytes, data: bytes) -> bytes:
    """A packet with an adaptation field (its bytes after the length) that is filled up to fit the data."""
    room = PACKET - 4 - 1 - len(data)
    if room and not field:
        field = b"\x00"
    return head + bytes([room]) + field.ljust(room, b"\xff") + data


def write_stream(payload: bytes) -> bytes:
    """A transport stream with one program whose one elementary stream is the payload, in access units with timestamps;
    each unit begins at a random-access point with a clock reference."""
    out, counter = [TABLES], 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        data, ticks = payload[at : at + UNIT_BYTES], unit * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + data
        clock = (((ticks % (1 << 33)) << 15) | 0x7E00).to_bytes(6, "big")
        first = pes[: PACKET - 4 - 8]
        out.append(_stuffed(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]), b"\x50" + clock, first))
        counter = (counter + 1) & 15
        rest = pes[len(first) :]
        n = len(rest) // 184
        if n:
            block = np.empty((n, PACKET), dtype=np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            block[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=n * 184).reshape(n, 184)
            out.append(block.tobytes())
            counter = (counter + n) & 15
        if len(rest) > n * 184:
            out.append(_stuffed(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]), b"", rest[n * 184 :]))
            counter = (counter + 1) & 15
    return b"".join(out)


def _sections(packets: np.ndarray, start: np.ndarray, unit: np.ndarray) -> list[bytes]:
    """The sections of a table's packets that are whole and have the right checksum."""
    out, data = [], b""
    for row, s, u in zip(packets, start, unit, strict=True):
        body = row[s:].tobytes()
        if u:
            data += body[1 : 1 + body[0]] if data else b""
            data = body[1 + body[0] :]
        else:
            data += body
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                break
            if size >= 12 and section_crc(data[:size]) == 0:
                out.append(data[:size])
            data = data[size:]
    return out


def read_stream(media: bytes) -> dict:
    """payload: all elementary streams' bytes, by program and table order; programs; streams (pid, type); packets;
    counter_errors; points (pid, packet, pts: of units that begin at a random-access point); pts (first, last).

    Packets without the sync byte count as counter errors of no stream and are left out; repeated packets (same counter)
    are taken once. A stream that is empty or has no tables has an empty payload.
    """
    n = len(media) // PACKET
    p = np.frombuffer(media, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    sound = p[:, 0] == SYNC
    errors = int(n - sound.sum()) + bool(len(media) % PACKET)
    number = np.flatnonzero(sound)
    p = p[sound]
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    unit, counter, field = (p[:, 1] & 0x40) > 0, (p[:, 3] & 15).astype(np.int64), (p[:, 3] >> 4) & 3
    has_field, has_data = (field & 2) > 0, (field & 1) > 0
    start = np.minimum(4 + np.where(has_field, 1 + p[:, 4].astype(np.int64), 0), PACKET)
    access = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)

    def of(which: int) -> np.ndarray:
        return np.flatnonzero((pid == which) & has_data)

    programs: dict[int, int] = {}
    for s in _sections(p[of(PAT_PID)], start[of(PAT_PID)], unit[of(PAT_PID)]):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if number_ := s[i] << 8 | s[i + 1]:
                    programs[number_] = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    streams: list[tuple[int, int]] = []
    for table in programs.values():
        for s in _sections(p[of(table)], start[of(table)], unit[of(table)]):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while s[0] == 2 and i + 5 <= len(s) - 4:
                if (found := ((s[i + 1] & 0x1F) << 8 | s[i + 2], s[i])) not in streams:
                    streams.append(found)
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    payload, points, stamps = [], [], []
    cols = np.arange(PACKET)
    for which, _ in streams:
        own = of(which)
        if not len(own):
            continue
        step = np.diff(counter[own]) & 15
        errors += int((step > 1).sum())
        own = own[np.append(True, step != 0)]
        data = p[own][cols >= start[own][:, None]].tobytes()
        begin = np.append(0, np.cumsum(PACKET - start[own]))
        heads = np.flatnonzero(unit[own])
        for k, h in enumerate(heads):
            pes = data[begin[h] : begin[heads[k + 1]] if k + 1 < len(heads) else begin[-1]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            end = 6 + size if size else len(pes)
            errors += end > len(pes)
            payload.append(pes[9 + pes[8] : end])
            if pes[7] & 0x80:
                stamp = (pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1
                stamps.append(stamp)
                if access[own[h]]:
                    points.append({"pid": which, "packet": int(number[own[h]]), "pts": stamp})
    return {"payload": b"".join(payload), "programs": sorted(programs), "streams": streams, "packets": n, "counter_errors": errors, "points": points, "pts": (min(stamps), max(stamps)) if stamps else None}


def _written_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            media = [write_stream(x or b"") for x in part.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


POINTS = "array<struct<pid:bigint,packet:bigint,pts:bigint>>"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pid", pa.int64()), ("packet", pa.int64()), ("pts", pa.int64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            got = [read_stream(x or b"") for x in part.column("media").to_pylist()]
            feature = [
                f"programs={','.join(map(str, g['programs']))};streams={','.join(f'{a}:{b}' for a, b in g['streams'])};packets={g['packets']};errors={g['counter_errors']};"
                f"points={len(g['points'])};seconds={(g['pts'][1] - g['pts'][0]) / CLOCK if g['pts'] else 0:.3f}"
                for g in got
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    part.column("media"),
                    pa.array([g["payload"] for g in got], pa.binary()),
                    pa.array([g["counter_errors"] for g in got], pa.int64()),
                    pa.array([g["points"] for g in got], kind),
                    pa.array(feature),
                ],
                ["doc_id", "n_bytes", "media", "payload", "counter_errors", "points", "feature"],
            )


def padded(text):
    """A text's UTF-8 bytes, zero-filled to a positive multiple of ALIGN; null counts as empty."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    missing = F.greatest(F.ceil(F.octet_length(raw) / ALIGN), F.lit(1)) * ALIGN - F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing.cast("int"))))


def to_streams(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (of the text), media (its transport stream).

    docs: doc_id, text; other columns are ignored. A null text counts as empty; equal texts have equal streams. Texts of
    any length are split into access units. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), padded(text).alias("payload"))
    return rows.mapInArrow(_written_rows, "doc_id long, n_bytes long, media binary")


def from_streams(media: DataFrame) -> DataFrame:
    """The rows of to_streams (or of any table doc_id, n_bytes, media) with payload, counter_errors, points and feature,
    all read from media; see read_stream. Null media are empty streams."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_rows, f"doc_id long, n_bytes long, media binary, payload binary, counter_errors long, points {POINTS}, feature string")
