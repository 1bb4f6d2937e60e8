"""Media columns: bytes as an MPEG transport stream of one private program, and back.

Fixed values of the format: packets of 188 bytes, sync byte 0x47, program tables on PIDs 0 (association) and PMT_PID, CRC-32/MPEG-2 at the end of each table,
PES start code 00 00 01 with private stream 1 (0xBD), 33-bit timestamps at 90 kHz.

The payload is cut into access units of UNIT bytes, one PES packet each; unit k has the timestamp k * TICK, and every GOP-th one is
marked as a random-access point and preceded by the program tables.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import in_batches, row_slices, text_buffers

PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
UNIT, TICK, GOP = 4096, 3600, 16
_CRC = np.zeros(256, np.uint64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ (0x04C11DB7 if _c & 0x80000000 else 0)) & 0xFFFFFFFF
    _CRC[_i] = _c
_CRC = _CRC.tolist()


def crc_mpeg(b: bytes) -> int:
    c = 0xFFFFFFFF
    for x in b:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return b"\x00" + head + crc_mpeg(head).to_bytes(4, "big")


_TABLES = (
    (0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    (PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
)


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [], {0: 0, PMT_PID: 0, ES_PID: 0}

    def packet(pid, start, body, access=False):
        room = 184 - len(body)
        head = bytes([0x47, start << 6 | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counter[pid]])
        counter[pid] = counter[pid] + 1 & 15
        if room:
            head += bytes([room - 1]) + (bytes([0x40 if access else 0]) + b"\xff" * (room - 2) if room > 1 else b"")
        out.append(head + body)

    for k in range(-(-len(payload) // UNIT)):
        unit = payload[k * UNIT : (k + 1) * UNIT]
        access = k % GOP == 0
        if access:
            for pid, section in _TABLES:
                packet(pid, 1, section + b"\xff" * (184 - len(section)))
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICK % (1 << 33)) + unit
        first = 182 if access else 184
        packet(ES_PID, 1, pes[:first], access)
        for i in range(first, len(pes), 184):
            packet(ES_PID, 0, pes[i : i + 184])
    return b"".join(out)


def demux(stream: bytes) -> dict:
    """Payload, timestamps and random-access points of a stream, read by its own tables.

    packets, units, discontinuities (jumps of a continuity counter), crc_errors; stamps: 90 kHz ticks of each unit; access: indices of units that
    are random-access points. A stream whose length or sync bytes are wrong is an error.
    """
    if len(stream) % 188:
        raise ValueError("a transport stream has packets of 188 bytes")
    p = np.frombuffer(stream, np.uint8).reshape(-1, 188)
    if (p[:, 0] != 0x47).any():
        raise ValueError("sync byte missing")
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    start, control, counter = p[:, 1] >> 6 & 1, p[:, 3] >> 4 & 3, p[:, 3] & 15
    begin = np.where(control & 2, 5 + p[:, 4].astype(np.int64), 4)
    crc_errors = 0

    def section(row):
        nonlocal crc_errors
        b = p[row, begin[row] :].tobytes()
        b = b[1 + b[0] :]
        b = b[: 3 + (int.from_bytes(b[1:3], "big") & 0xFFF)]
        crc_errors += crc_mpeg(b) != 0
        return b[8:-4]

    streams: set[int] = set()
    programs = {int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for r in np.flatnonzero((pid == 0) & (start == 1)) for body in (section(r),) for i in range(0, len(body), 4)}
    for r in np.flatnonzero(np.isin(pid, list(programs)) & (start == 1)):
        body = section(r)
        i = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
        while i < len(body):
            streams.add(int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF)
            i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)
    jumps = 0
    for x in np.unique(pid):
        c = counter[(pid == x) & (control & 1 == 1)].astype(np.int64)
        jumps += int(((c[1:] - c[:-1]) % 16 != 1).sum())
    units, stamps, access = [], [], []
    for x in sorted(streams):
        rows = np.flatnonzero((pid == x) & (control & 1 == 1))
        full = p[rows, 4:]
        keep = np.arange(4, 188)[None, :] >= begin[rows][:, None]
        data, ends = full[keep].tobytes(), np.cumsum(188 - begin[rows])
        heads = np.flatnonzero(start[rows] == 1)
        at = np.r_[0, ends[:-1]][heads].tolist()
        for k, (h, a, b) in enumerate(zip(heads.tolist(), at, [*at[1:], len(data)], strict=True)):
            s = data[a + 9 : a + 14]
            stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
            units.append(data[a + 9 + data[a + 8] : min(b, a + 6 + int.from_bytes(data[a + 4 : a + 6], "big"))])
            r = rows[h]
            if control[r] & 2 and p[r, 4] and p[r, 5] & 0x40:
                access.append(k)
    return {"payload": b"".join(units), "packets": len(p), "units": len(units), "discontinuities": jumps, "crc_errors": crc_errors, "stamps": stamps, "access": access}


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each text (null: empty), padded with bytes 0 to a positive multiple of 64, as a transport stream.

    A text of any length is one stream; repeated rows come back as often, an empty table gives none; other columns are left out."""

    def run(batches):
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs):
                media = [mux(padded(raw[offs[k] : offs[k + 1]].tobytes())) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(offs[i : j + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads the streams back: doc_id, n_bytes, payload facts, stream facts, timestamps (array of ticks) and random-access points.

    Null ids stay, repeated rows come back as often, an empty table gives none. A stream with a wrong length or sync byte, and a null one, is an error."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                rows = []
                for d, n, m in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    x = demux(m)
                    y = x["payload"]
                    feature = f"units={x['units']};packets={x['packets']};discontinuities={x['discontinuities']};crc_errors={x['crc_errors']};last_pts={x['stamps'][-1]};access={len(x['access'])}"
                    rows.append((d, n, len(y), hashlib.sha256(y).hexdigest(), zlib.crc32(y[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, x["stamps"], x["access"]))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access"])

    return in_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, access array<long>")
