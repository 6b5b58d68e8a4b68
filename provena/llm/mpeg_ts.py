"""Media columns as MPEG transport streams: mux a payload into PES units, and demux it with program tables and continuity checks."""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm.common import small_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: stream_type 0x06: PES packets with private data; stream_id 0xBD: private stream 1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in one access unit and 90 kHz ticks between two units.
UNIT, TICKS = 16_000, 3_600
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(pid: int, table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    head += crc32_mpeg(head).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + head
    return packet.ljust(PACKET, b"\xff")


_TABLES = _section(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(
    PMT_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _pts(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload: PAT, PMT, then one PES packet for each access unit of UNIT bytes.

    Each unit starts a packet whose adaptation field has the random-access indicator and a PCR; a last short packet is
    stuffed in its adaptation field. An empty payload gives the two tables only.
    """
    out, counter = [_TABLES], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        ticks = n * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + data
        field = bytes([0x50]) + (ticks << 15 | 0x7E00).to_bytes(6, "big")  # random access, PCR base and 6 reserved bits
        room = PACKET - 4 - 1 - len(field)
        first = pes[:room]
        field += b"\xff" * (room - len(first))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, len(field)]) + field + first)
        rest = pes[room:]
        full, tail = divmod(len(rest), PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (np.arange(counter + 1, counter + 1 + full) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(block.tobytes())
        counter += full
        if tail:
            counter += 1
            pad = PACKET - 4 - 1 - tail
            stuff = bytes([pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad > 0 else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15]) + stuff + rest[full * (PACKET - 4) :])
        counter += 1
    return b"".join(out)


def demux(stream: bytes) -> dict:
    """payload, units [(pts, random access, bytes)], program, pid, stream_type, packets, cc_errors, crc_errors of a transport stream.

    Follows PAT -> PMT -> elementary PID as found in the stream. A gap in a PID's continuity counter counts as an
    error; a repeated counter with equal content is a duplicate and is skipped. Bytes after the last whole packet are ignored.
    """
    packets = np.frombuffer(stream, np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
    out = {"payload": b"", "units": [], "program": None, "pid": None, "stream_type": None, "packets": len(packets), "cc_errors": 0, "crc_errors": 0}
    packets = packets[packets[:, 0] == SYNC]
    if not len(packets):
        return out
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]

    def section(pid: int) -> bytes:
        for row in packets[(pids == pid) & (packets[:, 1] & 0x40 != 0)]:
            at = 4 + (1 + int(row[4]) if row[3] & 0x20 else 0)
            at += 1 + int(row[at])
            raw = row[at : at + 3 + (int(row[at + 1]) << 8 & 0xF00 | int(row[at + 2]))].tobytes()
            if crc32_mpeg(raw):
                out["crc_errors"] += 1
            else:
                return raw
        return b""

    pat = section(PAT_PID)
    for k in range(8, len(pat) - 4, 4):
        if number := int.from_bytes(pat[k : k + 2], "big"):
            out["program"], pmt_pid = number, int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF
            pmt = section(pmt_pid)
            k = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
            if k + 5 <= len(pmt) - 4:
                out["stream_type"], out["pid"] = pmt[k], int.from_bytes(pmt[k + 1 : k + 3], "big") & 0x1FFF
            break
    if out["pid"] is None:
        return out
    own = packets[pids == out["pid"]]
    own = own[own[:, 3] & 0x10 != 0]
    if not len(own):
        return out
    counter = own[:, 3] & 15
    step = (counter[1:].astype(np.int16) - counter[:-1]) % 16
    if (again := (step == 0) & (own[1:] == own[:-1]).all(axis=1)).any():
        own = own[np.concatenate([[True], ~again])]
        counter = own[:, 3] & 15
        step = (counter[1:].astype(np.int16) - counter[:-1]) % 16
    out["cc_errors"] = int((step != 1).sum())
    has_field = own[:, 3] & 0x20 != 0
    offset = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    payload = []
    for a, b in zip(starts, [*starts[1:], len(own)]):
        rows, at = own[a:b], offset[a:b]
        plain = rows[:, 4:]
        if len(rows) > 2 and (at[1:-1] == 4).all():
            pes = rows[0, at[0] :].tobytes() + plain[1:-1].tobytes() + rows[-1, at[-1] :].tobytes()
        else:
            pes = b"".join(r[o:].tobytes() for r, o in zip(rows, at))
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            out["cc_errors"] += 1
            continue
        data = pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")]
        pts = None
        if pes[7] & 0x80:
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        out["units"].append((pts, bool(has_field[a] and own[a, 4] and own[a, 5] & 0x40), len(data)))
        payload.append(data)
    out["payload"] = b"".join(payload)
    return out


def pad(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a transport stream.

    A null text is empty. One row in, one row out; rows that repeat stay; other columns are ignored. A task holds the media of 64 rows at a time.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_b"))

    def run(batches):
        for b in batches:
            for part in _slices(b):
                raw = part.column("_b").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _slices(batch, rows: int = 64):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def read_media(media: DataFrame) -> DataFrame:
    """Demuxes the media column; the columns of media that are doc_id or n_bytes stay.

    Adds payload (binary), packets, units, cc_errors, crc_errors, pts array<long> and random_access array<boolean>. A null or
    broken stream gives an empty payload and no units, and counts its errors.
    """
    def run(batches):
        for whole in batches:
            for b in _slices(whole, 64):
                got = [demux(x or b"") for x in b.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array([g["payload"] for g in got], pa.binary()),
                                                  *[pa.array([g[k] for g in got], pa.int64()) for k in ("packets", "cc_errors", "crc_errors", "program", "pid", "stream_type")],
                                                  pa.array([[u[0] for u in g["units"]] for g in got], pa.list_(pa.int64())), pa.array([[u[1] for u in g["units"]] for g in got], pa.list_(pa.bool_()))],
                                                 ["doc_id", "n_bytes", "media", "payload", "packets", "cc_errors", "crc_errors", "program", "pid", "stream_type", "pts", "random_access"])

    return small_batches(media).mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, packets long, cc_errors long, crc_errors long, program long, pid long, stream_type long, pts array<long>, random_access array<boolean>")


def digests(read: DataFrame) -> DataFrame:
    """The contract's digest columns of read_media's rows, by built-in functions."""
    tail = F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")
    feature = F.concat_ws(";", F.concat(F.lit("program="), F.coalesce("program", F.lit(-1))), F.concat(F.lit("pid="), F.coalesce("pid", F.lit(-1))), F.concat(F.lit("type="), F.coalesce("stream_type", F.lit(-1))),
                          F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("pts")), F.concat(F.lit("random_access="), F.size(F.filter("random_access", lambda x: x))),
                          F.concat(F.lit("last_pts="), F.coalesce(F.array_max("pts"), F.lit(-1))), F.concat(F.lit("cc_errors="), "cc_errors"), F.concat(F.lit("crc_errors="), "crc_errors"))
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
                       F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def brute_force(text: str | None) -> dict:
    """What the contract fixes, without transport streams: for tests."""
    raw = (text or "").encode()
    p = pad(raw)
    return {"n_bytes": len(raw), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-BLOCK:])}
