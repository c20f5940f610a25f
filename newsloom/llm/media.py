"""Operator 10: media columns as MPEG transport streams (ISO/IEC 13818-1).

A payload of 8-bit samples is packed into PES packets of a private stream, these
into 188-byte transport packets.  Each PES packet carries a presentation time
stamp; the first packet of every ``RAP_EVERY``-th PES packet carries an adaptation
field with the random-access indicator and a PCR, and a PAT and a PMT stand right
before it, so a reader can start there with nothing read before (``start_at``).
Reading back parses the program tables (each with its CRC), checks the continuity
counter of every PID, reassembles the elementary stream and returns the time
stamps and random-access points.  A packet sent twice, as the format allows, is
read once.

Equal payloads give equal streams: nothing else goes in.  Defined cases: null
text is the empty text; the payload is padded with zero bytes to a positive
multiple of 64; repeated rows each give a row; a null doc_id is carried; extra
columns are ignored.  A damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, slices, utf8_buffer

#: Fixed values of the format: packet size, sync byte, PIDs and stream type in use.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, PRIVATE_TYPE = 0, 0x100, 0x101, 0xBD, 0x06

#: Stuffing.
NULL_PID = 0x1FFF

#: Payload bytes of a PES packet, sample clock in Hz, PES packets from one random-access point to the next.
PES_BYTES, SAMPLE_RATE, RAP_EVERY = 16_384, 8_000, 4
CLOCK = 90_000


@functools.lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


@functools.lru_cache(maxsize=64)
def psi_crc(section: bytes) -> int:
    """CRC-32/MPEG-2."""
    table, crc = _crc_table(), 0xFFFFFFFF
    for byte in section:
        crc = (crc << 8 & 0xFFFFFFFF) ^ table[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + psi_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter, 0]) + section
    return packet.ljust(PACKET, b"\xff")


@functools.lru_cache(maxsize=16)
def program_tables(counter: int) -> bytes:
    """One PAT packet (program 1) and one PMT packet (one private stream, which also carries the PCR)."""
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return _table_packet(PAT_PID, pat, counter) + _table_packet(PMT_PID, pmt, counter)


def _stamp(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | (ticks >> 30) << 1, ticks >> 22 & 0xFF, 0x01 | (ticks >> 15 & 0x7F) << 1, ticks >> 7 & 0xFF, 0x01 | (ticks & 0x7F) << 1])


def _read_stamp(b: np.ndarray) -> int:
    v = [int(x) for x in b[:5]]
    return (v[0] >> 1 & 7) << 30 | v[1] << 22 | (v[2] >> 1) << 15 | v[3] << 7 | v[4] >> 1


def mux(payload: np.ndarray) -> bytes:
    """A transport stream holding the payload (uint8)."""
    parts, counter = [], 0
    for k, lo in enumerate(range(0, max(len(payload), 1), PES_BYTES)):
        data = payload[lo : lo + PES_BYTES]
        stamp = lo * CLOCK // SAMPLE_RATE
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(stamp)
        pes = np.concatenate([np.frombuffer(head, np.uint8), data])
        # adaptation field of the first packet: flags with random access and PCR (7 bytes), else none
        first = b""
        if k % RAP_EVERY == 0:
            parts.append(program_tables(k // RAP_EVERY & 15))
            base = stamp & (1 << 33) - 1
            first = bytes([7, 0x50]) + ((base << 15) | (0x3F << 9)).to_bytes(6, "big")
        room = PACKET - 4
        n = 1 + max(0, -(-(len(pes) - (room - len(first))) // room))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        taken = room - len(first)
        if n == 1:
            first = _stuffed(first, taken - len(pes))
            taken = len(pes)
        if first:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
        packets[0, PACKET - taken :] = pes[:taken]
        if n > 1:
            full = (len(pes) - taken) // room if (len(pes) - taken) % room == 0 else n - 2
            packets[1 : 1 + full, 4:] = pes[taken : taken + full * room].reshape(full, room)
            rest = pes[taken + full * room :]
            if len(rest):
                field = _stuffed(b"", room - len(rest))
                packets[-1, 3] |= 0x20
                packets[-1, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
                packets[-1, 4 + len(field) :] = rest
        parts.append(packets.tobytes())
    return b"".join(parts)


def _stuffed(field: bytes, spare: int) -> bytes:
    """An adaptation field grown by ``spare`` bytes."""
    if spare <= 0:
        return field
    if field:
        return bytes([field[0] + spare]) + field[1:] + b"\xff" * spare
    return bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")


def _parse_section(packet: np.ndarray, table_id: int) -> bytes:
    at = 4 + 1 + int(packet[4])
    raw = packet[at:].tobytes()
    size = 3 + ((raw[1] & 0x0F) << 8 | raw[2])
    if raw[0] != table_id or size > len(raw) or psi_crc(raw[:size]):
        raise ValueError("a program table is damaged")
    return raw[8 : size - 4]


def demux(stream: bytes) -> tuple[np.ndarray, dict]:
    """The elementary stream, and what was met on the way."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet without its sync byte")
    pid = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    # packets of every PID in their order; null packets have no counter
    order = np.argsort(pid, kind="stable")
    order = order[pid[order] != NULL_PID]
    which, counter = pid[order], packets[order, 3] & 15
    again = np.zeros(len(order), bool)
    again[1:] = (which[1:] == which[:-1]) & (counter[1:] == counter[:-1])
    for k in np.flatnonzero(again):
        again[k] = bool((packets[order[k]] == packets[order[k - 1]]).all())
    order = order[~again]
    which, counter = pid[order], packets[order, 3] & 15
    gaps = int(((which[1:] == which[:-1]) & ((counter[1:] - counter[:-1]) & 15 != 1)).sum())
    if gaps:
        raise ValueError(f"{gaps} continuity errors")
    of = lambda n: order[which == n]  # noqa: E731  in stream order
    bodies = {_parse_section(packets[k], 0) for k in of(PAT_PID)}
    if len(bodies) != 1:
        raise ValueError("not one program association table")
    body = bodies.pop()
    pmt_pid = (body[2] & 0x1F) << 8 | body[3]
    bodies = {_parse_section(packets[k], 2) for k in of(pmt_pid)}
    if len(bodies) != 1:
        raise ValueError("not one program map table")
    body = bodies.pop()
    es = body[4 + ((body[2] & 0x0F) << 8 | body[3]) :]
    es_pid = (es[1] & 0x1F) << 8 | es[2]
    own = of(es_pid)
    data = packets[own]
    has_field = (data[:, 3] & 0x20) > 0
    skip = np.where(has_field, data[:, 4].astype(np.int64) + 1, 0) + 4
    starts = np.flatnonzero(data[:, 1] & 0x40)
    rap = has_field & (data[:, 4] > 0) & ((data[:, 5] & 0x40) > 0)
    keep = np.arange(PACKET) >= skip[:, None]
    flat = data[keep]
    edge = np.concatenate([[0], np.cumsum(PACKET - skip)])
    parts, stamps, raps, at = [], [], [], 0
    for k, s in enumerate(starts):
        pes = flat[edge[s] : edge[starts[k + 1]] if k + 1 < len(starts) else edge[-1]]
        if pes[:3].tobytes() != b"\x00\x00\x01":
            raise ValueError("a PES packet without its start code")
        if int(pes[4]) << 8 | int(pes[5]) != len(pes) - 6:
            raise ValueError("a PES packet of the wrong length")
        stamps.append(_read_stamp(pes[9:14]))
        if rap[s]:
            raps.append((int(own[s]), at))
        parts.append(pes[9 + int(pes[8]) :])
        at += len(parts[-1])
    return (np.concatenate(parts) if parts else flat[:0]), {"packets": len(packets), "pes": len(starts), "pts": stamps, "raps": raps}


def start_at(stream: bytes, packet: int) -> bytes:
    """The stream from a random-access point (its packet) on, with the tables before it."""
    return stream[(packet - 2) * PACKET :]


def padded(text: np.ndarray, unit: int = 64) -> np.ndarray:
    size = max(unit, -(-len(text) // unit) * unit)
    out = np.zeros(size, np.uint8)
    out[: len(text)] = text
    return out


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as a transport stream."""
    kept = pick(df, id_col, text_col)
    id_type = kept.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                raw, at = utf8_buffer(part.column(1))
                media = [mux(padded(raw[a:b])) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())],
                    names=[id_col, "n_bytes", "media"],
                )

    return kept.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, media binary")


def features(payload: np.ndarray, seen: dict) -> str:
    """Stream and signal features: packets, PES packets, first and last time stamp, random-access points (packet@byte), mean, deviation and zero crossings of the samples about their mean."""
    mean = float(payload.mean())
    above = payload >= mean
    raps = " ".join(f"{p}@{b}" for p, b in seen["raps"])
    return (
        f"packets={seen['packets']};pes={seen['pes']};pts={seen['pts'][0]}-{seen['pts'][-1]};raps={raps};"
        f"mean={mean:.4f};std={float(payload.std()):.4f};crossings={int((above[1:] != above[:-1]).sum())}"
    )


def read(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored streams back: payload digests, stream digests, features; pts and raps are returned as arrays."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                rows = []
                for media in part.column(2).to_pylist():
                    payload, seen = demux(media)
                    data = payload.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, seen), seen["pts"], [b for _, b in seen["raps"]]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=NAMES(id_col))

    NAMES = lambda i: [i, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "rap_bytes"]
    return df.select(F.col(f"`{id_col}`"), "n_bytes", "media").mapInArrow(
        run,
        f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, rap_bytes array<long>",
    )


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Streams are written to the shared folder as a binary column and read from there."""
    return read(materialize(store(df, id_col, text_col), "media"), id_col)
