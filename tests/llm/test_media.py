import hashlib
import zlib

import numpy as np
import pytest

from newsloom.llm import media


@pytest.mark.parametrize("n", [0, 1, 150, 164, 165, 176, 183, 184, 185, 400, 16_383, 16_384, 16_385, 65_536, 150_001])
def test_round_trip_and_tables(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    stream = media.mux(payload)
    back, seen = media.demux(stream)
    assert (back == payload).all() and len(back) == n and len(stream) == 188 * seen["packets"]
    assert seen["raps"][0][1] == 0 and [b for _, b in seen["raps"]] == list(range(0, max(n, 1), 4 * 16_384))
    assert seen["pts"] == [lo * 90_000 // 8_000 for lo in range(0, max(n, 1), 16_384)]


def test_damage_is_found():
    stream = bytearray(media.mux(np.arange(3000, dtype=np.uint16).astype(np.uint8)))
    for at, what in ((0, "sync"), (20, "table"), (188 * 4 + 3, "continuity")):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(ValueError, match=what):
            media.demux(bytes(bad))
    with pytest.raises(ValueError):
        media.demux(bytes(stream[:-1]))


def test_crc_of_a_known_section():
    assert media.psi_crc(b"123456789") == 0x0376E6E7


def test_columns(odd_docs, no_docs):
    rows = media.store_and_read(odd_docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        data = text[r.doc_id]
        size = max(64, -(-len(data) // 64) * 64)
        payload = data.ljust(size, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes % 188 == 0 and r.feature
    one, two = [r for r in rows if r.doc_id == 1]
    assert one == two
    assert media.store_and_read(no_docs).count() == 0


def test_a_lost_table_packet_is_noticed():
    stream = media.mux(np.zeros(640, np.uint8))
    table = bytearray(stream[: media.PACKET])
    assert len(media.demux(stream + bytes(table))[0]) == 640  # a packet sent twice
    table[3] = table[3] & 0xF0 | (table[3] + 1) & 15
    assert len(media.demux(stream + bytes(table))[0]) == 640
    table[3] = table[3] & 0xF0 | (table[3] + 1) & 15
    table[3] = table[3] & 0xF0 | (table[3] + 1) & 15
    with pytest.raises(ValueError, match="continuity"):
        media.demux(stream + bytes(table))


def test_a_reader_can_start_at_any_random_access_point():
    payload = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)
    stream = media.mux(payload)
    raps = media.demux(stream)[1]["raps"]
    assert len(raps) == 4
    for packet, at in raps:
        back, seen = media.demux(media.start_at(stream, packet))
        assert (back == payload[at:]).all() and seen["raps"][0] == (2, 0) and seen["pts"][0] == at * 90_000 // 8_000


def test_feature_by_hand():
    data = np.array([0, 10] * 32, np.uint8)
    payload, seen = media.demux(media.mux(data))
    assert media.features(payload, seen) == "packets=3;pes=1;pts=0-0;raps=2@0;mean=5.0000;std=5.0000;crossings=63"


def test_stream_by_hand():
    """A short payload's packets, field by field, without the writer's code."""
    stream = media.mux(np.frombuffer(b"A" * 64, np.uint8))
    pat, pmt, es = (stream[k : k + 188] for k in (0, 188, 376))
    assert pat[:5] == b"\x47\x40\x00\x10\x00" and pat[5:17] == bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE1, 0])
    assert pmt[:5] == b"\x47\x41\x00\x10\x00" and pmt[5:8] == bytes([2, 0xB0, 18])
    assert es[:4] == b"\x47\x41\x01\x30" and es[5] == 0x50 and es[-64:] == b"A" * 64
    assert es[-78:-64] == b"\x00\x00\x01\xbd\x00\x48\x80\x80\x05\x21\x00\x01\x00\x01"
