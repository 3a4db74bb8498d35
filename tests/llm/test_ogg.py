import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_packets_survive(sizes, serial):
    packets = [(bytes([k % 256]) * n, k) for k, n in enumerate(sizes)]
    found = ogg.read(b"".join(ogg.pages(serial, packets)))
    assert found[serial].packets == [p for p, _ in packets] and found[serial].ended and found[serial].granules[-1] == len(sizes) - 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 254, 255, 256, 4000, 65_024, 65_025, 70_000, 300_000])
def test_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    payload, length, seconds = ogg.payload_of(ogg.read(ogg.write(data)))
    assert payload == ogg.pad(data) and length == n and seconds == len(payload) / ogg.RATE


def test_long_packets_are_continued():
    pages = ogg.pages(9, [(b"h", 0), (b"x" * 200_000, 5)])
    assert len(pages) > 3 and pages[2][5] & ogg.CONTINUED
    assert ogg.HEADER.unpack_from(pages[1])[3] == -1  # no packet ends on it
    assert ogg.read(b"".join(pages))[9].packets[1] == b"x" * 200_000


def test_damage_is_noticed():
    whole = ogg.write(b"some samples" * 900)
    for k in (30, 100, len(whole) - 1):
        with pytest.raises(ValueError):
            ogg.read(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :])
    with pytest.raises(ValueError):
        ogg.read(whole[:-10])
    a, b = ogg.pages(1, [(b"h", 0), (b"x" * 100_000, 1)])[:2]
    with pytest.raises(ValueError):
        ogg.read(a + b + ogg.pages(1, [(b"h", 0)])[0])


def test_documents(documents, odd, rows):
    for df, told in ((documents, rows), (odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])):
        want = []
        for i, t in told:
            payload = ogg.pad((t or "").encode())
            want.append((repr(i), len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        got = ogg.from_media(ogg.to_media(df)).collect()
        assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
        by = {}
        for r in got:
            assert by.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert ogg.from_media(ogg.to_media(odd.limit(0))).count() == 0
