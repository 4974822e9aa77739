import hashlib
import math
import os
import random
import struct
import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, documents

from pairloom.llm import matroska as m


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40_000), st.integers(0, 9))
def test_mux_demux_round_trip(n, seed):
    data = m.padded(random.Random(seed).randbytes(n))
    assert len(data) % 64 == 0 and len(data) >= 64 and data[:n].ljust(len(data), b"\0") == data
    f = m.mux(data)
    media = m.demux(f)
    assert m.samples_of(f, media) == data and m.mux(data) == f
    assert [c[2] for c in media.cues] == media.clusters and media.duration == len(data) / 8
    assert [p[1] for p in media.packets] == [k * 64_000_000 for k in range(len(media.packets))]
    assert all(p[0] == 1 and p[2] for p in media.packets)


@pytest.mark.parametrize("kind", [m.XIPH, m.FIXED, m.EBML_LACING])
def test_lacing(kind):
    rnd = random.Random(kind)
    for _ in range(50):
        n = rnd.randrange(2, 12)
        sizes = [rnd.choice([0, 1, 62, 63, 64, 254, 255, 256, 510, 9000, 70_000]) for _ in range(n)] if kind != m.FIXED else [rnd.randrange(1, 600)] * n
        frames = [rnd.randbytes(s) for s in sizes]
        data = b"xx" + m.lace(frames, kind)
        assert [data[a : a + k] for a, k in m.unlace(data, 2, len(data), kind)] == frames


def test_unknown_sizes_block_groups_and_void():
    block = lambda t, flags, body: b"\x82" + struct.pack(">hB", t, flags) + body
    cluster = lambda time, body: b"\x1f\x43\xb6\x75\xff" + m.uint(m.TIMESTAMP, time) + body
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(-5, 0, b"abc")) + m.uint(m.REFERENCE_BLOCK, 1)) + m.element(0xEC, b"\0" * 9)
    info = m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 1000))
    data = m._HEADER + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + info + cluster(10, group) + cluster(20, m.element(m.SIMPLE_BLOCK, block(1, 0x80, b"de")))
    media = m.demux(data)
    assert [(t, ns, key, data[o : o + n]) for t, ns, key, o, n in media.packets] == [(2, 5000, False, b"abc"), (2, 21000, True, b"de")]
    assert len(media.clusters) == 2


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 255))
def test_damage_raises_value_error_only(place, byte):
    data = bytearray(m.mux(m.padded(b"some text " * 700)))
    data[place % len(data)] = byte
    for d in (bytes(data), bytes(data[: place % len(data)])):
        try:
            m.demux(d)
        except ValueError:
            pass


def plain_feature(pay, media):
    """The features by definition, a sample at a time."""
    x = [b - 128 for b in pay]
    n = len(x)
    shares = [pay.count(bytes([b])) / n for b in set(pay)]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    entropy = -sum(p * math.log2(p) for p in shares)
    sound = f"mean={sum(x) / n:.4f};rms={(sum(v * v for v in x) / n) ** 0.5:.4f};peak={max(map(abs, x))};crossings={crossings};entropy={entropy + 0.0:.4f}"
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={n * 1000 // m.RATE};{sound}"


def test_documents(spark):
    docs = documents(spark, ODD).selectExpr("*", "'x' as media", "1 as feature")
    got = m.media_digests(docs).collect()
    files = {}
    for r in m.text_media(docs).collect():
        files.setdefault(r.doc_id, bytes(r.media))
    want = {i: t for i, t, *_ in ODD}
    assert len(got) == len(ODD)
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        pay = m.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        assert r.feature == plain_feature(pay, m.demux(files[r.doc_id]))
    bad = spark.createDataFrame([(1, bytearray(files[5])), (2, None), (3, bytearray(b"\x00junk")), (4, bytearray(b""))], "doc_id long, media binary")
    rows = m.packets(bad).collect()
    assert sum(r.bytes for r in rows if r.doc_id == 1) == len(m.padded((want[5]).encode())) and {r.doc_id for r in rows if r.error} == {3, 4}
    assert m.media_digests(documents(spark, [])).count() == 0
