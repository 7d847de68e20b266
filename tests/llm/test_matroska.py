import hashlib
import random
import zlib

import pytest

from quorumlake.llm import matroska as m

TEXTS = [(1, None), (2, ""), (3, "a"), (4, "x" * 64), (5, "wörter " * 4000), (6, "a"), (6, "b" * 70_000), (None, "z")]


def test_digest(spark):
    df = spark.createDataFrame([(i, t, "other", b"x") for i, t in TEXTS], "doc_id long, text string, feature string, media binary")
    got = m.media_digest(m.text_media(df)).collect()
    assert len(got) == len(TEXTS)
    want = sorted((str(i), len((t or "").encode())) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == want
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw) % 64) if raw else 64)
        r = by[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = m.write_pcm8(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert '"error"' not in r.feature
    assert m.media_digest(m.text_media(df.limit(0))).collect() == []


@pytest.mark.parametrize("lacing", [m.XIPH, m.FIXED, m.EBML_LACING, m.NO_LACING])
def test_lacing_round_trip(lacing):
    rng = random.Random(lacing)
    for _ in range(50):
        n = 1 if lacing == m.NO_LACING else rng.randrange(1, 9)
        size = rng.randrange(0, 700)
        frames = [rng.randbytes(size if lacing == m.FIXED else rng.randrange(0, 700)) for _ in range(n)]
        block = m.laced_block(m.SIMPLE_BLOCK, 1, -3, frames, lacing)
        track = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.element(m.TRACK_NUMBER, b"\x01")))
        data = m._preamble()[0] + m.element(m.SEGMENT, track, m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\x07"), block))
        got = m.parse(data)
        assert got.error is None
        assert [data[p[4] : p[4] + p[5]] for p in got.packets] == frames
        assert {p[1] for p in got.packets} == {4_000_000}


def test_groups_unknown_sizes_cues_and_foreign_elements():
    head, tracks = m._preamble()
    group = m.element(m.BLOCK_GROUP, m.laced_block(m.BLOCK, 1, 5, [b"abc"], m.NO_LACING), m.element(m.BLOCK_DURATION, b"\x09"), m.element(m.REFERENCE_BLOCK, b"\xff"))
    void = m.element(0xEC, b"\0" * 9)
    body = tracks + void
    cluster = m._id_bytes(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m.element(m.TIMESTAMP, b"\x01\x00") + void + group
    cues = m.element(m.CUES, m.element(m.CUE_POINT, m.element(m.CUE_TIME, b"\x01\x00"), m.element(m.CUE_TRACK_POSITIONS, m.element(m.CUE_TRACK, b"\x01"), m.element(m.CUE_CLUSTER_POSITION, bytes([len(body)])))))
    segment = m._id_bytes(m.SEGMENT) + b"\x01" + b"\xff" * 7
    data = head + segment + body + cluster + cluster + cues
    got = m.parse(data)
    assert got.error is None
    assert [(p[0], p[1], p[3], data[p[4] : p[4] + p[5]], p[7]) for p in got.packets] == [(1, 261_000_000, False, b"abc", 0), (1, 261_000_000, False, b"abc", 1)]
    start = len(head) + len(segment) + len(body)
    assert got.cues == [(256_000_000, 1, start)]
    assert got.packets[0][8] == start
    assert got.clusters == 2


def test_broken_files_never_raise(spark):
    whole = m.write_pcm8(b"abcd" * 3000)
    rng = random.Random(1)
    for _ in range(300):
        data = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.5 else whole)
        for _ in range(rng.randrange(4)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        m.parse(bytes(data))
    assert m.parse(b"").error and m.parse(b"junk").error
    df = spark.createDataFrame([(1, None), (2, b""), (3, whole), (3, whole[:3000])], "doc_id long, media binary")
    rows = m.packet_table(df).collect()
    assert [r.packet for r in rows if r.id == 1] == [None]
    ok = sorted((r.offset, r.length) for r in rows if r.id == 3 and r.error is None)
    assert b"".join(whole[a : a + n] for a, n in ok) == b"abcd" * 3000
    assert any(r.error for r in rows if r.id == 3)
    assert {r.codec for r in rows if r.id == 3 and r.error is None} == {"A_PCM/INT/LIT"}
    assert m.cue_table(df).count() == 2 - 1 + sum(1 for _ in m.parse(whole[:3000]).cues)
