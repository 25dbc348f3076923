import hashlib
import zlib

import numpy as np
import pytest

from wayhex.llm import media, queries

from .common import awkward, frame


def expected(text):
    data = (text or "").encode()
    pad = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    return len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])


def test_query_reads_back_every_text(spark, sf):
    rows = {r.doc_id: r for r in queries.op3_media_columns(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    seen = {}
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(d.text)
        assert seen.setdefault(d.text, r[1:]) == r[1:]


def test_awkward_rows(spark):
    stored = media.store_texts(frame(spark, awkward()))
    got = sorted(((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_payloads(stored).collect()))
    assert got == sorted(expected(t) for _, t in awkward())
    assert media.read_payloads(media.store_texts(frame(spark, []))).collect() == []
    assert {(r.media_bytes, r.media_sha256) for r in media.read_payloads(stored).collect()} == {(len(r.media), hashlib.sha256(r.media).hexdigest()) for r in stored.collect()}


def scalar_decode(scan, dht):
    """A bit-by-bit decoder of one scan."""
    codes, code, at = {}, 0, 17
    for n in range(1, 17):
        for _ in range(dht[n]):
            codes[n, code] = dht[at]
            code, at = code + 1, at + 1
        code <<= 1
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff"))
    p, out = 0, np.zeros((media.HEIGHT, media.WIDTH), int)
    for y in range(media.HEIGHT):
        for x in range(media.WIDTH):
            n = next(k for k in range(1, 17) if (k, int(bits[p : p + k], 2)) in codes)
            s = codes[n, int(bits[p : p + n], 2)]
            p += n
            v = int(bits[p : p + s], 2) if s else 0
            p += s
            d = v if not s or v >> (s - 1) else v - (1 << s) + 1
            out[y, x] = d + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return out.ravel()


def test_codec_against_scalar_decoder():
    r = np.random.default_rng(3)
    frames = np.concatenate((r.integers(0, 256, (3, 576)), np.zeros((1, 576)), np.full((1, 576), 255), np.tile([0, 255], (1, 288)))).astype(np.uint8)
    data, at = media.encode_scans(frames)
    for f, i, j in zip(frames, at, at[1:]):
        assert (scalar_decode(data[i:j].tobytes(), media._DHT) == f).all()


def test_index_order_and_damage():
    frames = np.arange(3 * 576).reshape(3, 576).astype(np.uint8)
    data, at = media.encode_scans(frames)
    images = [media._HEAD + data[i:j].tobytes() + b"\xff\xd9" for i, j in zip(at, at[1:])]
    avi = media.build_avi(images)
    assert media.parse_avi(avi) == (24.0, images)
    with pytest.raises(ValueError, match="cut short"):
        media.parse_avi(avi[:-40])
    with pytest.raises(ValueError, match="not an AVI"):
        media.parse_avi(b"x" * 40)
    dht, scan = media.parse_jpeg(images[1])
    comment = images[1][:2] + b"\xff\xfe\x00\x04hi" + images[1][2:]
    assert media.parse_jpeg(comment) == (dht, scan)
    with pytest.raises(ValueError, match="cut short|too long"):
        media.decode_scans([scan[:-40]], media._decode_table(dht))


def test_shots_and_clips(spark):
    dark, light = np.full((10, 576), 30, np.uint8), np.full((7, 576), 200, np.uint8)
    assert media.shots(np.concatenate((dark, light, dark))) == [0, 10, 17]
    assert media.shots(dark) == [0] and media.shots(dark[:0]) == []
    text = "a" * 576 * 10 + "Z" * 576 * 6 + "é" * 288 * 8
    rows = media.clips(media.store_texts(frame(spark, [(1, text), (2, None)]))).orderBy("doc_id", "clip").collect()
    assert [(r.doc_id, r.first_frame, r.frames) for r in rows] == [(1, 0, 10), (1, 10, 6), (1, 16, 8), (2, 0, 1)]
    assert rows[1].start_s == 10 / 24 and rows[1].end_s == 16 / 24


def plain_shots(frames, neighbours=media.NEIGHBOURS, spreads=media.SPREADS, least=media.LEAST_DIFFERENCE):
    """The first frames of the shots, a difference at a time."""
    hist = [[sum(v >> 3 == b for v in f) for b in range(media.BINS)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(a, b)) / (2 * media.FRAME) for a, b in zip(hist, hist[1:])]
    out = [0]
    for t, x in enumerate(d):
        own = [d[i] for i in range(max(0, t - neighbours), min(len(d), t + neighbours + 1)) if i != t] or [0]
        mean = sum(own) / len(own)
        spread = max(sum(y * y for y in own) / len(own) - mean * mean, 0) ** 0.5
        if x >= least and x > mean + spreads * spread:
            out.append(t + 1)
    return out


def test_feature_and_clips_of_texts_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120)
    stored = media.store_texts(docs)
    rows = {r.doc_id: r for r in media.read_payloads(stored).collect()}
    found = {}
    for r in media.clips(stored).orderBy("doc_id", "clip").collect():
        found.setdefault(r.doc_id, []).append((r.first_frame, r.frames, r.start_s, r.end_s))
    for d in docs.collect():
        data = d.text.encode()
        data += b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        frames = [data[i : i + 576] for i in range(0, len(data), 576)]
        cuts = plain_shots(frames)
        assert rows[d.doc_id].feature == "-".join(map(str, cuts)) + f"/{len(frames)}"
        ends = [*cuts[1:], len(frames)]
        assert found[d.doc_id] == [(a, b - a, a / media.FPS, b / media.FPS) for a, b in zip(cuts, ends)]


def test_clashing_columns(spark):
    df = frame(spark, [(1, "some text")]).withColumnRenamed("lang", "media").withColumnRenamed("source", "n_bytes")
    assert [(r.doc_id, r.n_bytes) for r in media.read_payloads(media.store_texts(df)).collect()] == [(1, 9)]
