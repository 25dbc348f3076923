"""Media columns: AVI files of motion JPEG, with shot detection.

Frames are 32 x 18 grey samples coded as lossless JPEG (sequential Huffman process
14, predictor 1), one image to a chunk, so that a stored payload reads back bit for
bit. A file is RIFF AVI with hdrl, movi and an idx1 index. Reading parses the chunks and
the index, then the markers of each frame, and decodes the frames of a batch in lockstep.
Shots are cut where the histogram difference between frames stands out from
its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut, raw

WIDTH, HEIGHT, FPS = 32, 18, 24
FRAME = WIDTH * HEIGHT
PAD = 255
#: Huffman code of difference categories: symbols by code length (lengths 1..16), for 8-bit samples.
CATEGORY_LENGTHS = {7: 2, 4: 2, 3: 3, 5: 4, 1: 4, 2: 4, 6: 4, 0: 4, 8: 5}
BINS = 32
NEIGHBOURS = 8
SPREADS = 3.0
LEAST_DIFFERENCE = 0.35


def _codes(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The body of a DHT table and each symbol's (code, length), by the canonical rule."""
    by = sorted(lengths.items(), key=lambda x: (x[1], -x[0]))
    counts, code, last, out = [0] * 16, 0, 0, {}
    for symbol, n in by:
        code <<= n - last
        out[symbol], last = (code, n), n
        counts[n - 1] += 1
        code += 1
    return bytes([0, *counts, *(s for s, _ in by)]), out


_DHT, _CODES = _codes(CATEGORY_LENGTHS)


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255 (index + 255)."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = _CODES[s]
        extra = d if d > 0 else d + (1 << s) - 1
        bits[d + 255], size[d + 255] = code << s | extra, n + s
    return bits, size


def _decode_table(dht: bytes) -> np.ndarray:
    """For every 16 next bits: (difference << 8 | bits used), 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 17
    for n in range(1, 17):
        for _ in range(dht[n]):
            s = dht[at]
            if n + s > 16 or s > 15:
                raise ValueError("samples of over 8 bits")
            first, many = code << (16 - n), 1 << (16 - n)
            extra = (np.arange(many) >> (16 - n - s)) & ((1 << s) - 1)
            d = np.where(extra >> max(s - 1, 0) & 1, extra, extra - (1 << s) + 1) if s else np.zeros(many, np.int64)
            table[first : first + many] = d * 256 + n + s
            code, at = code + 1, at + 1
        code <<= 1
    return table


_BITS, _SIZES = _encode_tables()
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00"
    + b"\xff\xc4" + struct.pack(">H", 2 + len(_DHT)) + _DHT
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
)


#: Frames that are encoded or decoded together.
TOGETHER = 4096


def predict_differences(frames: np.ndarray) -> np.ndarray:
    """Differences (n, FRAME) from the left sample; first column: from above; first sample: from 128."""
    x = frames.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    return d.reshape(-1, FRAME)


def undo_differences(d: np.ndarray) -> np.ndarray:
    x = d.reshape(-1, HEIGHT, WIDTH).astype(np.int32)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2) & 255).astype(np.uint8).reshape(-1, FRAME)


def encode_scans(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of all frames after another, stuffed, and the frames' offsets in it."""
    d = predict_differences(frames) + 255
    bits, size = _BITS[d], _SIZES[d]
    total = size.sum(axis=1)
    nbytes = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(nbytes)))
    at = (np.cumsum(size, axis=1) - size) + start[:-1, None] * 8
    word = (bits << (24 - size - (at & 7))).ravel()
    byte = (at >> 3).ravel()
    n = int(start[-1])
    out = sum(np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, n + 3)[: n + 3] for k in range(3)).astype(np.uint8)[:n]
    out[start[1:] - 1] |= ((1 << (nbytes * 8 - total)) - 1).astype(np.uint8)  # padded with ones
    is_ff = out == 255
    where = np.arange(n) + np.cumsum(is_ff) - is_ff
    stuffed = np.zeros(n + int(is_ff.sum()), np.uint8)
    stuffed[where] = out
    offsets = np.append(where, len(stuffed))[start]
    return stuffed, offsets


def decode_scans(scans: list[bytes], table: np.ndarray) -> np.ndarray:
    """Frames (n, FRAME) from entropy-coded data; all scans advance sample by sample together."""
    body = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    starts = np.concatenate(([0], ends[:-1]))
    keep = np.ones(len(body), bool)
    keep[1:] = ~((body[1:] == 0) & (body[:-1] == 255))
    shift = np.concatenate(([0], np.cumsum(keep)))
    clean = body[keep].astype(np.uint32)
    clean = np.concatenate((clean, np.zeros(8, np.uint32)))
    word = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    at = shift[starts] * 8
    stop = shift[ends] * 8
    out = np.empty((FRAME, len(scans)), np.int16)
    for i in range(FRAME):
        got = table[word[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)]
        out[i] = got >> 8
        at = np.minimum(at + (got & 255), (len(word) - 1) * 8)
    if (at > stop).any() or (stop - at > 7).any():
        raise ValueError("a scan is cut short or too long")
    return undo_differences(out.T)


def build_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file of the JPEG images."""
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frames per second and the images that the index names; ValueError where the file is damaged."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = 0.0, -1, b""

    def walk(at: int, end: int) -> None:
        nonlocal fps, movi, index
        while at + 8 <= end:
            name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if at + 8 + n > end:
                raise ValueError("a chunk is cut short")
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    walk(at + 12, at + 8 + n)
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", media, at + 8 + 20)
                fps = rate / scale
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)

    walk(12, len(media))
    if movi < 0 or not fps:
        raise ValueError("no movi list or no video stream")
    frames = []
    for name, _, at, n in struct.iter_unpack("<4sIII", index):
        if name == b"00dc":
            if media[movi + at : movi + at + 4] != name:
                raise ValueError("the index misses a frame")
            frames.append(media[movi + at + 8 : movi + at + 8 + n])
    return fps, frames


def parse_jpeg(image: bytes) -> tuple[bytes, bytes]:
    """The Huffman table and the entropy-coded data of a lossless grey frame."""
    if image.startswith(_HEAD) and image.endswith(b"\xff\xd9"):
        return _DHT, image[len(_HEAD) : -2]
    at, dht, sized = 2, b"", False
    if image[:2] != b"\xff\xd8" or image[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG image")
    while True:
        marker, n = image[at : at + 2], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == b"\xff\xc3":
            sized = struct.unpack(">BHHB", body[:6]) == (8, HEIGHT, WIDTH, 1)
        elif marker == b"\xff\xc4":
            dht = body
        elif marker == b"\xff\xda":
            if not sized or not dht or body[3] != 1:
                raise ValueError("another kind of JPEG image")
            return dht, image[at:-2]
        elif n < 2 or marker[:1] != b"\xff":
            raise ValueError("a JPEG image is damaged")


def shots(frames: np.ndarray, neighbours: int = NEIGHBOURS, spreads: float = SPREADS, least: float = LEAST_DIFFERENCE) -> list[int]:
    """The first frames of the shots.

    The difference of frames t-1 and t is half the L1 distance of their histograms (0 to 1).
    A shot begins at t where it is at least ``least`` and exceeds the mean of
    the other differences at most ``neighbours`` away by ``spreads`` standard deviations.
    """
    n = len(frames)
    if n < 2:
        return [0][:n]
    hist = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * FRAME)
    s1, s2 = (np.concatenate(([0.0], np.cumsum(x))) for x in (d, d * d))
    lo, hi = np.maximum(np.arange(n - 1) - neighbours, 0), np.minimum(np.arange(n - 1) + neighbours + 1, n - 1)
    m = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / m
    spread = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / m - mean * mean, 0))
    return [0, *(np.flatnonzero((d >= least) & (d > mean + spreads * spread)) + 1).tolist()]


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A video for each row: (doc_id, n_bytes, media). A null text is empty; an empty one has one frame of padding.

    Repeated rows give repeated rows, equal texts equal media; an empty table an empty result. Only the id and the text are read, so
    other columns may have any names. A long text is encoded TOGETHER frames at a time; a file has to stay under 2 GiB.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", 1 << 20):
            data, at = raw(b.column(1))
            sizes = np.diff(at)
            n = np.maximum(-(-sizes // FRAME), 1)
            first = np.concatenate(([0], np.cumsum(n)))
            padded = np.full(first[-1] * FRAME, PAD, np.uint8)
            padded[np.arange(len(data)) + np.repeat(first[:-1] * FRAME - at[:-1], sizes)] = data
            images = []
            for lo in range(0, first[-1], TOGETHER):
                scans, offsets = encode_scans(padded[lo * FRAME : (lo + TOGETHER) * FRAME].reshape(-1, FRAME))
                scans, offsets = scans.tobytes(), offsets.tolist()
                images += [_HEAD + scans[i:j] + b"\xff\xd9" for i, j in zip(offsets, offsets[1:])]
            media = [build_avi(images[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(media, pa.binary())], schema=MEDIA)

    return rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[float], np.ndarray, list[int]]]:
    tables: dict[bytes, np.ndarray] = {}
    for b in cut(batches, "media", 1 << 20):
        films = [parse_avi(m) if m is not None else (0.0, []) for m in b.column("media").to_pylist()]
        images = [parse_jpeg(x) for _, film in films for x in film]
        frames = np.empty((len(images), FRAME), np.uint8)
        for dht in dict.fromkeys(d for d, _ in images):
            if dht not in tables:
                tables[dht] = _decode_table(dht)
            own = [i for i, (d, _) in enumerate(images) if d == dht]
            for lo in range(0, len(own), TOGETHER):
                part = own[lo : lo + TOGETHER]
                frames[part] = decode_scans([images[i][1] for i in part], tables[dht])
        yield b, [fps for fps, _ in films], frames, np.concatenate(([0], np.cumsum([len(f) for _, f in films]))).tolist()


def read_payloads(media: DataFrame) -> DataFrame:
    """What the stored files hold: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    ``feature`` names the shots as first frames, "0-24-57/91", with the number of
    frames at the end. A null media has no frames. A damaged file fails the job.
    """
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, frames, at in _decoded(batches):
            out = []
            for i, m in enumerate(b.column("media").to_pylist()):
                own = frames[at[i] : at[i + 1]]
                payload = own.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), "-".join(map(str, shots(own))) + f"/{len(own)}"))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, names)


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot: (doc_id, clip, first_frame, frames, start_s, end_s)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, fps, frames, at in _decoded(batches):
            out = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                n = at[i + 1] - at[i]
                cuts = [*shots(frames[at[i] : at[i + 1]]), n]
                out += [(doc, k, x, y - x, x / fps[i], y / fps[i]) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double")
