"""Vector codecs: raw float32, and 2, 3 or 4 bits per coordinate after a randomized Hadamard rotation.

A quantized payload has a 16-byte header (4 bytes magic, codec id, 0, dimension as uint16, scale as float32, padded dimension as
uint32), then level numbers packed from the lowest bit on, and one slack byte. The scale is the root mean square of the
rotated vector. Since the rotation keeps inner products, queries are rotated once and scored against levels.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the payload format: the header's first bytes, its size, and the ids of the codecs by bits.
MAGIC = b"NQT\0"
HEADER = 16
IDS = {2: 1, 3: 2, 4: 3}
_HEAD = np.dtype([("magic", "<u4"), ("id", "u1"), ("zero", "u1"), ("dim", "<u2"), ("scale", "<f4"), ("size", "<u4")])
#: Levels of the scalar quantizer that is optimal for a standard normal, the positive half.
LEVELS = {
    2: (0.4528, 1.5104),
    3: (0.2451, 0.7560, 1.3439, 2.1519),
    4: (0.1284, 0.3880, 0.6568, 0.9423, 1.2562, 1.6180, 2.0690, 2.7326),
}
BITS = {"raw": 0, "2b": 2, "3b": 3, "4b": 4}


def padded(dim: int) -> int:
    """The next power of two."""
    return 1 if dim <= 1 else 1 << (dim - 1).bit_length()


def codec_name(name: str) -> str | None:
    """The codec that a name stands for: its own, or one that ends in it after an underscore; None for any other."""
    own = name.rsplit("_", 1)[-1]
    return own if own in BITS and (own != "raw" or name == "raw") else None


def payload_size(codec: str, dim: int) -> int:
    """Bytes of a payload."""
    bits = BITS[codec]
    return 4 * dim if not bits else HEADER + (bits * padded(dim) + 7) // 8 + 1


@lru_cache(maxsize=32)
def signs(size: int) -> np.ndarray:
    """The rotation's signs: bits, lowest first, of a splitmix64 stream seeded with the golden ratio and the size."""
    mask, state, out = (1 << 64) - 1, 0x9E3779B97F4A7C15 ^ size, []
    while len(out) < size:
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        out += [1.0 if z >> k & 1 else -1.0 for k in range(64)]
    return np.array(out[:size])


def levels(bits: int) -> np.ndarray:
    half = np.array(LEVELS[bits])
    return np.concatenate((-half[::-1], half))


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Rows padded with zeros, signs flipped, and Walsh-Hadamard transformed (not normalized)."""
    n, dim = vectors.shape
    size = padded(dim)
    x = np.zeros((n, size))
    x[:, :dim] = vectors
    x *= signs(size)
    step = 1
    while step < size:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return x


def encode(vectors: np.ndarray, codec: str) -> list[bytes]:
    """The payloads of equally long vectors; the first of equally near levels wins."""
    bits = BITS[codec]
    if not bits:
        return [v.astype("<f4").tobytes() for v in vectors]
    n, dim = vectors.shape
    x = rotate(vectors.astype(np.float64))
    scale = np.sqrt((x * x).mean(axis=1))
    unit = x / np.where(scale > 0, scale, 1)[:, None]
    table = levels(bits)
    number = np.abs(unit[:, :, None] - table).argmin(axis=2)
    stream = (number[:, :, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(n, -1)
    body = np.packbits(stream, axis=1, bitorder="little")
    return [struct.pack("<4sBBHfI", MAGIC, IDS[bits], 0, dim, s, x.shape[1]) + b.tobytes() + b"\0" for s, b in zip(scale.tolist(), body)]


def decode_levels(payload: bytes) -> tuple[int, np.ndarray] | None:
    """(dimension, rotated vector) of a quantized payload; None where it isn't one."""
    if len(payload) < HEADER or payload[:4] != MAGIC:
        return None
    _, number, _, dim, scale, size = struct.unpack_from("<4sBBHfI", payload)
    bits = next((b for b, i in IDS.items() if i == number), 0)
    if not bits or not scale > 0 or padded(dim) != size or len(payload) != HEADER + (bits * size + 7) // 8 + 1:
        return None
    stream = np.unpackbits(np.frombuffer(payload, np.uint8, (bits * size + 7) // 8, HEADER), bitorder="little")[: bits * size].reshape(size, bits)
    return dim, levels(bits)[stream @ (1 << np.arange(bits))] * scale


def scorer(queries: np.ndarray) -> Callable[[bytes, str], np.ndarray | None]:
    """A function of (payload, codec): cosines with all queries, or None where dimension or codec don't fit or a norm is zero."""
    dim = queries.shape[1]
    norms = np.linalg.norm(queries, axis=1)
    turned = rotate(queries.astype(np.float64))
    turned_norms = np.linalg.norm(turned, axis=1)

    def score(payload: bytes, codec: str) -> np.ndarray | None:
        if codec == "raw":
            v = np.frombuffer(payload, "<f4").astype(np.float64) if len(payload) == 4 * dim else None
            n, q, qn = (0.0, queries, norms) if v is None else (np.linalg.norm(v), queries, norms)
        else:
            found = decode_levels(payload)
            v = found[1] if found and found[0] == dim else None
            n, q, qn = (0.0 if v is None else np.linalg.norm(v)), turned, turned_norms
        if v is None or not n > 0:
            return None
        with np.errstate(invalid="ignore", divide="ignore"):
            return (q @ v) / (qn * n)

    return score


@dataclass(frozen=True)
class Codec:
    """How vectors become payloads: encode (a matrix to payloads), decode (a payload column to (rows, matrix) by dimension, maybe turned), turn (queries to match decoded vectors)."""

    encode: Callable[[np.ndarray], list[bytes]]
    decode: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]
    turn: Callable[[np.ndarray], np.ndarray]


CODECS: dict[str, Codec] = {}


def register(name: str, codec: Codec) -> None:
    """Makes a codec known to encode_column() and score_column()."""
    if name in CODECS:
        raise ValueError(f"a codec {name!r} is there already")
    CODECS[name] = codec


def encode_column(vec: Column, codec: str) -> Column:
    """Payloads of a vector column; null for a null or empty vector."""
    own = CODECS[codec]

    @F.pandas_udf("binary")
    def run(v):  # noqa: ANN001, ANN202
        import pandas as pd

        sizes = v.map(lambda x: 0 if x is None else len(x))
        out = pd.Series([None] * len(v), dtype=object)
        for n in sizes[sizes > 0].unique():
            at = np.flatnonzero(sizes.to_numpy() == n)
            for i, p in zip(at, own.encode(np.stack(v.iloc[at].to_numpy()))):
                out.iat[i] = p
        return out

    return run(vec)


def decode_column(col: pa.Array, codec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows of a payload column that hold a vector of the codec, and those vectors (rotated, if quantized) as a matrix: equally long payloads are unpacked as one array."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        flat = np.frombuffer(b"".join(col.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), n)
        if codec == "raw":
            if n % 4 == 0:
                yield rows, flat.view("<f4").astype(np.float64)
            continue
        bits = BITS[codec]
        if n < HEADER:
            continue
        head = np.ascontiguousarray(flat[:, :HEADER]).view(_HEAD).ravel()
        good = (head["magic"] == int.from_bytes(MAGIC, "little")) & (head["id"] == IDS[bits]) & (head["scale"] > 0)
        for dim in np.unique(head["dim"][good]).tolist():
            own = np.flatnonzero(good & (head["dim"] == dim) & (head["size"] == padded(dim)))
            if len(own) and n == payload_size(codec, dim):
                size = padded(dim)
                stream = np.unpackbits(flat[own, HEADER:-1], axis=1, bitorder="little")[:, : bits * size].reshape(len(own), size, bits)
                yield rows[own], levels(bits)[stream @ (1 << np.arange(bits))] * head["scale"][own, None].astype(np.float64)


def score_column(payload: Column, codec: str, queries: np.ndarray) -> Column:
    """array<double> of cosines of each payload with all queries (a bounded set, sent with the function); null where it doesn't fit."""
    own = CODECS[codec]
    turned = own.turn(np.asarray(queries, np.float64))

    @F.pandas_udf("array<double>")
    def run(p):  # noqa: ANN001, ANN202
        import pandas as pd

        norms = np.linalg.norm(turned, axis=1)
        out: list = [None] * len(p)
        for rows, m in own.decode(pa.array(p, pa.binary())):
            n = np.linalg.norm(m, axis=1)
            if m.shape[1] != turned.shape[1]:
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                sims = (m @ turned.T) / (n[:, None] * norms)
            for i, s in zip(rows[n > 0].tolist(), sims[n > 0]):
                out[i] = s
        return pd.Series(out, index=p.index, dtype=object)

    return run(payload)


for _name in BITS:
    register(_name, Codec(partial(encode, codec=_name), partial(decode_column, codec=_name), rotate if BITS[_name] else lambda q: q))
