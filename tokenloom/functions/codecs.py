"""Binary codecs of index files, for import and export: nibbles, LZ4 blocks with a size, delta-coded pairs, half floats."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack_nibbles(levels: np.ndarray) -> bytes:
    """Two 4-bit levels per byte, the first in the high half."""
    levels = np.asarray(levels, np.uint8)
    if len(levels) % 2:
        raise ValueError("an even number of levels is needed")
    return ((levels[0::2] << 4) | levels[1::2]).astype(np.uint8).tobytes()


def unpack_nibbles(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.stack([b >> 4, b & 15], 1).ravel()


def lz4_pack(data: bytes) -> bytes:
    """A raw LZ4 block behind its uncompressed size; nothing but the size for no data."""
    if not data:
        return struct.pack("<I", 0)
    return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)


def lz4_unpack(data: bytes) -> bytes:
    if len(data) < 4:
        raise ValueError("the size is missing")
    (size,) = struct.unpack_from("<I", data)
    return pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True) if size else b""


def encode_pairs(pairs: np.ndarray) -> bytes:
    """(major, minor) rows of unsigned 32-bit numbers: differences modulo 2**32, the minor starting anew with each major."""
    p = np.asarray(pairs, np.uint32).reshape(-1, 2)
    if not len(p):
        return lz4_pack(b"")
    d = p.copy()
    d[1:] -= p[:-1]
    new = np.append(True, d[1:, 0] != 0)
    d[new, 1] = p[new, 1]
    return lz4_pack(d.astype("<u4").tobytes())


def decode_pairs(data: bytes) -> np.ndarray:
    d = np.frombuffer(lz4_unpack(data), "<u4").reshape(-1, 2)
    if not len(d):
        return d
    major = np.cumsum(d[:, 0], dtype=np.uint32)
    total = np.cumsum(d[:, 1], dtype=np.uint32)
    start = np.maximum.accumulate(np.where(np.append(True, d[1:, 0] != 0), np.arange(len(d)), 0))
    return np.stack([major, total - total[start] + d[start, 1]], 1)


def floats_from_blob(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4")


def floats_to_blob(v: np.ndarray) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def halves_to_floats(bits: np.ndarray) -> np.ndarray:
    return np.asarray(bits, np.uint16).view(np.float16).astype(np.float32)


class SplitMix64:
    """The public-domain SplitMix64 generator, for seeds that must be the same everywhere."""

    def __init__(self, seed: int):
        self.state = seed & (1 << 64) - 1

    def next(self) -> int:
        mask = (1 << 64) - 1
        self.state = z = (self.state + 0x9E3779B97F4A7C15) & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    def sample(self, n: int, k: int) -> list[int]:
        """k distinct numbers below n by Floyd's method."""
        chosen: dict[int, None] = {}
        for j in range(n - k, n):
            t = self.next() % (j + 1)
            chosen[j if t in chosen else t] = None
        return list(chosen)
