"""Reader of GGUF model files, versions 2 and 3: metadata at once, tensors when asked for."""

from __future__ import annotations

import mmap
import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from ..functions.kernels import Q4K_BYTES, Q4K_VALUES, Encoder, Layer, q4k_expand

_NUMBERS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
_STRING, _ARRAY = 8, 9
F32, F16, Q4K = 0, 1, 12


@dataclass(frozen=True)
class Tensor:
    name: str
    shape: tuple[int, ...]  # rows first
    kind: int
    offset: int


class GGUF:
    def __init__(self, path: str | Path):
        self.file = open(path, "rb")
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.at = 0
        if self.data[:4] != b"GGUF":
            raise ValueError("not a GGUF file")
        self.at = 4
        self.version = self._number(4)
        if self.version not in (2, 3):
            raise ValueError(f"GGUF version {self.version} is not read")
        n_tensors, n_values = self._number(10), self._number(10)
        self.metadata = {}
        for _ in range(n_values):
            key = self._string()
            self.metadata[key] = self._value(self._number(4))
        found = []
        for _ in range(n_tensors):
            name, dims = self._string(), self._number(4)
            shape = tuple(self._number(10) for _ in range(dims))[::-1]
            found.append(Tensor(name, shape, self._number(4), self._number(10)))
        align = int(self.metadata.get("general.alignment", 32))
        self.start = -(-self.at // align) * align
        self.tensors = {t.name: t for t in found}

    def _number(self, kind: int):
        (x,) = struct.unpack_from(f := _NUMBERS[kind], self.data, self.at)
        self.at += struct.calcsize(f)
        return x

    def _string(self) -> str:
        n = self._number(10)
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def _value(self, kind: int):
        if kind == _STRING:
            return self._string()
        if kind == _ARRAY:
            inner, n = self._number(4), self._number(10)
            return [self._value(inner) for _ in range(n)]
        return self._number(kind)

    def tensor(self, name: str) -> np.ndarray:
        t = self.tensors[name]
        n = int(np.prod(t.shape))
        size = {F32: 4 * n, F16: 2 * n, Q4K: n // Q4K_VALUES * Q4K_BYTES}.get(t.kind)
        if size is None:
            raise ValueError(f"tensor type {t.kind} is not read")
        raw = self.data[self.start + t.offset : self.start + t.offset + size]
        if len(raw) < size:
            raise ValueError(f"{name} ends beyond the file")
        flat = q4k_expand(raw, n) if t.kind == Q4K else np.frombuffer(raw, "<f4" if t.kind == F32 else "<f2").astype(np.float32)
        return flat.reshape(t.shape)

    def close(self) -> None:
        self.data.close()
        self.file.close()

    def encoder(self) -> Encoder:
        """A T5 encoder by the usual tensor names of the format."""
        heads = int(self.metadata.get("t5encoder.attention.head_count") or self.metadata["t5.attention.head_count"])
        layers = []
        while f"enc.blk.{len(layers)}.attn_q.weight" in self.tensors:
            of = lambda x, i=len(layers): self.tensor(f"enc.blk.{i}.{x}.weight")
            layers.append(Layer(of("attn_norm"), of("attn_q"), of("attn_k"), of("attn_v"), of("attn_o"), of("ffn_norm"), of("ffn_gate"), of("ffn_up"), of("ffn_down")))
        position = self.tensor("enc.blk.0.attn_rel_b.weight")
        if position.shape[1] != heads:
            position = position.T
        return Encoder(self.tensor("token_embd.weight"), layers, position, self.tensor("enc.output_norm.weight"), self.tensor("projection.weight"), heads)
