"""Numeric kernels of a T5-style encoder, in numpy, for an embedder that runs inside Arrow batches.

Weights come from a GGUF file (see sources/gguf.py); 4-bit blocks are expanded
when a tensor is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

Q4K_VALUES, Q4K_BYTES = 256, 144


def q4k_expand(data: bytes, n: int) -> np.ndarray:
    """n values of 4-bit super-blocks: 256 values in 144 bytes, eight sub-blocks with 6-bit scales and minima."""
    if n % Q4K_VALUES or len(data) < n // Q4K_VALUES * Q4K_BYTES:
        raise ValueError("the data do not hold whole blocks for that many values")
    b = np.frombuffer(data, np.uint8, n // Q4K_VALUES * Q4K_BYTES).reshape(-1, Q4K_BYTES)
    d = b[:, 0:2].copy().view("<f2").astype(np.float32)
    dmin = b[:, 2:4].copy().view("<f2").astype(np.float32)
    s = b[:, 4:16].astype(np.uint8)
    low_scale, low_min = s[:, 0:4] & 63, s[:, 4:8] & 63
    high_scale = (s[:, 8:12] & 15) | (s[:, 0:4] >> 6) << 4
    high_min = (s[:, 8:12] >> 4) | (s[:, 4:8] >> 6) << 4
    scale = d * np.concatenate([low_scale, high_scale], 1)
    least = dmin * np.concatenate([low_min, high_min], 1)
    q = b[:, 16:].reshape(-1, 4, 1, 32)
    nibbles = np.concatenate([q & 15, q >> 4], 2).reshape(-1, 8, 32)
    return (scale[:, :, None] * nibbles - least[:, :, None]).reshape(-1).astype(np.float32)


def gather(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of a table; zeros for an id outside of it."""
    ok = (ids >= 0) & (ids < len(table))
    out = np.zeros((len(ids), table.shape[1]), np.float32)
    out[ok] = table[ids[ok]]
    return out


def rms_norm(x: np.ndarray, gain: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * gain


def softmax(scores: np.ndarray, bias: np.ndarray | float = 0.0) -> np.ndarray:
    s = scores + bias
    s = np.exp(s - s.max(-1, keepdims=True))
    return s / s.sum(-1, keepdims=True)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def gated_gelu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    return gelu(gate) * up


def l2_norm(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), eps)


def row_norms(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x, axis=-1)


def position_buckets(n: int, buckets: int = 32, furthest: int = 128) -> np.ndarray:
    """(n, n) relative-position buckets of key minus query, both directions."""
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    half = buckets // 2
    exact = half // 2
    far = np.abs(d)
    with np.errstate(divide="ignore"):
        log = exact + np.floor(np.log(far / exact) / math.log(furthest / exact) * (half - exact))
    return (np.where(d > 0, half, 0) + np.where(far < exact, far, np.minimum(log, half - 1))).astype(int)


@dataclass
class Layer:
    attention_norm: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    feed_norm: np.ndarray
    gate: np.ndarray
    up: np.ndarray
    down: np.ndarray


@dataclass
class Encoder:
    """T5 encoder with a projection; weights are (out, in). position: (buckets, heads) bias of all layers."""

    embedding: np.ndarray
    layers: list[Layer]
    position: np.ndarray
    final_norm: np.ndarray
    projection: np.ndarray
    heads: int

    def attention(self, x: np.ndarray, layer: Layer, bias: np.ndarray) -> np.ndarray:
        n, split = len(x), lambda w: (x @ w.T).reshape(len(x), self.heads, -1).transpose(1, 0, 2)
        q, k, v = split(layer.q), split(layer.k), split(layer.v)
        shares = softmax(q @ k.transpose(0, 2, 1), bias)  # T5 does not scale the scores
        return (shares @ v).transpose(1, 0, 2).reshape(n, -1) @ layer.o.T

    def raw(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Projected vectors of token ids before normalisation; masked-out keys are not attended to."""
        x = gather(self.embedding, np.asarray(ids))
        bias = self.position[position_buckets(len(x), len(self.position))].transpose(2, 0, 1)
        if mask is not None:
            bias = bias + np.where(np.asarray(mask, bool), 0.0, -1e9)[None, None, :]
        for layer in self.layers:
            x = x + self.attention(rms_norm(x, layer.attention_norm), layer, bias)
            h = rms_norm(x, layer.feed_norm)
            x = x + gated_gelu(h @ layer.gate.T, h @ layer.up.T) @ layer.down.T
        return rms_norm(x, self.final_norm) @ self.projection.T

    def encode(self, ids: np.ndarray) -> np.ndarray:
        return l2_norm(self.raw(ids)).astype(np.float32) if len(ids) else np.empty((0, len(self.projection)), np.float32)
