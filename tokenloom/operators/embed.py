"""Embedders: text -> one unit vector per token. Anything with this shape can be plugged in."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import SplitMix64


class InputTooLarge(ValueError):
    pass


class Embedder(ABC):
    """dims must be positive and even: residuals are stored as pairs of nibbles."""

    dims: int = 16
    model: str = "none"
    max_tokens: int = 4096

    def __init__(self, overflow: str = "truncate"):
        if self.dims <= 0 or self.dims % 2:
            raise ValueError("dims must be positive and even")
        if overflow not in ("truncate", "reject"):
            raise ValueError("overflow is truncate or reject")
        self.overflow = overflow

    def tokens(self, text: str) -> list[str]:
        return text.lower().split()

    def limited(self, tokens: list[str]) -> list[str]:
        if len(tokens) > self.max_tokens and self.overflow == "reject":
            raise InputTooLarge(f"{len(tokens)} tokens, at most {self.max_tokens}")
        return tokens[: self.max_tokens]

    @abstractmethod
    def vectors(self, tokens: list[str]) -> np.ndarray: ...

    def encode(self, text: str) -> np.ndarray:
        return self.vectors(self.limited(self.tokens(text)))

    def encode_query(self, text: str, min_surface: int = 0) -> np.ndarray:
        """As encode, without tokens of at most min_surface characters."""
        return self.vectors([t for t in self.limited(self.tokens(text)) if len(t) > min_surface])


class HashEmbedder(Embedder):
    """Component i of a token from the SHA-256 of token:i, normalised; any system with SHA-256 can recompute it."""

    model = "hash-16"

    def __init__(self, dims: int = 16, overflow: str = "truncate"):
        self.dims = dims
        super().__init__(overflow)
        self.known: dict[str, np.ndarray] = {}

    def one(self, token: str) -> np.ndarray:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            raw = np.array([int(hashlib.sha256(f"{token}:{i}".encode()).hexdigest()[:8], 16) for i in range(self.dims)], float)
            v = raw / 2**31 - 1
            self.known[token] = v / np.linalg.norm(v)
        return self.known[token]

    def vectors(self, tokens: list[str]) -> np.ndarray:
        return np.stack([self.one(t) for t in tokens]).astype(np.float32) if tokens else np.empty((0, self.dims), np.float32)


class ToyEmbedder(Embedder):
    """FNV-1a of a token spread over 16 components; only 31 different vectors, for compatibility."""

    dims, model = 16, "toy-fnv"

    def vectors(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), self.dims), np.float32)
        for r, t in enumerate(tokens):
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
            v = np.array([((h + i) & (1 << 64) - 1) % 31 - 15 for i in range(self.dims)], float)
            out[r] = v / (np.linalg.norm(v) or 1)
        return out


class SeededEmbedder(Embedder):
    """A vector depends on the whole text and the place: only equal texts match. For tests."""

    model = "seeded"

    def __init__(self, dims: int = 128, overflow: str = "truncate"):
        self.dims = dims
        super().__init__(overflow)

    def encode(self, text: str) -> np.ndarray:
        tokens = self.limited(self.tokens(text))
        out = np.zeros((len(tokens), self.dims), np.float32)
        for i in range(len(tokens)):
            rng = SplitMix64(int.from_bytes(hashlib.sha256(f"{text}|{i}".encode()).digest()[:8], "big"))
            v = np.array([rng.next() / 2**63 - 1 for _ in range(self.dims)])
            out[i] = v / np.linalg.norm(v)
        return out

    def vectors(self, tokens: list[str]) -> np.ndarray:
        return self.encode(" ".join(tokens))


def embed(docs: DataFrame, embedder: Embedder, *, id: str, text: str, query: bool = False, min_surface: int = 0) -> DataFrame:
    """One row per token: id, token_offset, vec. A null text has no tokens."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"{id} {kind}, token_offset int, vec array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0), batch.column(1).to_pylist()):
                v = np.empty((0, embedder.dims), np.float32) if t is None else embedder.encode_query(t, min_surface) if query else embedder.encode(t)
                if len(v):
                    vec = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * embedder.dims, pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(v), batch.schema.field(0).type), pa.array(np.arange(len(v), dtype=np.int32)), vec], [id, "token_offset", "vec"])

    return docs.select(id, text).mapInArrow(run, schema)


def windows(n: Column, size: int = 512, stride: int = 256) -> Column:
    """Starts of sliding windows over n tokens; the last is shifted left to end at n."""
    more = F.sequence(F.lit(0).cast("long"), F.greatest(n - size, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(more, F.array((n - size).cast("long")))))


def merge_windows(parts: DataFrame, least_norm: float = 1.0) -> DataFrame:
    """parts (doc, pos, raw_norm, vec) of overlapping windows -> (doc, pos, vec).

    Unit vectors of a position are averaged; positions whose mean raw norm is
    under least_norm are dropped, and so are means of length zero.
    """
    each = parts.select("doc", "pos", "raw_norm", F.posexplode("vec").alias("dim", "x"))
    mean = each.groupBy("doc", "pos", "dim").agg(F.avg("x").alias("x"), F.avg("raw_norm").alias("raw_norm"))
    whole = mean.groupBy("doc", "pos").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"), F.max("raw_norm").alias("raw_norm"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return whole.where((F.col("raw_norm") >= least_norm) & (F.col("size") > 0)).select("doc", "pos", F.transform("v", lambda p: p["x"] / F.col("size")).alias("vec"))


class NeuralEmbedder(Embedder):
    """A T5 encoder over sliding windows of token ids. encoder: functions.kernels.Encoder; tokenizer: operators.tokenizer.Unigram."""

    def __init__(self, encoder, tokenizer, *, window: int = 512, stride: int = 256, least_norm: float = 1.0, model: str = "t5", overflow: str = "truncate"):
        self.encoder, self.tokenizer, self.window, self.stride, self.least_norm = encoder, tokenizer, window, stride, least_norm
        self.dims, self.model, self.max_tokens = len(encoder.projection), model, 8 * window
        super().__init__(overflow)

    def starts(self, n: int) -> list[int]:
        if n <= self.window:
            return [0] if n else []
        return sorted({*range(0, n - self.window + 1, self.stride), n - self.window})

    def encode(self, text: str, min_surface: int = 0) -> np.ndarray:
        if not text.strip():
            return np.empty((0, self.dims), np.float32)
        ids = self.limited(self.tokenizer.encode(text))
        n = len(ids)
        total, norms, times = np.zeros((n, self.dims)), np.zeros(n), np.zeros(n)
        for a in self.starts(n):
            raw = self.encoder.raw(np.array(ids[a : a + self.window]))
            size = np.linalg.norm(raw, axis=1)
            part = slice(a, a + len(raw))
            total[part] += raw / np.maximum(size, 1e-12)[:, None]
            norms[part] += size
            times[part] += 1
        mean, norm = total / times[:, None], norms / times
        length = np.linalg.norm(mean, axis=1)
        keep = (norm >= self.least_norm) & (length > 0)
        if min_surface:
            keep &= np.array([len(self.tokenizer.decode([i]).strip()) > min_surface for i in ids])
        return (mean[keep] / length[keep, None]).astype(np.float32)

    def encode_query(self, text: str, min_surface: int = 0) -> np.ndarray:
        return self.encode(text, min_surface)

    def vectors(self, tokens: list[str]) -> np.ndarray:
        return self.encode(" ".join(tokens))
