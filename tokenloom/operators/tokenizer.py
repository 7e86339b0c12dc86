"""Unigram tokenizer read from a tokenizer.json: normalise, split at spaces, best path over piece scores, template."""

from __future__ import annotations

import base64
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"


@dataclass
class Added:
    content: str
    id: int
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False


@dataclass
class Unigram:
    """pieces: (piece, score), by id. An unknown character scores the worst piece less 10, and neighbours fuse."""

    pieces: list[tuple[str, float]]
    unk: int | None = None
    added: list[Added] = field(default_factory=list)
    normalizers: list[dict] = field(default_factory=list)
    prepend: bool = True
    prefix: list[int] = field(default_factory=list)
    suffix: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.by_piece = {p: (i, s) for i, (p, s) in enumerate(self.pieces)}
        self.longest = max((len(p) for p, _ in self.pieces), default=0)
        self.unk_score = min((s for _, s in self.pieces), default=0.0) - 10
        names = sorted((a.content for a in self.added), key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.by_content = {a.content: a for a in self.added}
        self.charsmaps: dict[str, CharsMap] = {}

    @classmethod
    def load(cls, source: str | Path | bytes) -> Unigram:
        data = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())
        model = data["model"]
        if model.get("type", "Unigram") != "Unigram":
            raise ValueError("only Unigram models are read")
        flat = lambda n: [] if not n else [x for y in n["normalizers"] for x in flat(y)] if n["type"] == "Sequence" else [n]
        pre = data.get("pre_tokenizer") or {}
        prepend = pre.get("prepend_scheme", "always" if pre.get("add_prefix_space", True) else "never") != "never"
        added = [Added(a["content"], a["id"], a.get("special", False), a.get("single_word", False), a.get("lstrip", False), a.get("rstrip", False)) for a in data.get("added_tokens", [])]
        prefix, suffix = [], []
        post = data.get("post_processor") or {}
        if post.get("type") == "TemplateProcessing":
            out = prefix
            for part in post["single"]:
                if "Sequence" in part:
                    out = suffix
                else:
                    out += post["special_tokens"][part["SpecialToken"]["id"]]["ids"]
        return cls([(p, float(s)) for p, s in model["vocab"]], model.get("unk_id"), added, flat(data.get("normalizer")), prepend, prefix, suffix)

    def normalise(self, text: str) -> str:
        for n in self.normalizers:
            kind = n["type"]
            if kind == "Replace":
                pattern = n["pattern"]
                text = re.sub(pattern["Regex"], lambda m, c=n["content"]: c, text) if "Regex" in pattern else text.replace(pattern["String"], n["content"])
            elif kind == "Strip":
                text = text.lstrip() if n.get("strip_left", True) else text
                text = text.rstrip() if n.get("strip_right", True) else text
            elif kind in ("NFC", "NFKC"):
                text = unicodedata.normalize(kind, text)
            elif kind == "Precompiled":
                text = self._charsmap(n.get("precompiled_charsmap") or "").normalise(text)
            else:
                raise ValueError(f"normalizer {kind} is not supported")
        return text

    def _charsmap(self, encoded: str) -> CharsMap:
        if encoded not in self.charsmaps:
            self.charsmaps[encoded] = CharsMap(base64.b64decode(encoded) or b"\0\0\0\0")
        return self.charsmaps[encoded]

    def best_path(self, word: str) -> list[int]:
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            if best[i] == float("-inf"):
                continue
            one = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (hit := self.by_piece.get(word[i:j])) is not None:
                    one |= j == i + 1
                    if best[i] + hit[1] > best[j]:
                        best[j], back[j] = best[i] + hit[1], (i, hit[0])
            if not one and best[i] + self.unk_score > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unk_score, (i, self.unk)
        ids, at = [], n
        while at:
            at, piece = back[at]
            ids.append(piece)
        ids.reverse()
        out: list[int] = []
        for i in ids:
            if i is None or i == self.unk and out and out[-1] == self.unk:
                continue
            out.append(i)
        return out

    def _plain(self, text: str) -> list[int]:
        text = self.normalise(text)
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prepend and not text.startswith(SPACE):
            text = SPACE + text
        return [i for word in re.findall(f"{SPACE}?[^{SPACE}]*", text) if word for i in self.best_path(word)]

    def encode(self, text: str) -> list[int]:
        parts = self.split.split(text) if self.split else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                added = self.by_content[part]
                around = (parts[k - 1][-1:], parts[k + 1][:1])
                if added.single_word and any(c.isalnum() or c == "_" for c in around):
                    ids += self._plain(part)
                else:
                    ids.append(added.id)
                continue
            if k and self.by_content[parts[k - 1]].rstrip:
                part = part.lstrip()
            if k + 1 < len(parts) and self.by_content[parts[k + 1]].lstrip:
                part = part.rstrip()
            ids += self._plain(part)
        return [*self.prefix, *ids, *self.suffix]

    def decode(self, ids: list[int]) -> str:
        special = {a.id for a in self.added if a.special}
        names = {a.id: a.content for a in self.added}
        text = "".join(names.get(i) or self.pieces[i][0] for i in ids if i not in special)
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def tokenise(docs: DataFrame, tokenizer: Unigram, *, id: str, text: str) -> DataFrame:
    """id and the token ids of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary, whatever the size of docs
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [shared.value.encode(t) if t is not None else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id, "ids"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, ids array<int>")


class CharsMap:
    """A precompiled character map: a double-array trie of inputs and a blob of NUL-ended replacements.

    Unit layout of the public Darts-clone structure: bit 8 marks a leaf, bits 0-7
    and 31 are the label, bits 10 and up the offset, widened by bit 9.
    """

    def __init__(self, data: bytes):
        (size,) = struct.unpack_from("<I", data)
        if size % 4 or 4 + size > len(data):
            raise ValueError("the trie is longer than the map")
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4)
        self.texts = data[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, int] | None:
        """Bytes and value of the longest entry that data holds at start."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & (1 << 31 | 0xFF) != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1 and node < len(self.units):
                found = i + 1 - start, self.units[node] & 0x7FFFFFFF
        return found

    def normalise(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                end = self.texts.index(b"\0", hit[1])
                out.append(self.texts[hit[1] : end])
                at += hit[0]
            else:  # a whole character passes unchanged
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                out.append(data[at : at + n])
                at += n
        return b"".join(out).decode()
