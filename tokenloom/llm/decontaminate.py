"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits (lower-cased) and of any character
beyond ASCII. A benchmark item contributes each run of `n` consecutive words as
a window; an item of fewer words, but not none, is one window. A sorted array of
64-bit window hashes, with the items' word numbers, is broadcast; document windows
are looked up there and a hit is verified against the word numbers themselves, so
a hash collision never counts.

Defined cases: a null or empty document has no words and no hits. A null or
empty item has no windows. Rows of an item with a null id mark words as hit but
are not listed among the items. Items that share an id count as one. Repeated
documents are each scanned, and items that share a window, however many, are looked
at once for each document it occurs in. Texts of any length are scanned whole. An
empty table gives no rows, and an empty benchmark no hits. Columns besides id and
text are carried along untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, materialise, with_size

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: What the scan adds: number of words, hit word ranges, their code points, ids of items.
SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "end", "char_start", "char_end")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HIT = pa.struct([(k, pa.int64()) for k in ("start", "end", "char_start", "char_end")])


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class WindowSet:
    """Hash set of the windows of some benchmark items: some 30 bytes a word, and the distinct words."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str | None] = []
        ids: list[np.ndarray] = []
        for item, text in items:
            if found := words_of(text):
                self.items.append(item)
                ids.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found], np.uint64))
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.uint64)
        self.starts = np.cumsum([0, *map(len, ids)])
        places: dict[int, list[np.ndarray]] = {}
        for a, own in zip(self.starts, ids):
            size = min(n, len(own))
            places.setdefault(size, []).append(a + np.arange(len(own) - size + 1))
        #: by size of window: sorted hashes of the distinct windows, one place of each, and where its items start and end in self.owners
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        owners, n_owners = [np.empty(0, np.int64)], 0
        for size, at in sorted(places.items()):
            at = np.concatenate(at)
            h = rolling(self.ids, at, size)
            item = np.searchsorted(self.starts, at, "right") - 1
            # Equal windows side by side: by hash, then by the words themselves, then by item.
            order = np.lexsort((item, *(self.ids[at + j] for j in range(size)), h))
            at, h, item = at[order], h[order], item[order]
            new = np.append(True, h[1:] != h[:-1])
            for j in range(size):
                new[1:] |= self.ids[at[1:] + j] != self.ids[at[:-1] + j]
            first = np.flatnonzero(new)
            self.windows[size] = h[first], at[first], np.append(first, len(at)) + n_owners
            owners.append(item)
            n_owners += len(item)
        self.owners = np.concatenate(owners)

    def scan(self, found: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]] | None]:
        """Per document: ranges of words inside occurring windows and the items, or None."""
        hits: dict[int, tuple[list, set]] = {}
        starts = np.cumsum([0, *(len(w) + 1 for w in found)])
        ids = np.zeros(starts[-1], np.uint64)  # a zero, as for an unknown word, ends each document
        for k, ws in enumerate(found):
            ids[starts[k] : starts[k] + len(ws)] = np.fromiter(map(self.vocab.get, ws, repeat(0)), np.uint64, len(ws))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, places, items) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            h = rolling(ids, at, size)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            docs = np.searchsorted(starts, at, "right") - 1
            for i, a, b, doc in zip(at.tolist(), low.tolist(), high.tolist(), docs.tolist()):
                for w in range(a, b):  # more than one only if hashes clash
                    p = places[w]
                    if (self.ids[p : p + size] == ids[i : i + size]).all():
                        ranges, windows = hits.setdefault(doc, ([], set()))
                        ranges.append((i - int(starts[doc]), i - int(starts[doc]) + size))
                        windows.add((int(items[w]), int(items[w + 1])))
        return [(merged(hits[k][0]), self._names(hits[k][1])) if k in hits else None for k in range(len(found))]

    def _names(self, windows: set[tuple[int, int]]) -> set[str]:
        which = np.unique(np.concatenate([self.owners[a:b] for a, b in windows]))
        return {x for x in (self.items[i] for i in which.tolist()) if x is not None}


def rolling(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h + ids[at + j]) * _BASE
            h ^= h >> np.uint64(29)
    return h


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges as disjoint, non-adjacent ranges in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([int(a), int(b)])
    return [(int(a), int(b)) for a, b in out]


def with_chars(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the code points from the first word's start to the last one's end."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    place = lambda byte: len(text[:byte].decode())
    return [{"start": a, "end": b, "char_start": place(at[a][0]), "char_end": place(at[b - 1][1])} for a, b in ranges]


_SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_HIT)), ("items", pa.list_(pa.string()))])


def _scanner(windows, text_at: int, names: list[str], hits_only: bool = False):
    """mapInArrow function that adds the scan column; hits_only: rows without a hit, and the text, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = windows.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            rows: list[dict] = []
            for a, b in chunks([len(t or b"") for t in texts], 2 << 20):
                found = [words_of(t) if t else [] for t in texts[a:b]]
                for k, (ws, hit) in enumerate(zip(found, known.scan(found))):
                    ranges, items = hit or ([], set())
                    rows.append({"n_words": len(ws), "hits": with_chars(texts[a + k], ranges) if ranges else [], "items": sorted(items)})
            columns = [*batch.columns, pa.array(rows, _SCAN_ARROW)]
            if hits_only:
                keep = pa.array([bool(r["hits"]) for r in rows], pa.bool_())
                columns = [c.filter(keep) for i, c in enumerate(columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _numbered(docs: DataFrame, text: str, row: str, words: str) -> DataFrame:
    """docs with a number for each row and its number of words, written: the one copy of the corpus that blocks of items take."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t)) if t else 0 for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, words])

    counted = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(words, T.LongType())]))
    return materialise(counted.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")


def _union_of(ranges: Column) -> Column:
    """Ranges of several blocks as disjoint, non-adjacent ones in order."""
    kind = "array<struct<start:long,end:long,char_start:long,char_end:long>>"

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["char_start"].alias("char_start"), F.greatest(last["char_end"], x["char_end"]).alias("char_end"))
        return F.when(F.coalesce(x["start"] <= last["end"], F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, max_words: int = 1_000_000, max_bytes: int = 64 << 20) -> tuple[DataFrame, str]:
    """docs with one struct column (see SCAN) and that column's name.

    The benchmark's words and bytes are counted first. Up to max_words and
    max_bytes its windows go out as one broadcast; beyond that the items are cut
    into blocks within those bounds. The documents are then written once with a
    number for each row, every block of items writes the rows with hits only,
    without their texts, and these are joined with the documents at the end.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(WORD_SQL))).alias("w"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil((total.w or 0) / max_words), math.ceil((total.b or 0) / max_bytes))
    name = free_name(docs, "scan")

    def windows_of(part: DataFrame):
        return spark.sparkContext.broadcast(WindowSet([(r.item, r.text.encode()) for r in part.toLocalIterator()], n))

    if blocks == 1:
        run = _scanner(windows_of(items), docs.columns.index(text), [*docs.columns, name])
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SCAN)])), name
    row, words = free_name(docs, "row"), free_name(docs, "words")
    numbered = _numbered(docs, text, row, words)
    found = None
    for k in range(blocks):
        known = windows_of(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k))
        narrow = numbered.select(row, text).mapInArrow(_scanner(known, 1, ["row", "scan"], hits_only=True), T.StructType([T.StructField("row", T.LongType()), T.StructField("scan", SCAN)]))
        narrow = materialise(narrow, "decontaminate-hits")
        found = narrow if found is None else found.union(narrow)
        known.unpersist()
    hits = found.groupBy("row").agg(_union_of(F.flatten(F.collect_list("scan.hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("scan.items")))).alias("items"))
    hits = with_size(materialise(hits, "decontaminate-marks"))
    none = [F.array().cast(SCAN[k].dataType) for k in ("hits", "items")]
    both = numbered.join(hits, numbered[row] == hits["row"], "left")
    marked = F.struct(numbered[words].alias("n_words"), F.coalesce(hits["hits"], none[0]).alias("hits"), F.coalesce(hits["items"], none[1]).alias("items")).alias(name)
    return both.select(*[numbered[c] for c in docs.columns], marked), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs without contamination, with the columns of docs.

    remove="documents" drops every document with a hit; remove="spans" cuts the
    hit passages (first to last character of each run of hit words) out of the text.
    """
    marked, name = scan(docs, benchmark, text=text, **options)
    if remove == "documents":
        return marked.where(F.size(f"{name}.hits") == 0).select(docs.columns)
    hits = F.col(f"{name}.hits")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits, lambda h: h["char_end"]))
    begins = F.concat(F.transform(hits, lambda h: h["char_start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.zip_with(ends, begins, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.size(hits) > 0, F.concat_ws("", pieces)).otherwise(F.col(text))
    return marked.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])
