"""Near-duplicate documents by SimHash in an LSH forest.

Words are runs of ASCII letters and digits (lower-cased) and of any character
beyond ASCII; a document's set has its five-word shingles (one shingle of all its
words if it has fewer). Documents with the same set form a class, represented by
its smallest id, so copies cost one row from there on. A class has a 256-bit
SimHash of its set. Each tree of the forest permutes the bits at random and files
classes under prefixes of the permuted bits.

Depth follows density. The base depth grows with the logarithm of the number of
classes, so that a bucket of unrelated classes stays small, and the number of
trees follows from the target recall for a pair at the similarity threshold,
averaged over the Hamming distances that such a pair can have.

Sets of up to 14 shingles agree in fewer bits at the same similarity, so pairs of
those are found without a sketch: a class is filed under every subset that it may
share with a partner, and under each subset all classes are linked with the
smallest as far as sizes allow. Two sets of the required similarity have their
intersection in common, and the smallest set there is near to both, so the
components are exact.

Where a bucket has more than `block` members, whatever the size of the table, its
members (and no others) descend by eight more bits at a time until their buckets
are small, and are compared there first; the links verified there label them, and
on climbing back, level by level to the base depth, a dense bucket of one label is
left out and members of one label are not compared again. Dense buckets that still
hold several labels are split into blocks, and all pairs of blocks are compared by
separate tasks; which buckets are split is a table that the members are joined
with. From a bucket each class is paired with the `near` first
earlier ones within the Hamming bound; if any pair was left out so, a last round
emits every remaining pair of different labels among the classes of such pairs,
so that none is lost. A few trees are worked through at a time, and their
exchange is let go before the next ones come.

Pairs are verified by the Jaccard similarity of the full sets, a class with very
many pairs in several places, and verified pairs are joined into components. Before
the sets travel, odd sketches of two to four bits a shingle do: they show no more
differences of two sets than there are, so a pair with too many of them is dropped
and no link is lost. Classes are told apart by 128 bits of their sets; shingles are
64-bit hashes.

Defined cases: a null id or a text without words (null and empty included) is
linked with nothing; a row with a null id has a null component and is kept. Rows
that repeat an id are documents of their own: with the same text they share a
component, and each of them is kept if it is that component's smallest id. Ties in
similarity do not matter, as every link counts. Texts of any length are read
whole. An empty table gives no rows. Ids are integers. near_duplicates() looks at
no other columns, whatever their names; keep_one() passes them on.
"""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, release, with_size
from .components import components

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHINGLE, BITS = 5, 256
_SHORT = 14  # sets of at most so many shingles are compared by their subsets
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03], np.uint64)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
_LEAST_SLOTS, _MOST_SLOTS = 23, 28  # bits of their number
_STEP, _DEEPEST = 8, 48  # bits by which a dense bucket descends, and down to which depth
_HUB = 1000  # pairs of a class that one task verifies
_AT_ONCE, _FEW = 8, 2_000_000  # trees whose exchange is on disk at a time, or as many as file so many members


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in (WORD.findall(t.lower()) for t in texts)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    words = hashes[np.concatenate(ids)] if ids else hashes
    long = _shingles(words, SHINGLE)  # of all texts at once; those that run into the next text are not looked at
    out, at = [], 0
    for own in ids:
        n = len(own)
        some = long[at : at + n - SHINGLE + 1] if n >= SHINGLE else _shingles(words[at : at + n], n) if n else words[:0]
        out.append(np.unique(some))
        at += n
    return out


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    s = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        s = mix(s + words[j : j + len(s)])
    return s


def simhash(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as bytes: bit k is set if it is set in most of the hashes' k-th bits."""
    ones = np.zeros((BITS // 8, 8))
    place = np.arange(BITS // 8) * 256
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        data = mix(part[:, None] ^ _SEEDS).view(np.uint8)
        counts = np.bincount((data + place).ravel(), minlength=BITS // 8 * 256).reshape(-1, 256)
        ones += counts.astype(np.float32) @ _BYTE_BITS  # exact: sums of at most 2**16
    return np.packbits((2 * ones > len(hashes)).ravel())


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two numbers; classes are told apart by them."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Bit k is set if an odd number of hashes are k modulo the number of bits, a power of two: 64, or twice the hashes or more."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differences(x: bytes, y: bytes) -> int:
    """Hashes that only one of two sets has, by their sketches: as many as there are, or fewer."""
    x, y = sorted((x, y), key=len)
    wide = int.from_bytes(y)
    for size in range(len(y).bit_length() - 1, len(x).bit_length() - 1, -1):  # a sketch of half the bits is the exclusive or of the halves
        half = 1 << size + 2
        wide = (wide >> half) ^ (wide & ((1 << half) - 1))
    return (wide ^ int.from_bytes(x)).bit_count()


def agreement(similarity: float) -> float:
    """Least chance that two sets of this Jaccard similarity agree in a bit."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _agreement_of(common: int, x: int, y: int) -> float:
    """Chance that a bit agrees for sets of common + x and common + y hashes that share `common`; a tie of the hashes' bits gives 0."""

    def at_least(n: int) -> list[float]:  # chance of k or more ones among n, for k up to n + 1
        return [sum(math.comb(n, i) for i in range(max(k, 0), n + 1)) / 2**n for k in range(n + 2)]

    tails = at_least(x), at_least(y)
    total = 0.0
    for k in range(common + 1):
        p, q = (t[min(max((common + n) // 2 + 1 - k, 0), n + 1)] for t, n in zip(tails, (x, y)))
        total += math.comb(common, k) / 2**common * (p * q + (1 - p) * (1 - q))
    return total


@lru_cache
def least_agreement(similarity: float) -> float:
    """Least chance of agreement in a bit for pairs of this similarity of which the larger set is not short."""
    least = agreement(similarity)
    for either in range(_SHORT + 1, 4 * _SHORT):  # beyond, the chance approaches the limit from nearer than here
        common = math.ceil(similarity * either - 1e-9)
        for x in range((either - common) // 2 + 1):
            if either - x > _SHORT:
                least = min(least, _agreement_of(common, x, either - common - x))
    return least


def forest_recall(depth: int, trees: int, bound: int, p: float) -> float:
    """Chance that a pair that agrees in a bit with chance p is within the bound and shares the prefix of a tree, a random choice of bits without repetition."""
    total = 0.0
    for off in range(bound + 1):
        alike = math.prod((BITS - off - i) / (BITS - i) for i in range(depth))
        total += math.comb(BITS, off) * (1 - p) ** off * p ** (BITS - off) * (1 - (1 - alike) ** trees)
    return total


@lru_cache
def forest_shape(n: int, similarity: float, recall: float, bucket: int = 256) -> tuple[int, int, int]:
    """Base depth, number of trees, Hamming bound."""
    p = least_agreement(similarity)
    depth = min(32, max(6, round(math.log2(max(n, 1) / bucket)) if n > bucket else 6))
    within, bound = p**BITS, 0
    while 1 - within > (1 - recall) / 100:
        bound += 1
        within += math.comb(BITS, bound) * (1 - p) ** bound * p ** (BITS - bound)
    few, trees = 0, 1
    while forest_recall(depth, trees, bound, p) < recall:
        few, trees = trees, 2 * trees
    while trees - few > 1:
        middle = (few + trees) // 2
        few, trees = (few, middle) if forest_recall(depth, middle, bound, p) >= recall else (middle, trees)
    return depth, trees, bound


def permuted_prefixes(sims: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """First bits of each SimHash as this tree permutes them, as an integer below 2**depth."""
    order = np.random.default_rng([7, tree]).permutation(BITS)[:depth]
    bits = (sims[:, order >> 3] >> (7 - (order & 7)).astype(np.uint8)) & 1
    return bits.astype(np.int64) @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        keys, sims, few, sizes, odd = [], [], [], [], []
        for a, b in chunks(pc.binary_length(texts).fill_null(0).to_pylist(), 4 << 20):
            for hashes in shingle_sets([t or b"" for t in texts[a:b].to_pylist()]):
                keys.append(class_key(hashes) if len(hashes) else (None, None))
                sims.append(simhash(hashes).tobytes() if len(hashes) else None)
                few.append(hashes.tobytes() if 0 < len(hashes) <= _SHORT else None)
                sizes.append(len(hashes))
                odd.append(odd_sketch(hashes) if len(hashes) else None)
        columns = *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(sims, pa.binary()), pa.array(few, pa.binary()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "h1", "h2", "sim", "few", "size", "odd"])


def subset_keys(sets: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of the subsets that sets of one size (rows) may share with a set of this similarity, and the size of the subsets."""
    own = mix(sets ^ _SEEDS[0])
    size = own.shape[1]
    total = own.sum(1, dtype=np.uint64)[:, None]
    for out in range(size - math.ceil(similarity * size - 1e-9) + 1):
        which = np.array(list(combinations(range(size), out)), np.int64).reshape(math.comb(size, out), out)
        with np.errstate(over="ignore"):
            yield mix(total - own[:, which].sum(2, dtype=np.uint64) + mix(np.array([size - out], np.uint64))), size - out


def _short_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all short sets of this similarity. classes: id, few (the hashes of a short set)."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in sets], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for part in np.array_split(rows, len(rows) // 4096 + 1):
                    same = np.frombuffer(b"".join(sets[i] for i in part), np.uint64).reshape(-1, size)
                    for keys, common in subset_keys(same, similarity):
                        n = keys.size
                        columns = keys.ravel().view(np.int64), np.full(n, common, np.int32), np.full(n, size, np.int32), np.repeat(ids[part], keys.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "common", "size", "id"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by key, size and id: each is linked with the first of its key."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, common, size, own = (c.to_numpy() for c in batch.columns)
            starts = np.append(True, np.diff(key) != 0)
            first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            head, least = own[first], size[first]
            if last and last[0] == key[0]:
                head, least = np.where(first == 0, last[1], head), np.where(first == 0, last[2], least)
            last = key[-1], head[-1], least[-1]
            ok = (own != head) & (common >= similarity * (size + least - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(head[ok]), pa.array(own[ok])], ["a", "b"])

    filed = classes.where("few is not null").select("id", "few").mapInArrow(file, "key long, common int, size int, id long")
    return filed.repartition("key").sortWithinPartitions("key", "size", "id").mapInArrow(link, "a long, b long").distinct()


_MEMBER = np.dtype([("id", "<i8"), ("label", "<i8"), ("block", "<i4"), ("sim", "V32")])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order that sorts keys, and where each run of equal ones starts in it, with the end."""
    order = np.argsort(keys, kind="stable")
    return order, [*np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)).tolist(), len(keys)]


def _filer(depth: int, trees: range):
    """Files (id, label, sim) under tree and prefix: rows (bucket, data), data packing the members of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.zeros(batch.num_rows, _MEMBER)
            own["id"], own["label"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = b"".join(batch.column(2).to_pylist())
            own["sim"] = np.frombuffer(raw, "V32")
            sims = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
            buckets, data = [], []
            for tree in trees:
                bucket = permuted_prefixes(sims, tree, depth) + (tree << depth)
                order, starts = _groups(bucket)
                for a, b in zip(starts, starts[1:]):
                    buckets.append(int(bucket[order[a]])), data.append(own[order[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (bucket, data, blocks): rows (bucket, pair, data). A bucket of several blocks goes out once for each pair of them, one of none not at all."""
    for batch in batches:
        buckets, pairs, data = [], [], []
        for bucket, raw, n in zip(*(c.to_pylist() for c in batch.columns)):
            if n is None:
                buckets.append(bucket), pairs.append(0), data.append(raw)
                continue
            rows = np.frombuffer(raw, _MEMBER).copy()
            if n:
                rows["block"] = (mix(rows["id"].astype(np.uint64)) % np.uint64(n)).astype(np.int32)
            order, starts = _groups(rows["block"])
            for a, b in zip(starts, starts[1:]) if n else ():
                x, some = int(rows["block"][order[a]]), rows[order[a:b]].tobytes()
                for y in range(n):
                    buckets.append(bucket), pairs.append(min(x, y) * n + max(x, y)), data.append(some)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(pairs, pa.int64()), pa.array(data, pa.binary())], ["bucket", "pair", "data"])


def close_pairs(rows: np.ndarray, bound: int, near: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of pairs of different labels within the Hamming bound, each id with the `near` smallest such ids below it; and the ids of pairs left out so."""
    rows = rows[np.argsort(rows["id"], kind="stable")]
    if len(rows) < 2 or (rows["label"] == rows["label"][0]).all():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    sims, label, block = rows["sim"].copy().view(np.uint64).reshape(len(rows), -1), rows["label"], rows["block"]
    across = (block != block[0]).any()
    step = max(1, (1 << 20) // len(rows))
    a, b, left = [], [], [np.empty(0, np.int64)]
    for i in range(1, len(rows), step):
        j = min(len(rows), i + step)
        off = np.bitwise_count(sims[i:j, None, 0] ^ sims[None, : j - 1, 0]).astype(np.int16)
        for w in range(1, sims.shape[1]):
            off += np.bitwise_count(sims[i:j, None, w] ^ sims[None, : j - 1, w])
        y, x = np.nonzero(off <= bound)
        y += i
        ok = (x < y) & (label[x] != label[y])
        if across:
            ok &= block[x] != block[y]
        y, x = y[ok], x[ok]
        if near is not None and len(y):
            first = np.searchsorted(y, y)
            ok = np.arange(len(y)) - first < near
            left.append(np.unique(rows["id"][np.concatenate([x[~ok], y[~ok]])]))
            y, x = y[ok], x[ok]
        a.append(rows["id"][x])
        b.append(rows["id"][y])
    return np.concatenate(a), np.concatenate(b), np.unique(np.concatenate(left))


def _matcher(bound: int, near: int | None):
    """Over rows sorted by bucket and pair: candidate pairs (a, b); a row with a null b names a class of a pair that was left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[bytes]) -> None:
            a, b, left = close_pairs(np.frombuffer(b"".join(parts), _MEMBER), bound, near)
            found_a.append(pa.array(np.concatenate([a, left]))), found_b.append(pa.concat_arrays([pa.array(b), pa.nulls(len(left), pa.int64())]))

        now, parts, found_a, found_b = None, [], [], []
        for batch in batches:
            for bucket, pair, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, pair) != now:
                    if parts:
                        emit(parts)
                    now, parts = (bucket, pair), []
                parts.append(data)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(found_a), pa.concat_arrays(found_b)], ["a", "b"])
                found_a, found_b = [], []
        if parts:
            emit(parts)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(found_a), pa.concat_arrays(found_b)], ["a", "b"])

    return run


def _candidates(members: DataFrame, depth: int, trees: int, bound: int, near: int | None, dense: DataFrame | None, parents: DataFrame | None, step: int) -> DataFrame:
    """Candidate pairs of members (id, label, sim) under one depth. dense: buckets to be split (bucket, blocks); parents: buckets `step` bits up, whose members alone take part."""
    parents = None if parents is None else with_size(parents.select(F.col("bucket").alias("parent")))
    dense = None if dense is None else with_size(dense)

    def of(some: range) -> DataFrame:
        filed = members.select("id", "label", "sim").mapInArrow(_filer(depth, some), "bucket long, data binary")
        if parents is not None:
            filed = filed.join(parents, F.shiftright("bucket", step) == F.col("parent"), "left_semi")
        if dense is None:
            placed = filed.select("bucket", F.lit(0).cast("long").alias("pair"), "data")
        else:
            placed = filed.join(dense, "bucket", "left").select("bucket", "data", "blocks").mapInArrow(_split, "bucket long, pair long, data binary")
        sorted_ = placed.repartition(F.xxhash64("bucket", "pair")).sortWithinPartitions("bucket", "pair")
        return materialise(sorted_.mapInArrow(_matcher(bound, near), "a long, b long").distinct(), "simhash-pairs")

    found, some = [], max(_AT_ONCE, _FEW // max(1, members.count()))
    for first in range(0, trees, some):
        found.append(of(range(first, min(trees, first + some))))
        release(members.sparkSession)
    if len(found) == 1:
        return found[0]
    every = materialise(reduce(DataFrame.union, found).distinct(), "simhash-pairs")
    for f in found:
        discard(f)
    return every


def _dense(members: DataFrame, depth: int, trees: int, block: int, parents: DataFrame | None, step: int) -> DataFrame | None:
    """Buckets of more than `block` members (bucket, blocks), blocks being 0 if all members have one label; None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims, label = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8), batch.column(1).to_numpy()
            out = []
            for t in range(trees):
                bucket = permuted_prefixes(sims, t, depth) + (t << depth)
                order, starts = _groups(bucket)
                own, at = label[order], np.array(starts[:-1])
                out.append((bucket[order][at], np.diff(starts), np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["bucket", "n", "low", "high"])

    counts = members.select("sim", "label").mapInArrow(count, "bucket long, n long, low long, high long")
    if parents is not None:
        counts = counts.join(with_size(parents.select(F.col("bucket").alias("parent"))), F.shiftright("bucket", step) == F.col("parent"), "left_semi")
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") > block)
    found = materialise(counts.select("bucket", F.when(F.col("low") == F.col("high"), 0).otherwise(F.ceil(F.col("n") / block)).cast("int").alias("blocks")), "simhash-dense")
    return found if found.head(1) else None


def _slot(doc: str, slots: int) -> list[Column]:
    slot = F.pmod(F.xxhash64(doc), F.lit(slots))
    return [F.bitmap_bucket_number(slot).alias("slot_bucket_"), F.bitmap_bit_position(slot).alias("slot_bit_")]


def _marks(ids: DataFrame, n: int) -> tuple[Broadcast, int]:
    """A bit per hash slot of the n ids in the only column of a frame, and the number of slots: 16 an id and more, from 1 MB up to 32 MB."""
    slots = 1 << min(_MOST_SLOTS, max(_LEAST_SLOTS, (16 * n).bit_length()))
    bucket, bit = _slot(ids.columns[0], slots)
    marks = ids.select(bucket, bit).groupBy("slot_bucket_").agg(F.bitmap_construct_agg("slot_bit_").alias("bits"))
    bits = np.zeros((slots // 32768 + 2, 4096), np.uint8)
    for r in marks.toLocalIterator():
        bits[r.slot_bucket_] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits), slots


def _marked(bits: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Of rows that end with their slot's two columns, those whose bit is set; no bit is set for a null."""
    bucket, bit = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
    return ((bits[bucket, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _number(clashes: list[int]) -> Column:
    """One number for the 128 bits h1, h2 of a class: h1, but for those of `clashes`, the few h1 that several classes have."""
    return F.when(F.col("h1").isin(clashes), F.xxhash64("h1", "h2")).otherwise(F.col("h1")) if clashes else F.col("h1")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, number: Column) -> DataFrame:
    """(id, set) of the n wanted classes. docs: doc, text; wanted: id and doc, the smallest document of a class.

    Marks of the wanted documents let the scan skip most other texts; the join on
    id that follows is exact.
    """
    shared, slots = _marks(wanted.select("doc"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).filter(pa.array(_marked(shared.value, batch))).cast(pa.binary())
            for a, b in chunks(pc.binary_length(texts).to_pylist(), 4 << 20):
                sets = [s for s in shingle_sets(texts[a:b].to_pylist()) if len(s)]
                keys = [class_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["h1", "h2", "set"])

    found = docs.select("text", *_slot("doc", slots)).mapInArrow(run, "h1 long, h2 long, set array<long>")
    return found.select(number.alias("id"), "set").join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _sketches_of(signed: DataFrame, wanted: DataFrame, n: int, number: Column) -> DataFrame:
    """(id, set) of the n wanted classes, as _sets_of has them, but set is a sketch: a struct of size and odd."""
    shared, slots = _marks(wanted.select("doc"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(_marked(shared.value, batch)))
            yield pa.RecordBatch.from_arrays(part.columns[:-2], part.schema.names[:-2])

    found = signed.where("doc is not null and h1 is not null").select("h1", "h2", "size", "odd", *_slot("doc", slots)).mapInArrow(run, "h1 long, h2 long, size int, odd binary")
    return found.select(number.alias("id"), F.struct("size", "odd").alias("set")).join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _without(docs: DataFrame, doc_id: str, drop: DataFrame) -> DataFrame:
    """docs without the ids of drop. Rows whose slot is not marked stay where they are; only the others are joined."""
    shared, slots = _marks(drop, drop.count())

    def taking(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part = batch.filter(pa.array(_marked(shared.value, batch) == wanted))
                    yield pa.RecordBatch.from_arrays(part.columns[:-2], part.schema.names[:-2])

        return docs.select("*", *_slot(doc_id, slots)).mapInArrow(run, docs.schema)

    maybe = taking(True)
    return taking(False).unionByName(maybe.join(drop, maybe[doc_id] == drop[drop.columns[0]], "left_anti"))


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, hubs: DataFrame | None) -> DataFrame:
    """pairs with set_a or set_b. hubs (id, places): classes whose set is put in several places, so that no task gets all of their pairs."""
    sets = sets.toDF(end, f"set_{end}")
    if hubs is None:
        return pairs.join(sets, end)
    hubs = with_size(hubs.withColumnRenamed("id", end))
    other = "b" if end == "a" else "a"
    many = pairs.join(hubs, end, "left").withColumn("place", F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
    spread = sets.join(hubs, end, "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1))).drop("places")
    return many.join(spread, [end, "place"]).drop("place")


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float, hubs: DataFrame | None) -> DataFrame:
    """Pairs without those that are less similar than this by their sketches already."""
    most = (1 - similarity) / (1 + similarity)  # of the sizes' sum, that sets of this similarity differ in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(k).to_pylist() for k in (2, 4))
            odd = (batch.column(k).to_pylist() for k in (3, 5))
            ok = [abs(m - n) <= (d := most * (m + n) + 1e-6) and differences(x, y) <= d for m, n, x, y in zip(*sizes, *odd)]
            part = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], part.schema.names[:2])

    both = _with_sets(_with_sets(pairs, sketches, "a", hubs), sketches, "b", hubs)
    return both.select("a", "b", "set_a.size", "set_a.odd", "set_b.size", "set_b.odd").toDF("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, hubs: DataFrame | None) -> DataFrame:
    """Pairs of which the sets have at least this Jaccard similarity."""
    both = _with_sets(_with_sets(pairs, sets, "a", hubs), sets, "b", hubs)
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common
    return both.where(common >= F.lit(similarity) * either - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.99, near: int = 2, block: int = 8192) -> DataFrame:
    """One row per row of docs: its id, component_id (the smallest id of its group), kept (the two are equal)."""
    if similarity < 0.8:
        raise ValueError("the forest is laid out for similarities of 0.8 or more")
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = materialise(own.mapInArrow(_signatures, "doc long, h1 long, h2 long, sim binary, few binary, size int, odd binary"), "simhash-signatures")
    classes = signed.where("doc is not null and h1 is not null").groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.first("sim").alias("sim"), F.first("few").alias("few"))
    classes = materialise(classes, "simhash-classes")
    # Among n classes some n * n / 2**65 share their first 64 bits: a few at 10**10.
    clashes = [r.h1 for r in classes.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").toLocalIterator()]
    number = _number(clashes)
    classes = classes.withColumn("id", number)
    # A set that is too short for any partner beyond the short ones is left out of the forest.
    large = classes.where(F.col("few").isNull() | (F.octet_length("few") >= 8 * math.ceil(similarity * (_SHORT + 1) - 1e-9)))
    depth, trees, bound = forest_shape(large.count(), similarity, recall)
    texts = own.where("doc is not null and text is not null")
    # Links found so far: those of the last round, and each class with its component before that.
    links = materialise(_short_links(classes, similarity), "simhash-links")

    def ends(pairs: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
        """The classes of some pairs (id, doc, pairs), their number, and in how many places those with very many pairs are compared."""
        each = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
        wanted = materialise(classes.join(each, "id").select("id", "doc", "pairs"), "simhash-wanted")
        n, most = wanted.agg(F.count("*"), F.max("pairs")).first()
        return wanted, n, wanted.where(F.col("pairs") > _HUB).select("id", F.ceil(F.col("pairs") / _HUB).cast("int").alias("places")) if (most or 0) > _HUB else None

    def compare(members: DataFrame, depth: int, near: int | None, dense: DataFrame | None, parents: DataFrame | None = None) -> DataFrame:
        """Pair members (id, label, sim) under one depth and keep the verified links. The ids of pairs that were left out."""
        nonlocal links
        found = _candidates(members, depth, trees, bound, near, dense, parents, _STEP)
        pairs = found.where("b is not null")
        wanted, n, hubs = ends(pairs)
        pairs = materialise(_possible(pairs, _sketches_of(signed, wanted, n, number), similarity, hubs), "simhash-possible")
        release(docs.sparkSession)
        wanted, n, hubs = ends(pairs)
        links = materialise(links.union(_verified(pairs, _sets_of(texts, wanted, n, number), similarity, hubs)), "simhash-links")
        release(docs.sparkSession)
        return found.where("b is null").select(F.col("a").alias("id")).distinct()

    def labelled() -> DataFrame:
        nonlocal links
        of = components(links)
        links = of.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return materialise(large.select("id", "sim").join(of, "id", "left").select("id", F.coalesce("component", "id").alias("label"), "sim"), "simhash-labels")

    members = large.select("id", F.col("id").alias("label"), "sim")
    levels = [_dense(members, depth, trees, block, None, _STEP)]
    while levels[-1] is not None and depth + len(levels) * _STEP <= _DEEPEST:  # descend where buckets are dense, and only there
        levels.append(_dense(members, depth + len(levels) * _STEP, trees, block, levels[-1], _STEP))
    for k in range(len(levels) - 1, 0, -1):  # climb back: what is linked further down has one label here
        deeper = depth + k * _STEP
        dense = levels[k] if k == len(levels) - 1 else _dense(members, deeper, trees, block, levels[k - 1], _STEP)
        compare(members, deeper, near, dense, levels[k - 1])
        members = labelled()
    left = compare(members, depth, near, levels[0] if len(levels) == 1 else _dense(members, depth, trees, block, None, _STEP))
    if left.head(1):  # both classes of a pair that was left out are named
        members = materialise(labelled().join(left, "id", "left_semi"), "simhash-left")
        compare(members, depth, None, _dense(members, depth, trees, block, None, _STEP))
    of = materialise(components(links), "simhash-components")
    grouped = classes.select("id", "doc").join(of, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("group"))
    least = grouped.where("id != group").groupBy("group").agg(F.min("doc").alias("least"))
    named = grouped.join(least, "group", "left").select("id", F.least("doc", "least").alias("doc"), "group")
    heads = named.where("id = group").select("group", F.col("doc").alias("component"))
    reps = grouped.select("id", "group").join(heads, "group").select("id", "component")
    out = signed.select("doc", number.alias("id")).join(reps, "id", "left").select("doc", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))
    return out.select(F.col("doc").cast(kind).alias(doc_id), F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of docs without near-duplicates: of each group the document with the smallest id.

    Only ids travel for that, and rows that may have one of the ids to drop. An id that
    repeats is dropped if none of its rows heads a group; otherwise its rows
    with different texts stay, one row for each text. Rows with a null id stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options).where(F.col(doc_id).isNotNull())
    ids = materialise(found.groupBy(doc_id).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "simhash-ids")
    drop = ids.where("not kept").select(F.col(doc_id).alias("drop_"))
    again = ids.where("kept and n > 1").select(F.col(doc_id).alias("again_"))
    rest = _without(docs, doc_id, drop)
    if not again.head(1):
        return rest
    single = rest.join(again, rest[doc_id] == again["again_"], "left_semi").dropDuplicates([doc_id, text])
    return rest.join(again, rest[doc_id] == again["again_"], "left_anti").unionByName(single)
