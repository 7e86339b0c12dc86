"""Near-duplicate embeddings by cross-polytope hashing.

A table rotates a vector pseudo-randomly, three rounds of random signs and a fast
Hadamard transform, once per hash function, and each function names the closest
vertex of the cross-polytope (the largest coordinate and its sign). The number of
functions per table grows with the logarithm of the number of vectors, the last
one using a polytope of fewer dimensions, so that a bucket has some dozens of
unrelated vectors at any number of them. A vector is
filed in its own bucket of each table and looked up there and in the `probes`
buckets that are next in likelihood (multiprobe). The number of tables follows
from the wanted recall and from the chance, simulated for pairs exactly at the
threshold, that two vectors meet in a table.

Equal vectors are one class, carried once with their number. Within a bucket
cosines are computed in double precision from the vectors themselves, so every
link is verified where it is found. Each pair is counted in the first bucket
where it meets only, which both vectors' codes tell, so no list of pairs is ever
kept: a bucket returns sums of links per class, and for the components one edge
per linked class. Buckets of more than `block` members, at any number of vectors,
are cut into blocks and every pair of blocks is a task of its own; which buckets
those are is a table that the members are joined with. Classes are told apart by
128 bits of their vectors. A cosine for which the wanted recall would take too many
tables is an error.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and those with a null id, link with nothing; vectors of different
length do not link with each other; rows that repeat an id count as vectors of
their own; a cosine exactly at the threshold, as computed, is a link. Vectors of any
length are compared whole. An empty table gives no rows. Ids are integers. Columns
besides id and vector are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, with_size
from .components import components

_ALTERNATIVES = 3
_MOST_TABLES = 256
_TILE = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


class Forest:
    """Codes of vectors of one dimension in all tables."""

    def __init__(self, dim: int, polytopes: tuple[int, ...], tables: int, probes: int):
        """polytopes: dimensions, powers of two up to that of the padded vectors, of each function."""
        self.dim, self.polytopes, self.tables, self.probes = dim, polytopes, tables, probes
        self.padded = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng([11, dim])
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (tables, max(1, len(polytopes)), 3, self.padded))

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(n, 1 + probes) buckets in a table: the own one, then those to probe, the likeliest first."""
        n = len(vectors)
        x0 = np.zeros((n, self.padded), np.float32)
        x0[:, : self.dim] = vectors
        rows = np.arange(n)[:, None]
        vertex, loss = [], []
        for f, d in enumerate(self.polytopes):
            x = x0
            for r in range(3):
                x = hadamard(x * self.signs[table, f, r] * np.float32(1 / math.sqrt(self.padded)))
            x = x[:, :d]
            size = np.abs(x)
            many = min(1 + _ALTERNATIVES, d)
            top = np.argpartition(-size, many - 1, axis=1)[:, :many] if many < d else np.tile(np.arange(many), (n, 1))
            top = np.take_along_axis(top, np.argsort(-size[rows, top], axis=1, kind="stable"), 1)
            vertex.append(2 * top + (x[rows, top] < 0))
            loss.append((size[rows, top[:, :1]] - size[rows, top]) ** 2)
        place = [math.prod(2 * d for d in self.polytopes[:f]) for f in range(len(self.polytopes))]
        own = sum(v[:, 0].astype(np.int64) * b for b, v in zip(place, vertex))
        moved = np.concatenate([own[:, None] + (v[:, 1:] - v[:, :1]).astype(np.int64) * b for b, v in zip(place, vertex)], 1)
        cost = np.concatenate([x[:, 1:] for x in loss], 1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return np.concatenate([own[:, None], moved[rows, order]], 1)


def meeting_chance(dim: int, polytopes: tuple[int, ...], probes: int, cosine: float, pairs: int = 4000) -> float:
    """Simulated chance that two vectors at this cosine meet in a table, one in a bucket that the other has or probes."""
    if dim == 1:
        return 1.0  # only the sign counts
    rng = np.random.default_rng(5)
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b
    f = Forest(dim, polytopes, 2, probes)
    met = []
    for t in range(2):
        x, y = f.codes(a.astype(np.float32), t), f.codes(b.astype(np.float32), t)
        met.append(((x == y[:, :1]) | (y == x[:, :1])).any(1))
    return float(np.mean(met))


def layout(n: int, dim: int, cosine: float, recall: float, probes: int, bucket: int = 64) -> tuple[tuple[int, ...], int]:
    """Dimensions of the functions' polytopes, and the number of tables."""
    whole = max(1, (dim - 1).bit_length())  # a whole polytope tells 2**(whole + 1) vertices apart
    bits = min(40, max(2, round(math.log2(max(1.0, n * (1 + probes) / bucket)))))
    full, rest = divmod(bits, whole + 1)
    polytopes = (1 << whole,) * full + ((1 << (rest - 1),) if rest >= 2 or not full else ())
    p = min(max(meeting_chance(dim, polytopes, probes, cosine), 1e-3), 1 - 1e-9)
    tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))
    if tables > _MOST_TABLES:
        raise ValueError(f"a recall of {recall} at cosine {cosine} takes {tables} tables for {n} vectors; a higher cosine, more probes or a lower recall takes fewer")
    return polytopes, tables


def _classer(number: str):
    """(doc, vector) -> doc, h1, h2, dim, vec: 128 bits of the vector, dimension and packed components; nulls for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data = [], [], []
            for doc, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values
                x = np.empty(0, number) if v is None or v.null_count or doc is None else v.to_numpy(zero_copy_only=False).astype(number)
                ok = bool(np.isfinite(x).all() and x.any())
                if ok and number == "<f8" and not 1e-140 < np.abs(x).max() < 1e140:
                    x = x / np.abs(x).max()  # the scale does not matter, only over- and underflow does
                raw = x.tobytes() if ok else None
                ids.append(struct.unpack("<qq", xxhash.xxh3_128_digest(raw)) if ok else (None, None))
                dims.append(len(x) if ok else None)
                data.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["doc", "h1", "h2", "dim", "vec"])

    return run


def _member(dim: int, number: str) -> np.dtype:
    return np.dtype([("id", "<i8"), ("n", "<i8"), ("home", "?"), ("block", "<i4"), ("vec", number, (dim,))])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _filer(forest: Forest, number: str):
    """Rows (place, bucket, data) of classes (id, n, vec): members by table and bucket, packed by batch."""
    kind = _member(forest.dim, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.zeros(batch.num_rows, kind)
            own["id"], own["n"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own["vec"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), number).reshape(-1, forest.dim)
            unit = _unit(own["vec"])
            for table in range(forest.tables):
                codes = forest.codes(unit, table)
                who = np.repeat(np.arange(len(own)), codes.shape[1])
                home = np.tile(np.arange(codes.shape[1]) == 0, len(own))
                flat = codes.ravel()
                order = np.argsort(flat, kind="stable")
                ends = np.flatnonzero(np.append(np.diff(flat[order]) != 0, True)) + 1
                buckets, data = [], []
                for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                    rows = own[who[order[a:b]]]
                    rows["home"] = home[order[a:b]]
                    buckets.append(int(flat[order[a]])), data.append(rows.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), table, np.int32)), pa.array(buckets, pa.int64()), pa.array(data, pa.binary())], ["place", "bucket", "data"])

    return run


def _splitter(forest: Forest, number: str):
    """Over (place, bucket, data, blocks): rows (place, bucket, pair, data); a bucket of several blocks goes out once for each pair of them."""
    kind = _member(forest.dim, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for place, bucket, raw, n in zip(*(c.to_pylist() for c in batch.columns)):
                some = [(0, raw)]
                if n is not None:
                    rows = np.frombuffer(raw, kind).copy()
                    rows["block"] = rows["id"] % n
                    some = [(min(x, y) * n + max(x, y), own.tobytes()) for x in np.unique(rows["block"]).tolist() for own in [rows[rows["block"] == x]] for y in range(n)]
                for pair, data in some:
                    for o, v in zip(out, (place, bucket, pair, data)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["place", "bucket", "pair", "data"])

    return run


class _Codes:
    """Codes of a bucket's vectors in the tables up to one, taken once they are needed."""

    def __init__(self, vec: np.ndarray, forest: Forest, table: int):
        self.vec, self.forest, self.table = vec, forest, table
        self.known = np.zeros(len(vec), bool)
        self.codes = [np.empty((0, 0), np.int64)] * (table + 1)

    def need(self, rows: np.ndarray) -> None:
        rows = rows[~self.known[rows]]
        if not len(rows):
            return
        unit = _unit(self.vec[rows])
        for t in range(self.table + 1):
            got = self.forest.codes(unit, t)
            if not len(self.codes[t]):
                self.codes[t] = np.empty((len(self.vec), got.shape[1]), np.int64)
            self.codes[t][rows] = got
        self.known[rows] = True


def bucket_links(rows: np.ndarray, forest: Forest, table: int, bucket: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's members: ids with a link first met here, each one's number of linked vectors, and for each the smallest id it is joined with.

    Pairs are looked at in tiles of at most a million, or of one member, and none is kept.
    """
    rows = rows[np.argsort(rows["id"], kind="stable")]
    across = (rows["block"] != rows["block"][0]).any()
    vec = rows["vec"].astype(np.float64)
    norm = np.linalg.norm(vec, axis=1)
    home, block = rows["home"], rows["block"]
    codes = _Codes(vec, forest, table)
    n, least = np.zeros(len(rows)), np.arange(len(rows))
    step = max(1, _TILE // len(rows))
    for i in range(0, len(rows), step):
        close = (vec[i : i + step] @ vec.T) / (norm[i : i + step, None] * norm[None, :]) >= cosine
        close &= home[i : i + step, None] | home[None, :]
        if across:
            close &= block[i : i + step, None] != block[None, :]
        x, y = np.nonzero(close)
        x += i
        x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        # Was there an earlier bucket where one of the two is at home and the other has or probes it?
        codes.need(np.unique(np.concatenate([x, y])))
        earlier = np.zeros(len(x), bool)
        for t, c in enumerate(codes.codes):
            for one, other in ((x, y), (y, x)):
                own = c[other, :1]
                met = c[one] == own
                if t == table:
                    met &= own < bucket
                earlier |= met.any(1)
        x, y = x[~earlier], y[~earlier]
        n += np.bincount(x, rows["n"][y], len(rows)) + np.bincount(y, rows["n"][x], len(rows))
        while len(x):  # joins the smallest places that the two ends have reached
            while (least[least] != least).any():
                least = least[least]
            p, q = least[x], least[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
    while (least[least] != least).any():
        least = least[least]
    at = np.flatnonzero(n)
    return rows["id"][at], n[at].astype(np.int64), rows["id"][least[at]]


def _linker(forest: Forest, number: str, cosine: float):
    """Over rows sorted by table, bucket and pair: rows (id, n, other)."""
    kind = _member(forest.dim, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out = None, [], []

        def emit() -> None:
            got = bucket_links(np.frombuffer(b"".join(parts), kind), forest, now[0], now[1], cosine)
            if len(got[0]):
                out.append(got)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["id", "n", "other"])

        for batch in batches:
            for table, bucket, pair, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (table, bucket, pair) != now:
                    if parts:
                        emit()
                    now, parts = (table, bucket, pair), []
                parts.append(data)
            yield flush()
        if parts:
            emit()
        yield flush()

    return run


def _dense(classes: DataFrame, forest: Forest, number: str, block: int) -> DataFrame | None:
    """Buckets of more than `block` members (place, bucket, blocks); None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), number).reshape(-1, forest.dim))
            for t in range(forest.tables):
                names, n = np.unique(forest.codes(unit, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), t, np.int32)), pa.array(names), pa.array(n)], ["place", "bucket", "n"])

    counts = classes.select("vec").mapInArrow(count, "place int, bucket long, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n"))
    found = materialise(counts.where(F.col("n") > block).select("place", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "vector-dense")
    return found if found.head(1) else None


def link_vectors(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.9999, probes: int = 2, block: int = 4096) -> DataFrame:
    """One row per row of table: its id, n_links, component_id, kept."""
    kind = table.schema[vec_id].dataType
    own = table.select(F.col(vec_id).cast("long").alias("doc"), F.col(vector).alias("vector"))
    single = isinstance(table.schema[vector].dataType.elementType, T.FloatType)
    number = "<f4" if single else "<f8"  # as packed; cosines are taken in double precision from either
    if not single:
        own = own.withColumn("vector", F.col("vector").cast("array<double>"))
    signed = materialise(own.mapInArrow(_classer(number), "doc long, h1 long, h2 long, dim int, vec binary"), "vectors")
    classes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # one pass per length of vectors
        polytopes, tables = layout(r.n, r.dim, cosine, recall, probes)
        forest = Forest(r.dim, polytopes, tables, probes)
        some = classes.where(F.col("dim") == r.dim)
        dense = _dense(some, forest, number, block)
        filed = some.select("id", "n", "vec").mapInArrow(_filer(forest, number), "place int, bucket long, data binary")
        if dense is None:
            filed = filed.select("place", "bucket", F.lit(0).cast("long").alias("pair"), "data")
        else:
            filed = filed.join(with_size(dense), ["place", "bucket"], "left").select("place", "bucket", "data", "blocks").mapInArrow(_splitter(forest, number), "place int, bucket long, pair long, data binary")
        filed = filed.repartition(F.xxhash64("place", "bucket", "pair")).sortWithinPartitions("place", "bucket", "pair")
        links = filed.mapInArrow(_linker(forest, number, cosine), "id long, n long, other long")
        found = links if found is None else found.union(links)
    empty = table.sparkSession.createDataFrame([], "id long, n long, other long")
    found = materialise(found if found is not None else empty, "vector-links")
    of = materialise(components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))), "vector-components")
    grouped = classes.select("id", "h1", "h2", "n", "doc").join(of, "id", "left").select("id", "h1", "h2", "n", "doc", F.coalesce("component", "id").alias("group"))
    heads = materialise(grouped.groupBy("group").agg(F.min("doc").alias("component")), "vector-groups")
    linked = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    known = grouped.join(heads, "group").join(linked, "id", "left").select("h1", "h2", "component", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = signed.select("doc", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").cast(kind).alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
