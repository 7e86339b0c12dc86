"""Deleted-interpolation n-gram model and its scores of whole texts.

P(w | h) = sum over k of a_k(b) c(h_k, w)/c(h_k) + u(b) c(w)/N + z(b)/(V+1), where h_k
are the k-1 words before w (k = 2 up to `order`) and the weights of bucket b sum to
1; b is the bucket of the longest context that was seen, by powers of two of its
frequency, 0 if none was. The weights are learned by expectation maximisation on
held-out counts: one part of the training documents is kept back, its events are
predicted from the counts of the other part, and only then are the counts of all
training documents taken for scoring.

The held-out events reach the driver as a histogram: events of one bucket whose
estimates agree within a 24th of a decade form a cell with its number of events
and their mean estimates. There are at most some 10^5 cells at any number of events,
and expectation maximisation runs on them until the weights stand still. A
cell's spread of 5 % about its mean moves a weight by about 0.001.

Counting is an exchange of packed arrays instead of rows. Documents are tokenised
in batches; a batch has each of its distinct n-grams once, as a 64-bit hash with
counts, sorted, and cut by leading hash bits into parts. Every part is counted by
one task over the packed arrays of all batches, which returns, in the same order,
the totals for each batch; the batch then scores its documents with array lookups.
So a frequent word costs one entry a batch, nothing is broadcast but N, V and the
weights, and the exchange grows with the distinct n-grams of the batches. Batches
and parts grow with the square root of the corpus once it has some 100 GB, so that a
row of the exchange keeps 64 n-grams at least and their number grows with the corpus,
not with its square. Hashes of 64 bits stand for n-grams: among 10^8 distinct ones a clash
has a chance of 3 in 10,000.

Defined cases: a null or empty text is just its end token; a null id is neither
held out nor learned from; with nothing to learn from, N = V = 0 and every
probability is the uniform 1; repeated documents count as often as they occur, and
each row has a score. A text of any length is one document of one batch. An empty
table gives no rows. Columns besides id and text are not looked at, whatever their
names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Roles of documents: counted, kept back to learn the weights, not learned from.
COUNTED, KEPT_BACK, OTHER = 0, 1, 2
BUCKETS = 24
_BATCH_BYTES = 10 << 20
_PART_KEYS = 1_500_000
_ROW_KEYS = 64  # of a row of the exchange, at least, in a large corpus
_TASK_BYTES = 16 << 20
_MOST_TASKS = 20_000
_STEPS, _LOWEST, _QUANTA = 24, 8, 512  # of a histogram: cells a decade, decades below the uniform estimate, cells an axis
_START = np.uint64(0x8F1BBCDCBFA53E0B)
_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BATCH = "batch long, ids binary, roles binary, lengths binary, tokens binary, keys binary"
_FLAT = {"ids": "<i8", "roles": "u1", "lengths": "<i4", "tokens": "<u4", "keys": "<u8"}


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: ASCII letters and ASCII white space only


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M[0]
        x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


def exchange_shape(text_bytes: int, tokens: int) -> tuple[int, int]:
    """Bytes of text of a batch, and tokens of a part."""
    least = math.sqrt(_ROW_KEYS * max(text_bytes // 6, tokens))  # a word takes six bytes or so
    return max(_BATCH_BYTES, math.ceil(6 * least)), max(_PART_KEYS, math.ceil(least))


def tokenise(docs: DataFrame, role: Column, batch_bytes: int = _BATCH_BYTES) -> DataFrame:
    """Packed batches of docs (id, text): ids, roles, lengths with the end token, token numbers, word hashes by number. The id's null is its smallest value."""
    own = docs.select(F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("id"), role.cast("int").alias("role"), "text")

    def pack(number: int, texts: list[bytes], ids: list[int], roles: list[int]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[b" "]  # the end token, which no word can be
        parts, lengths = [], []
        for t in texts:
            ws = tokens_of(t)
            parts.append(np.fromiter(map(numbers.__getitem__, ws), "<u4", len(ws)))
            parts.append(np.zeros(1, "<u4"))
            lengths.append(len(ws) + 1)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), "<u8", len(numbers))
        row = [number, *(np.ascontiguousarray(x, _FLAT[k]).tobytes() for k, x in (("ids", ids), ("roles", roles), ("lengths", lengths), ("tokens", np.concatenate(parts)), ("keys", keys)))]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["batch", *_FLAT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 32, 0
        # Documents kept back have batches of their own, which alone take part in learning the weights.
        waiting: dict[bool, list] = {k: [[], [], [], 0] for k in (True, False)}
        for batch in batches:
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                own, t = waiting[r == KEPT_BACK], t.as_py() or b""
                if own[0] and own[3] + len(t) > batch_bytes:
                    yield pack(task + serial, *own[:3])
                    serial += 1
                    own = waiting[r == KEPT_BACK] = [[], [], [], 0]
                own[0].append(t), own[1].append(i), own[2].append(r)
                own[3] += len(t)
        for own in waiting.values():
            if own[0]:
                yield pack(task + serial, *own[:3])
                serial += 1

    return own.mapInArrow(run, _BATCH)


class Batch:
    """A packed batch with its distinct n-grams, n = 1 to order, in the order of their hashes.

    grams[k - 1]: hashes of the k-grams, and the place among them of the one that ends
    at each token. before[k - 2]: the place, from 1, of each token's context of k - 1
    words, 0 at the start of a document, which is a context of its own.
    """

    def __init__(self, row: dict, order: int = 2):
        flat = {k: np.frombuffer(row[k], t) for k, t in _FLAT.items()}
        self.ids, self.roles, self.lengths, tokens = (flat[k] for k in ("ids", "roles", "lengths", "tokens"))
        self.ends = np.cumsum(self.lengths)
        self.role = np.repeat(self.roles, self.lengths)
        sorted_ = np.argsort(flat["keys"], kind="stable")
        words = flat["keys"][sorted_]
        word = _rank(sorted_)[tokens]
        self.grams, self.before = [(words, word)], []
        for _ in range(order - 1):
            hashes, place = self.grams[-1]
            before = np.empty(len(place), np.int64)
            before[1:] = place[:-1] + 1
            before[np.append(0, self.ends[:-1])] = 0
            distinct, place = np.unique(before * len(words) + word, return_inverse=True)
            context = np.append(_START, hashes)
            h = _hash(_hash(context[distinct // len(words)] + np.uint64(0x9E3779B97F4A7C15)) ^ words[distinct % len(words)])
            sorted_ = np.argsort(h, kind="stable")
            self.grams.append((h[sorted_], _rank(sorted_)[place]))
            self.before.append(before)


def _rank(sorted_: np.ndarray) -> np.ndarray:
    rank = np.empty(len(sorted_), np.int64)
    rank[sorted_] = np.arange(len(sorted_))
    return rank


def _small(x: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 and more as 255 and again as eight bytes at the end."""
    big = x[x >= 255].astype("<i8")
    return np.minimum(x, 255).astype("u1").tobytes() + big.tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, "u1", n).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<i8", offset=n)
    return x


def _parter(parts: int, order: int = 2):
    """Rows (kind, part, batch, keys, counted, kept): a batch's hashes that fall in the part, and their counts by role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            for row in arrow.to_pylist():
                b = Batch(row, order)
                out = []
                for kind, (keys, place) in enumerate(b.grams):
                    counts = [np.bincount(place[b.role == r], minlength=len(keys)) for r in (COUNTED, KEPT_BACK)]
                    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        if y > x:
                            out.append((kind, p, row["batch"], keys[x:y].tobytes(), *(_small(c[x:y]) for c in counts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "part", "batch", "keys", "counted", "kept"])

    return run


def _count_part(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of one part, given back to each batch; n_all and n_distinct: this part's tokens and distinct n-grams in training."""
    sizes = [len(x) // 8 for x in table["keys"].to_pylist()]
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8")
    distinct, where = np.unique(keys, return_inverse=True)
    totals = []
    for name in ("counted", "kept"):
        own = np.concatenate([_large(x, n) for x, n in zip(table[name].to_pylist(), sizes)])
        totals.append(np.bincount(where, weights=own, minlength=len(distinct)).astype(np.int64))
    every = totals[0] + totals[1]
    cuts = np.cumsum([0, *sizes])
    back = [[_small(t[where[a:b]]) for a, b in zip(cuts, cuts[1:])] for t in (totals[0], every)]
    summary = [(int(t.sum()), int((t > 0).sum())) for t in (totals[0], every)]
    n = len(sizes)
    first = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())
    return pa.table({
        "kind": table["kind"], "part": table["part"], "batch": table["batch"], "n": pa.array(sizes, pa.int64()), "some": pa.array(back[0], pa.binary()), "every": pa.array(back[1], pa.binary()),
        "some_tokens": first(summary[0][0]), "some_distinct": first(summary[0][1]), "all_tokens": first(summary[1][0]), "all_distinct": first(summary[1][1]),
    })


_COUNTS = "kind int, part int, batch long, n long, some binary, every binary, some_tokens long, some_distinct long, all_tokens long, all_distinct long"


class Counts:
    """Counts of a batch's tokens: of the n-gram that ends there and of its context, for n = 1 to the order."""

    def __init__(self, b: Batch, table: pa.Table, which: str, documents: int):
        rows = sorted(table.select(["kind", "part", "n", which]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        totals = [np.concatenate([_large(r[which], r["n"]) for r in rows if r["kind"] == k]) for k in range(len(b.grams))]
        self.grams = [t[place] for t, (_, place) in zip(totals, b.grams)]
        self.contexts = [np.append(documents, t)[before] for t, before in zip(totals, b.before)]  # every word of a text is followed by a token


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(int), 0), BUCKETS - 1)


def buckets_of(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of each token: that of its longest context with a count."""
    out = bucket_of(contexts[0])
    for k, c in enumerate(contexts[1:], 1):
        out = np.where(c > 0, k * BUCKETS + bucket_of(c), out)
    return out


def estimates(grams: list[np.ndarray], contexts: list[np.ndarray], n: int) -> np.ndarray:
    """Estimates of each token, a column for each order from the highest to the unigram; the uniform one is the same for all."""
    longer = [np.where(c > 0, g / np.maximum(c, 1), 0.0) for g, c in zip(grams[1:], contexts)]
    return np.stack([*longer[::-1], grams[0] / max(n, 1)], 1)


def cells_of(bucket: np.ndarray, e: np.ndarray, v: int) -> np.ndarray:
    """The histogram cell of each event: its bucket, and the logarithm of each estimate over the uniform one in steps."""
    code = bucket.astype(np.int64)
    for k in range(e.shape[1]):
        step = np.floor(_STEPS * (np.log10(np.maximum(e[:, k] * (v + 1), 1e-300)) + _LOWEST)).astype(np.int64)
        code = code * _QUANTA + np.where(e[:, k] > 0, np.clip(step, 1, _QUANTA - 1), 0)
    return code


def maximise(bucket: np.ndarray, times: np.ndarray, e: np.ndarray, v: int, buckets: int, tolerance: float = 1e-7, rounds: int = 10_000) -> np.ndarray:
    """Weights of each bucket by expectation maximisation over events (bucket, how often, estimates)."""
    k = e.shape[1] + 1
    weights = np.full((buckets, k), 1 / k)
    e = np.hstack([e, np.full((len(e), 1), 1 / (v + 1))])
    for b in np.unique(bucket).tolist():  # the buckets do not depend on each other
        own = bucket == b
        x, t, w = e[own], times[own] / times[own].sum(), weights[b]
        for _ in range(rounds):
            p = x * w
            new = (t / p.sum(1)) @ p
            done = np.abs(new - w).max() < tolerance
            w = new
            if done:
                break
        weights[b] = w
    floor = 1e-6  # no event may become impossible
    return (weights + floor) / (weights + floor).sum(1, keepdims=True)


def _pair(batches: DataFrame, counts: DataFrame, function, schema: str, tasks: int) -> DataFrame:
    """function over each batch and its counts, in so many tasks."""
    left, right = (x.repartition(tasks, "batch").groupBy("batch") for x in (batches, counts))
    return left.cogroup(right).applyInArrow(function, schema)


def _learn(batches: DataFrame, counts: DataFrame, n: int, v: int, documents: int, order: int, tasks: int) -> np.ndarray:
    """Weights by bucket, from the histogram of the held-out events."""
    columns = [f"e{k}" for k in range(order)]

    def events(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Batch(row, order)
            c = Counts(b, right, "some", documents)
            own = b.role == KEPT_BACK
            contexts = [x[own] for x in c.contexts]
            e = estimates([x[own] for x in c.grams], contexts, n)
            cells, where = np.unique(cells_of(buckets_of(contexts), e, v), return_inverse=True)
            sums = [np.bincount(where, weights=x, minlength=len(cells)) for x in (np.ones(len(e)), *e.T)]
            out.append(pa.table([cells, *sums], ["cell", "times", *columns]))
        return pa.concat_tables(out)

    some = counts.select("batch", "kind", "part", "n", "some")
    found = _pair(batches, some, events, ", ".join(["cell long", "times double", *(f"{c} double" for c in columns)]), tasks)
    cells = found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("times", *columns)]).toPandas().sort_values("cell")
    times = cells["times"].to_numpy(float)
    e = cells[columns].to_numpy(float) / times[:, None]
    return maximise(cells["cell"].to_numpy(np.int64) // _QUANTA**order, times, e, v, (order - 1) * BUCKETS)


def score(docs: DataFrame, learn: Column, keep_back: Column, *, doc_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row. learn: rows to learn from; keep_back: those of them that teach the weights; order: 2 for bigrams, 3 for trigrams and so on."""
    if not 2 <= order <= 6:
        raise ValueError("the order goes from 2 to 6")
    kind = docs.schema[doc_id].dataType
    role = F.when(F.coalesce(learn, F.lit(False)), F.when(F.coalesce(keep_back, F.lit(False)), KEPT_BACK).otherwise(COUNTED)).otherwise(OTHER)
    named = docs.select(F.col(doc_id).cast("long").alias("id"), role.alias("role"), F.col(text).alias("text"))
    roles = {r.role: r for r in named.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    text_bytes = sum(r.bytes or 0 for r in roles.values())
    batches = materialise(tokenise(named.select("id", "text", "role"), F.col("role"), exchange_shape(text_bytes, 0)[0]), "lm-batches")
    size = batches.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    total = size.tokens // 4
    parts = max(4, math.ceil(total / exchange_shape(text_bytes, total)[1]))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, min(_MOST_TASKS, math.ceil(10 * order * total / _TASK_BYTES)))  # an n-gram travels as some ten bytes
    parted = batches.mapInArrow(_parter(parts, order), "kind int, part int, batch long, keys binary, counted binary, kept binary").repartition(tasks, "kind", "part")
    counts = materialise(parted.groupBy("kind", "part").applyInArrow(_count_part, _COUNTS), "lm-counts")
    release(docs.sparkSession)
    t = counts.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("some_tokens", "some_distinct", "all_tokens", "all_distinct")]).first()
    some_docs, all_docs = (sum(roles[k].n for k in ks if k in roles) for ks in ((COUNTED,), (COUNTED, KEPT_BACK)))
    teaching = batches.where(F.instr(F.hex("roles"), f"{KEPT_BACK:02d}") > 0)
    pairs = max(cores, min(_MOST_TASKS, size.n))
    weights = _learn(teaching, counts.join(teaching.select("batch"), "batch", "left_semi"), t.some_tokens, t.some_distinct, some_docs, order, pairs)
    release(docs.sparkSession)
    n, v = int(t.all_tokens), int(t.all_distinct)

    def scores(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Batch(row, order)
            c = Counts(b, right, "every", all_docs)
            starts = np.append(0, b.ends[:-1])
            add = lambda x: np.add.reduceat(x, starts)
            w = weights[buckets_of(c.contexts)]
            model = np.log10((w[:, :-1] * estimates(c.grams, c.contexts, n)).sum(1) + w[:, -1] / (v + 1))
            base = np.log10((c.grams[0] + 1) / (n + v + 1))
            null = b.ids == -(1 << 63)
            out.append(pa.table({"id": pa.array(b.ids, mask=null), "n_tokens": b.lengths.astype("i8"), "n_known": add((c.grams[0] > 0).astype("i8")), "train_tokens": np.full(len(b.ids), n, "i8"), "base_score": add(base), "score": add(model)}))
        return pa.concat_tables(out)

    every = counts.select("batch", "kind", "part", "n", "every")
    scored = _pair(batches, every, scores, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double", pairs)
    return scored.select(F.col("id").cast(kind).alias(doc_id), "n_tokens", "n_known", "train_tokens", "base_score", "score")
