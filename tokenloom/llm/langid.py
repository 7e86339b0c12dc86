"""Language identification by a string kernel with Nystroem landmarks.

Texts are reduced to lower-case letters, every run of anything else becoming one
space. The kernel of two texts is the number of distinct character n-grams
(n = 1..3, the blended spectrum) present in both, normalised to 1 for a text with
itself. A bounded sample of labelled texts trains the classifier: some of them
are landmarks, the Nystroem map turns kernel values against the landmarks into
features, and one ridge regression per language (one versus rest, +1 and -1) is
fitted on these. Scoring multiplies, per batch, the matrix of n-gram presence
with that of the landmarks, and the kernel values with the folded weights.

An n-gram is the code points of its letters packed into one 64-bit number, so
nothing is hashed and no letters of any script are merged; the landmarks' n-grams,
sorted, are the columns of the matrices.

Defined cases: a null text and a text without a letter are `und` with score 0; a
null lang or null id is never learned from; without any labelled text every
prediction is `und`; one label alone is predicted for every text with a letter.
The score is the softmax of the regressions' outputs for the predicted language.
Ties go to the language first by code point. Of rows that repeat an id and a
label one is learned from, that with the least text; every row gets a prediction.
Texts of any length are read whole, in training too. An empty table gives no
rows. Columns of docs keep their names and order; the column that is added takes
a name that none of them has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import chunks, free_name, materialise

UND = "und"
_LEAST_LANDMARKS = 4  # of a label, however many labels there are
_SHARPNESS = 4.0
_POINTS = 0x110000
_BITS = 21  # of a code point
_SPACE = 1  # stands for a run of anything but letters; no letter has this code point
_CELLS = 1 << 23  # of a matrix of n-gram presence


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """For every code point: the lower-case letter, or 0 for anything but a letter."""
    table = np.zeros(_POINTS, np.uint32)
    for c in range(_POINTS):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, 0 for other characters."""
    return _letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def grams_of(text: str) -> np.ndarray:
    """Distinct n-grams of a text, sorted: the code points of one to three symbols packed into one number each."""
    found = letters(text)
    if not found.any():
        return np.empty(0, np.int64)
    s = np.where(found > 0, found, _SPACE).astype(np.int64)
    s = s[(found > 0) | np.append(False, found[:-1] > 0)]  # one space for a run, none at the start
    s = np.concatenate([[_SPACE], s, [_SPACE][: int(s[-1] != _SPACE)]]).astype(np.int64)
    two = (s[:-1] << _BITS) | s[1:]
    grams = np.sort(np.concatenate([s, two, (two[:-1] << _BITS) | s[2:]]))
    return grams[np.append(True, grams[1:] != grams[:-1])]


class Model:
    def __init__(self, samples: list[tuple[np.ndarray, str]], *, landmarks: int, ridge: float):
        """samples: (n-grams, label), in an order that does not depend on the partitioning."""
        samples = [x for x in samples if len(x[0])]
        self.labels = sorted({label for _, label in samples})
        if not self.labels:
            return
        per = max(_LEAST_LANDMARKS, landmarks // len(self.labels))
        seen: Counter[str] = Counter()
        chosen = []
        for g, label in samples:
            if seen[label] < per:
                chosen.append(g)
                seen[label] += 1
        self.columns = np.unique(np.concatenate(chosen))
        self.marks = np.zeros((len(self.columns), len(chosen)), np.float32)
        for j, g in enumerate(chosen):
            self.marks[np.searchsorted(self.columns, g), j] = 1 / np.sqrt(len(g))
        between = self.kernel(chosen).astype(np.float64)
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        keep = values > 1e-6 * values[-1]
        self.root = vectors[:, keep] / np.sqrt(values[keep])
        phi = self.kernel([g for g, _ in samples]).astype(np.float64) @ self.root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.where(np.array([label for _, label in samples])[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        weights = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
        self.weights, self.bias = (self.root @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32)

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of each n-gram set with each landmark."""
        out = np.empty((len(grams), self.marks.shape[1]), np.float32)
        step = min(256, max(1, _CELLS // len(self.columns)))
        for a in range(0, len(grams), step):
            part = grams[a : a + step]
            flat = np.concatenate(part)
            row = np.repeat(np.arange(len(part)), [len(g) for g in part])
            at = np.minimum(np.searchsorted(self.columns, flat), len(self.columns) - 1)
            known = self.columns[at] == flat
            x = np.zeros((len(part), len(self.columns)), np.float32)
            x[row[known], at[known]] = np.repeat(np.array([1 / np.sqrt(max(1, len(g))) for g in part], np.float32), [len(g) for g in part])[known]
            out[a : a + len(part)] = x @ self.marks
        return out

    def decide(self, grams: list[np.ndarray]) -> np.ndarray:
        """Outputs of the regressions, one per label, for n-gram sets that are not empty."""
        return (self.kernel(grams) @ self.weights + self.bias).astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams = [grams_of(t) if t else np.empty(0, np.int64) for t in texts]
        rows = np.array([i for i, g in enumerate(grams) if len(g)], int)
        labels, scores = [UND] * len(texts), np.zeros(len(texts))
        if self.labels and len(rows):
            f = self.decide([grams[i] for i in rows])
            best = f.argmax(1)
            e = np.exp(_SHARPNESS * (f - f.max(1, keepdims=True)))
            scores[rows] = e[np.arange(len(rows)), best] / e.sum(1)
            for i, b in zip(rows.tolist(), best.tolist()):
                labels[i] = self.labels[b]
        return labels, scores


def sample_rows(docs: DataFrame, learn: Column, *, doc_id: str, text: str, label: str, per_label: int) -> DataFrame:
    """(at_, label_, text_): for each label one text of each of the per_label distinct ids with the smallest hashes.

    Tasks pass on at most per_label ids a label; of an id that repeats, the least
    text counts, found by partial aggregation.
    """
    usable = learn & F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(doc_id).isNotNull()
    key = F.xxhash64(F.col(doc_id).cast("string"), F.lit("langid"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, str]]] = {}
        for batch in batches:
            keys, labels = batch.column(2).to_numpy(), batch.column(1).dictionary_encode()
            which, names = labels.indices.to_numpy(), labels.dictionary.to_pylist()
            for k, name in enumerate(names):
                at = np.flatnonzero(which == k)
                have = best.get(name, [])
                if len(have) == per_label:
                    at = at[keys[at] <= have[-1][0]]
                if len(at):
                    best[name] = sorted({*have, *zip(keys[at].tolist(), batch.column(0).take(pa.array(at)).to_pylist())})[:per_label]
        rows = [(i, name, k) for name, x in best.items() for k, i in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["id_", "label_", "key_"])

    rows = docs.where(usable).select(F.col(doc_id).cast("string").alias("id_"), F.col(label).cast("string").alias("label_"), key.alias("key_"))
    order = W.partitionBy("label_").orderBy("key_", "id_")
    few = rows.mapInArrow(smallest, "id_ string, label_ string, key_ long").distinct()
    chosen = few.withColumn("at_", F.row_number().over(order)).where(F.col("at_") <= per_label).select("id_", "label_", "at_")
    chosen = materialise(chosen, "langid-sample")  # per_label ids a label: small enough for a broadcast unless labels are many
    texts = docs.where(usable).select(F.col(doc_id).cast("string").alias("id_"), F.col(label).cast("string").alias("label_"), F.col(text).alias("text_"))
    return texts.join(chosen, ["id_", "label_"]).groupBy("at_", "label_").agg(F.min("text_").alias("text_"))


def train(docs: DataFrame, learn: Column, *, doc_id: str, text: str, label: str, per_label: int, landmarks: int, ridge: float) -> Model:
    """Fit on sample_rows(); only the n-gram sets of the texts reach the driver, which do not grow with the texts' lengths for long."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([grams_of(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["at_", "label_", "grams_"])

    sample = sample_rows(docs, learn, doc_id=doc_id, text=text, label=label, per_label=per_label)
    found = sample.mapInArrow(sets, "at_ int, label_ string, grams_ binary").collect()
    found = sorted((r.at_, r.label_, bytes(r.grams_)) for r in found)
    return Model([(np.frombuffer(g, np.int64), name) for _, name, g in found], landmarks=landmarks, ridge=ridge)


def identify(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 400, landmarks: int = 96, ridge: float = 1e-2) -> tuple[DataFrame, str]:
    """docs with one struct column (lang, score) and that column's name. learn: the rows that may be learned from."""
    model = train(docs, learn, doc_id=doc_id, text=text, label=label, per_label=per_label, landmarks=landmarks, ridge=ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x their n-grams, whatever the size of docs
    name, at = free_name(docs, "language"), docs.columns.index(text)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            labels, scores = [], []
            for a, b in chunks([len(t or "") for t in texts], 2 << 20):
                got = shared.value.predict(texts[a:b])
                labels += got[0]
                scores.append(got[1])
            found = pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    language = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, language)])), name
