"""Query of chat formatting: conversations are formatted, and digests read back from the windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chat import format_windows, read_turns, unescape
from .common import table

_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold; they lie in order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        turns = loss = None
        for batch in batches:
            for w in batch.to_pylist():
                if not rows or rows[-1][0] != w["conv_id"] or w["window"] == 0:
                    if rows:
                        rows[-1][2], rows[-1][4] = turns.hexdigest(), loss.hexdigest()
                    rows.append([w["conv_id"], 0, "", 0, "", 0, 0])
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                row = rows[-1]
                for role, text in read_turns(w["text"])[w["n_repeated"] :]:
                    row[1] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in w["targets"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    row[3] += len(text)
                    loss.update(text.encode())
                row[5] += len(w["text"])
                row[6] += 1
            if len(rows) > 1:  # the last conversation may go on
                yield _batch(rows[:-1])
                rows = rows[-1:]
        if rows:
            rows[-1][2], rows[-1][4] = turns.hexdigest(), loss.hexdigest()
        yield _batch(rows)

    return windows.mapInArrow(run, _DIGEST)


def _batch(rows: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    return digests(format_windows(conversations.unionByName(extra)))
