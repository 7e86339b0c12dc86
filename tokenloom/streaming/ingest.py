"""Incremental ingestion: a stream of documents into a store, and stateless filters over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import Filter
from ..store import Store


def ingest(stream: DataFrame, store: Store, *, checkpoint: str, index_each: bool = False, once: bool = True) -> StreamingQuery:
    """Add every micro-batch (uuid, body, ...) to the store. A batch that is run again only rewrites the same documents."""

    def add(batch: DataFrame, _: int) -> None:
        store.add(batch)
        if index_each:
            store.index()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def matching(stream: DataFrame, filter: Filter) -> DataFrame:
    """Documents of a stream that match; no state is kept."""
    return stream.where(filter.column())
