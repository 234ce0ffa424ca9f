"""A stream of chunks into the store: each micro-batch is one upsert, so a batch that is retried changes nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexivec.sources.store import ChunkStore


def ingest(chunks: DataFrame, store: ChunkStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """chunks: a streaming DataFrame of files.CHUNKS. The checkpoint remembers what was read."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    writer = chunks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
