"""Structured Streaming into an index: each micro-batch of changes is applied once and published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.index import SearchIndex


def ingest(changes: DataFrame, index: SearchIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that applies streaming changes (seq, op, doc_id, text) in batches, in the order of seq.

    A batch's number stands in the log with the batch and later in the manifest. A batch that is run
    again after a crash is not applied again; what the crash left unpublished is published. Default
    trigger: all there is now, then stop.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        if batch_id > index.last_batch:
            index.apply(batch, batch_id)
        index.flush()

    writer = changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
