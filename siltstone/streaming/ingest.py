"""Feeding a store from a stream, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstone.sources.versions import query_id
from siltstone.store import Store


def ingest(store: Store, ops: DataFrame, name: str, checkpoint: str, compact: bool = True) -> None:
    """Apply the streaming ``ops`` (``batch_id, pos, key, op, value``) that are there to the store.

    The store's manifest keeps the query and the number of the last micro-batch of
    each stream ``name``, in the same version as its rows: after a failure the
    repeated micro-batch is passed over or applied, never both. With a new
    checkpoint under an old name nothing is applied, and the query fails. What is
    due after a micro-batch (flushes, compactions) is done in between.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not store.ingest(name, query_id(batch.sparkSession, checkpoint), number, batch):
            batch.write.format("noop").mode("overwrite").save()  # state that the stream may have is committed all the same
        elif compact:
            store.maintain()

    ops.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
