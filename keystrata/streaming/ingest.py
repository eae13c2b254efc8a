"""Continuous ingest of operations into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators import state
from keystrata.sources.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, compact_every: int = 0, listener: Callable[[int], None] | None = None) -> StreamingQuery:
    """Writes a stream of operations into the store, a batch for each trigger, until what is there has been read.

    A batch is folded to its newest versions before it is written. A batch that is repeated after a failure changes nothing: the
    newest lsn wins. `listener` is told each batch's number in the store; every `compact_every` batches the store is compacted.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            written = store.write(state.latest(rows))
            if listener:
                listener(written)
            if compact_every and (number + 1) % compact_every == 0:
                store.compact()

    return ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
