"""A resumable work queue over a stream of contexts.

The resume rule of the batch steps (only keys that aren't done yet are worked
on) holds for micro-batches too: each is inserted if absent, so a batch that is
replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import Store


def stage_stream(stream: DataFrame, store: Store, table: str, checkpoint: str, keys: list[str] | None = None, after: Callable[[Store], None] | None = None) -> StreamingQuery:
    """Inserts each micro-batch into a staging table, then runs `after` (a step over what is pending)."""
    store.create()

    def put(rows: DataFrame, _: int) -> None:
        store.insert(table, rows, keys)
        if after:
            after(store)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
