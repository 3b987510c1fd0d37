"""Search of a stream of queries against an index that doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecloom.params import SearchParams
from vecloom.plans.index import Index


def serve(queries: DataFrame, index: Index, params: SearchParams, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of (qid, v) is searched like a fixed set; sink gets its (qid, rank, id, dist) and the batch's number.

    trigger: as for writeStream.trigger, {"processingTime": "10 seconds"} for a service that goes on; by default it ends
    with the data that is there. Searches keep no state between batches. With a sink that is idempotent by batch number, results are exactly once.
    """
    writer = queries.writeStream.foreachBatch(lambda batch, n: sink(index.search(batch, params), n))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(**(trigger or {"availableNow": True})).start()
