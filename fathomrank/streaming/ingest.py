"""A stream of documents becomes committed generations, one a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fathomrank.sources.store import Store


def commit_stream(docs: DataFrame, store: Store, order: list[str], checkpoint: str, merge: bool = True) -> StreamingQuery:
    """Commit each micro-batch of a streaming DataFrame of documents.

    A batch that is run again after a failure holds keys that are committed already; those rows are
    dropped before the commit, so each document is stored once.
    """

    def one(batch: DataFrame, _: int) -> None:
        known = store.open().docs.select("key")
        store.commit(batch.join(known, "key", "left_anti").select(*batch.columns), order)
        if merge:
            store.merge()

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
