"""The commit index kept up to date from a stream of history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftline.functions.terms import Vocabulary
from driftline.operators import commit_index
from driftline.sources import index_store

#: Batches after which the index is folded into one base.
FOLD_EVERY = 20


def index_stream(
    history: DataFrame,
    vocabulary: Vocabulary,
    path: str,
    checkpoint: str,
    fold_every: int = FOLD_EVERY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the commits of every batch that the index lacks; ``trigger`` is Spark's, by default all that is available.

    A batch asks the store for its own commits only. Every ``fold_every``
    batches the index is folded, before the batch that follows them.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number >= fold_every and number - 1 - index_store.folded(spark, path) >= fold_every:
            index_store.fold(spark, path, number - 1)
        batch = batch.persist()  # read for its hashes and for its rows
        held = index_store.known(spark, path, commit_index.projection(batch), before=number)
        new = commit_index.index_incremental(batch, held, vocabulary, max_commits=None)
        index_store.write_batch(new, path, number)
        batch.unpersist()

    return (
        history.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
