"""Names that arrive as a stream, each batch screened against a static catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onomast.config import DEFAULT, MatchConfig
from onomast.plans.check import Catalogue, check


def screen(lines: DataFrame, catalogue: Catalogue, sink: Callable[[DataFrame, int], None], checkpoint: str, config: MatchConfig = DEFAULT, aliases: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts a query over a stream with a text column ``value``; ``sink(results, batch_id)`` takes each batch.

    Screening is stateless, but its top-k windows are not allowed in a streaming plan, so batches go through
    foreachBatch.  Blank lines are dropped.  A batch that runs again after a failure has the same batch_id, by which a
    sink can make itself idempotent.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        names = df.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("query_id"), F.col("value").alias("raw")).persist()
        try:
            sink(check(names, catalogue, config, aliases), batch_id)
        finally:
            names.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
