"""Contracts on streams. Validation and repair are projections, so they run on a stream as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.guard import Guard
from ..sources import history


def repair_stream(guard: Guard, stream: DataFrame, col: str, out: str, checkpoint: str, history_path: str | None = None) -> StreamingQuery:
    """Writes repaired rows as Parquet, a folder per batch; a batch that runs again replaces its own folder.

    History goes the same way, so a retried batch never counts twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        repaired = guard.repair(rows, col)
        repaired.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if history_path:
            done = rows.sparkSession.read.parquet(f"{out}/batch={number}")
            history.records(done).write.mode("overwrite").json(f"{history_path}/batch={number}", ignoreNullFields=False)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
