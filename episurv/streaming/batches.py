"""Micro-batches as folders: a batch that is run again replaces its own folder."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from episurv.operators.filters import first_per_key

BATCH = "_batch"
# Seconds to wait for the last report of a stream that has ended.
LISTENER_S = 60


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; the file limit bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


class LateRows(StreamingQueryListener):
    """Adds up the rows the engine dropped because the watermark had passed them, over all batches of one run."""

    def __init__(self):
        self.total, self.run, self.ended = 0, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.run is None or str(event.progress.runId) == self.run:
            self.total += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run is None or str(event.runId) == self.run:
            self.ended.set()


def run_available(
    df: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    of_batch: Callable[[DataFrame], DataFrame] | None = None,
    allow_late: bool = True,
) -> StreamingQuery:
    """Process what is there now, batch by batch, and stop. `of_batch` is applied to each batch before it is written.

    Unless late rows are allowed, every batch's dropped rows are counted, and any raise an error at the end.
    """
    write = write_batch(path)
    late, spark = LateRows(), df.sparkSession
    if not allow_late:
        spark.streams.addListener(late)
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write if of_batch is None else lambda batch, batch_id: write(of_batch(batch), batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    late.run = str(query.runId)
    try:
        query.awaitTermination()
        if not allow_late and not late.ended.wait(LISTENER_S):
            raise RuntimeError("the stream ended, but not all of its progress was reported")
    finally:
        if not allow_late:
            spark.streams.removeListener(late)
    if late.total:
        raise ValueError(f"{late.total} rows came later than the watermark allows; run them again with a longer delay")
    return query


def latest(spark: SparkSession, path: str, key: str | Sequence[str]) -> DataFrame:
    """The newest version of each key over all batches."""
    return first_per_key(spark.read.parquet(path), key, [F.desc(BATCH)]).drop(BATCH)
