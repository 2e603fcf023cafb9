"""Running a stream to the end of its input, and on a schedule."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it as Parquet, and stop.

    The checkpoint advances after the files are committed, so a failed run is repeated and no
    line is lost or written twice.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Process everything that has arrived in micro-batches, and stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_every(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    seconds: int = 300,
) -> StreamingQuery:
    """Start a query that takes what has arrived every `seconds`."""
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )
