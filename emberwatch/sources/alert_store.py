"""The alert history: Parquet, one folder per day of the alert's first event."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from emberwatch.operators.dedup import dedup_key, unknown_alerts, with_run
from emberwatch.schemas import ALERT, conform
from emberwatch.session import remove_folder, shared_folder
from emberwatch.sources.key_index import KEY, KeyIndex


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All stored alerts. A missing table is empty; a damaged one, or a folder that lost its files,
    fails instead of reading as empty, so that old alerts do not fire again."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ALERT)
    return conform(stored, ALERT)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append; existing files are not touched. Rows are gathered by day, so a day's folder gets
    few files, and the rebalance splits a day that holds most alerts.

    A history starts with a file without rows, so that one without alerts differs from a folder
    that lost its files."""
    spark = alerts.sparkSession
    spark.createDataFrame([], ALERT).write.mode("ignore").parquet(f"{path}/day=1970-01-01")
    (
        alerts.withColumn("day", F.to_date("first_seen"))
        .hint("rebalance", "day")
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def key_index(spark: SparkSession, path: str) -> KeyIndex:
    """The index of the keys of a history, which lies beside it."""
    return KeyIndex(spark, f"{path.rstrip('/')}-keys")


def _keys(alerts: DataFrame) -> DataFrame:
    return alerts.select(dedup_key().alias(KEY), F.coalesce("ord.run", F.lit(0)).alias("run"))


def store_batch(spark: SparkSession, alerts: DataFrame, path: str, batch: int) -> None:
    """As `store_new_alerts` for one micro-batch of a stream, safe to repeat.

    Every batch owns a folder: a repeated batch compares with the keys of earlier batches only and
    overwrites its own folder, so each alert is stored exactly once. The keys follow the alerts; a
    batch that dies in between is repeated by the stream.
    """
    index = key_index(spark, path)
    fresh = with_run(unknown_alerts(alerts, index.keys(before=batch)), batch)
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    index.add(_keys(conform(spark.read.parquet(f"{path}/batch={batch}"), ALERT)))


def load_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Alerts stored by `store_batch`, of all batches or of those before one. Nothing comes before
    batch 0, also where its first try left a folder without files."""
    if before == 0:
        return spark.createDataFrame([], ALERT)
    try:
        stored = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ALERT)
    if before is not None:
        stored = stored.filter(F.col("batch") < before)
    return conform(stored, ALERT)


def store_new_alerts(spark: SparkSession, alerts: DataFrame, path: str, run: int) -> None:
    """Deduplicate against the history and append what is new, stamped with the run.

    The history's keys are read from their index, whose buckets a run joins without moving them.
    Runs are numbered upwards: a run before the newest one stored is an error.
    """
    index = key_index(spark, path)
    newest = _catch_up(index, load_alerts(spark, path))
    if newest is not None and run < newest:
        raise ValueError(f"run {run} comes after run {newest} in the history")
    scratch = shared_folder(spark, "new-alerts")
    with_run(unknown_alerts(alerts, index.keys()), run).write.parquet(scratch)
    fresh = conform(spark.read.schema(ALERT).parquet(scratch), ALERT)
    append_alerts(fresh, path)
    index.add(_keys(fresh))
    remove_folder(spark, scratch)


def _catch_up(index: KeyIndex, history: DataFrame) -> int | None:
    """Index what a run stored that died before it indexed, or all of a history without an index; the
    newest run. Rows of older runs are passed over by the statistics of their files."""
    newest = index.newest()
    rows = history if newest is None else history.filter(F.col("ord.run") >= newest)
    missing = _keys(rows).join(index.keys(), KEY, "left_anti")
    if not missing.isEmpty():
        index.add(missing)
        newest = index.newest()
    return newest
