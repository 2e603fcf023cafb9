"""The keys of a growing history, as a bucketed table that runs are joined with where it lies.

Keys are dealt to buckets by hash and sorted within a file. A run's own keys are shuffled to the buckets and merge
with them, so no row of the history moves. Each run appends a file to the buckets it has keys for; `compact` makes one
file of each bucket again.
"""

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import remove_folder

KEY = "alert_key"
_GENERATION = re.compile(r"gen-(\d+)-buckets-(\d+)")


class KeyIndex:
    """Keys with the number of the run that stored them, under a folder.

    An index starts with a few buckets, as every run reads them all; `compact` gives a grown one more. The folder holds
    generations, `gen-<number>-buckets-<count>`; the newest that was written to its end counts. The
    table over it is made in the session's catalog when the index is opened, so any session can open any folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self._open(*max(self._generations(), default=(0, buckets)))

    def _generations(self) -> list[tuple[int, int]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        home = hadoop.Path(self.path)
        system = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(home):
            return []
        found = []
        for status in system.listStatus(home):
            match = _GENERATION.fullmatch(status.getPath().getName())
            if match and system.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append((int(match[1]), int(match[2])))
        return found

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets = generation, buckets
        self.folder = f"{self.path}/gen-{generation}-buckets-{buckets}"
        self.table = f"keys_{hashlib.sha256(self.folder.encode()).hexdigest()[:24]}"
        location = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({KEY} STRING, run BIGINT) USING parquet"
            f" CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        # Another session may have appended since the catalog listed the files.
        self.spark.catalog.refreshTable(self.table)

    def keys(self, before: int | None = None) -> DataFrame:
        """The keys, of all runs or of those before one. The hint keeps the join a merge join at every size, as a
        broadcast would move the history."""
        rows = self.spark.table(self.table)
        if before is not None:
            rows = rows.filter(F.col("run") < before)
        return rows.select(KEY).hint("merge")

    def newest(self) -> int | None:
        """The newest run with keys."""
        return self.spark.table(self.table).agg(F.max("run")).first()[0]

    def add(self, keys: DataFrame) -> None:
        """Append (alert_key, run). A key that is appended twice counts once, and one that comes with many alerts of
        a run is reduced before it is moved, so that its bucket does not get them all."""
        rows = keys.select(KEY, F.col("run").cast("bigint").alias("run")).distinct()
        # One task for each bucket, so that a run adds at most one file to each.
        rows.repartition(self.buckets, KEY).write.insertInto(self.table)

    def compact(self, buckets: int | None = None) -> None:
        """One file of distinct keys for each bucket, also of another number of buckets, in a new generation; then the
        old one goes. A compaction that dies leaves the old generation in force."""
        old, old_table, count = self.folder, self.table, buckets or self.buckets
        rows = self.spark.table(old_table).groupBy(KEY).agg(F.min("run").alias("run"))
        if count != self.buckets:
            rows = rows.repartition(count, KEY)
        # What a compaction that died left in this folder has no mark of success.
        remove_folder(self.spark, f"{self.path}/gen-{self.generation + 1}-buckets-{count}")
        self._open(self.generation + 1, count)
        rows.write.insertInto(self.table)
        self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
        remove_folder(self.spark, old)
