"""Session settings the operators rely on, and the shared folder for intermediate tables."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Log times are UTC; window arithmetic must not move with the driver's zone.
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above 8000 bytes of code. Wide parsing stages exceed that,
    # and run much faster as several smaller generated functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A few bytes of a Parquet or log file become a long row, so a task reads a small piece: what it sorts
    # would else grow with the input until a piece has 128 MB.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

STREAMING_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_HOMES: set[str] = set()


def configure(spark: SparkSession, streaming: bool = False) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if streaming:
        for key, value in STREAMING_SETTINGS.items():
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("emberwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.python.unix.domain.socket.enabled", "true")
        # Recording a call site for every column expression doubles the time to build a query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return configure(builder.getOrCreate(), streaming=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the cluster's checkpoint folder, removed when the application ends.

    The folder comes from `spark.checkpoint.dir`. A temporary folder is made only where that is unset and
    everything runs in one process; on a cluster an executor's own disk would not be seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="emberwatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    home = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_remove_home, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _remove_home(spark: SparkSession, home: str) -> None:
    # At exit the session may be gone already; what is left then is for the folder's owner to expire.
    if spark.sparkContext._jsc is not None:
        remove_folder(spark, home)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables through Spark's own file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, its lineage ends
    here, and it survives a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
