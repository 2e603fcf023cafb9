"""Log file scans, batch and streaming.

Every scan returns lines with `value` (or `record`) and `seq`. It follows the log over all its
files: file, place of the split in the file, line in the split. It is not dense, and its values
depend on the split size, so write the normalised table once and read it from there.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from emberwatch import constants as K
from emberwatch.functions.audit import normalize_audit
from emberwatch.functions.auth import Normalized, normalize_auth
from emberwatch.functions.cloud import normalize_cloud
from emberwatch.functions.honeypot import normalize_honeypot
from emberwatch.functions.text import strip

# A record read as STRING keeps its JSON text.
CLOUD_FILE = "Records ARRAY<STRING>, broken_file STRING"
_CLOUD_OPTIONS = {
    "multiLine": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "broken_file",
}


#: Bits of `seq` that count lines in a task; the bits above them name the split.
LINE_BITS = 33

#: File tables up to so many rows (a few hundred bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_FILES = 100_000

#: Rotated logs follow their time of change; files named by date may follow their names instead.
FILE_ORDERS = {"time": ["modificationTime", "log_file"], "name": ["log_file"]}


def with_seq(lines: DataFrame) -> DataFrame:
    """Numbers in scan order, for lines that are no files' any more."""
    return lines.withColumn("seq", F.monotonically_increasing_id())


def least_split(spark: SparkSession) -> int:
    """Splits of a file start at multiples of one size, and that size is at least this many bytes."""
    sizes = [spark.conf.get(f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes")]
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return max(min(to_bytes(size) for size in sizes), 1)


def file_table(spark: SparkSession, path: str | list[str], order: str) -> DataFrame:
    """(log_file, first_split): one row per file, with a number that leaves room for the splits of
    the files before it. Only file names, times and lengths are read."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("log_file"), "modificationTime", "length"
    )
    room = F.floor(F.col("length") / F.lit(least_split(spark))) + 1
    before = Window.orderBy(*FILE_ORDERS[order]).rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "log_file", F.coalesce(F.sum(room).over(before), F.lit(0)).cast("bigint").alias("first_split")
    )


def in_log_order(
    spark: SparkSession, scan: DataFrame, column: str, made: Column, path: str | list[str], order: str
) -> DataFrame:
    """(column, seq) of a file scan. Spark packs splits into tasks by size, so the number of a row
    in its task orders the rows of one split only; the split comes from the file table.

    The table is listed after the scan, so it has every file that the scan has.
    """
    rows = scan.select(
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("start"),
        made.alias(column),
    ).withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1)))
    files = file_table(spark, path, order)
    if len(scan.inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    split = F.col("first_split") + F.floor(F.col("start") / F.lit(least_split(spark)))
    known = F.coalesce(split, F.raise_error(F.lit("a log file was replaced during the scan")).cast("bigint"))
    seq = F.shiftleft(known, LINE_BITS) + F.col("line")
    return rows.join(files, "log_file", "left").select(column, seq.alias("seq"))


def not_blank(column: str = "value") -> Column:
    return strip(F.col(column)) != ""


def read_lines(spark: SparkSession, path: str | list[str], order: str = "time") -> DataFrame:
    """Text log lines without blank ones. Undecodable bytes become the replacement character."""
    scan = spark.read.text(path).filter(not_blank())
    return in_log_order(spark, scan, "value", F.col("value"), path, order)


def read_lines_or_empty(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """As `read_lines`; a missing path reads as no lines."""
    try:
        return read_lines(spark, path, order)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value STRING, seq BIGINT")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same lines as a stream over a landing folder, with the place they come from; inside a
    micro-batch `number_batch` gives them their `seq`.

    The checkpoint of the query remembers the files it has taken, after the sink has committed
    them; a rotated log lands as a new file.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).filter(not_blank()).select(
        "value",
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_modification_time").alias("modificationTime"),
        F.col("_metadata.file_block_start").alias("start"),
    )


#: Bits of a streamed `seq` below the batch: splits of a batch, lines of a task.
BATCH_SPLIT_BITS, BATCH_LINE_BITS = 13, 30


def number_batch(lines: DataFrame, batch: int, order: str = "time") -> DataFrame:
    """(value, seq) of a micro-batch of `stream_lines`: batch, split in log order, line in the
    split. The splits of a batch are few by its bound of 8192, more is an error, so they are broadcast."""
    place = F.row_number().over(Window.orderBy(*FILE_ORDERS[order], "start")) - 1
    splits = lines.select("log_file", "modificationTime", "start").distinct().select(
        "log_file", "start", place.alias("place")
    )
    fits = F.col("place") < (1 << BATCH_SPLIT_BITS)
    too_many = F.raise_error(F.lit("too many splits in a batch; set files_per_trigger")).cast("int")
    splits = splits.withColumn("place", F.when(fits, F.col("place")).otherwise(too_many))
    too_long = F.raise_error(F.lit("too many lines in a split")).cast("bigint")
    line = F.when(F.col("line") < (1 << BATCH_LINE_BITS), F.col("line")).otherwise(too_long)
    high = F.lit(batch << BATCH_SPLIT_BITS).cast("bigint") + F.col("place")
    return (
        lines.withColumn("line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1)))
        .join(F.broadcast(splits), ["log_file", "start"])
        .select("value", (F.shiftleft(high, BATCH_LINE_BITS) + line).alias("seq"))
    )


def read_cloud_files(
    spark: SparkSession, path: str | list[str], after: str | None = None, order: str = "time"
) -> tuple[DataFrame, DataFrame]:
    """Records of `{"Records": [...]}` files (gzip by file name) and the files that are no JSON.

    `after` skips files whose name sorts up to the last one processed. A file without the key
    gives no records.
    """
    files = spark.read.schema(CLOUD_FILE).options(**_CLOUD_OPTIONS).json(path)
    files = files.withColumn("file_name", F.col("_metadata.file_name"))
    if after:
        files = files.filter(F.col("file_name") > after)
    whole = files.filter("broken_file is null")
    records = in_log_order(spark, whole, "record", F.explode("Records"), path, order)
    # Spark wants a second column of the file next to the one for broken input.
    broken = files.filter("broken_file is not null and coalesce(size(Records), 0) >= 0").select(
        "file_name"
    )
    return records, broken


def stream_cloud_files(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The records of new files. Files that are no JSON are left to `stream_checked_cloud_files`."""
    checked = stream_checked_cloud_files(spark, path, files_per_trigger)
    return checked.filter("reason is null").select("record")


def stream_checked_cloud_files(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """(record, file_name, reason): the records of new files, and a row without a record for each
    file that is no JSON, so that it leaves its name and is counted."""
    reader = spark.readStream.schema(CLOUD_FILE).options(**_CLOUD_OPTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))
    broken = F.col("broken_file").isNotNull()
    return files.select(
        F.explode(F.when(broken, F.array(F.lit(None).cast("string"))).otherwise(F.col("Records"))).alias("record"),
        "file_name",
        F.when(broken, F.lit("broken file")).alias("reason"),
    )


def last_file_name(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Name of the newest file, to pass as `after` next time."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.agg(F.max(F.substring_index("path", "/", -1)).alias("last_file"))


def normalize(lines: DataFrame, source: str, year: int | None = None) -> Normalized:
    """Events and rejects of one source. Cloud input has `record`, the others `value`."""
    if source == K.AUTH_LOG:
        return normalize_auth(lines, year)
    if source == K.AUDITD:
        return normalize_audit(lines)
    if source == K.CLOUDTRAIL:
        return normalize_cloud(lines)
    if source == K.COWRIE:
        return normalize_honeypot(lines)
    raise ValueError(f"unknown log source: {source}")


def read_events(
    spark: SparkSession, path: str | list[str], source: str, year: int | None = None, order: str = "time"
) -> Normalized:
    """Scan and normalise complete files of one source, in the order of their time or name."""
    if source == K.CLOUDTRAIL:
        records, broken = read_cloud_files(spark, path, order=order)
        typed = normalize_cloud(records)
        broken_files = broken.select(
            F.lit(source).alias("source"),
            F.col("file_name").alias("raw"),
            F.lit(None).cast("bigint").alias("seq"),
            F.lit("broken file").alias("reason"),
        )
        every = typed.checked.unionByName(broken_files, allowMissingColumns=True)
        return Normalized(typed.events, typed.rejects.unionByName(broken_files), every)
    if source == K.COWRIE:
        return normalize_honeypot(read_lines_or_empty(spark, path, order))
    return normalize(read_lines(spark, path, order), source, year)


def all_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Events of several sources in one table; columns a source lacks are NULL."""
    frames = list(tables.values())
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def strictly(normalized: Normalized) -> DataFrame:
    """The events, failing at the first reject when the query runs.

    The check rides along with the event rows: rejects are turned into an error and never into
    a row.
    """
    failing = normalized.rejects.select(
        F.raise_error(F.concat(F.lit("rejected line: "), F.col("reason"))).alias("broken")
    )
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in normalized.events.schema]
    return normalized.events.unionByName(
        failing.filter(F.col("broken").isNotNull()).select(*columns)
    )


def _line_counts() -> list[Column]:
    good = F.col("reason").isNull()
    return [F.count_if(good).alias("events"), F.count_if(~good).alias("parse_errors")]


def count_lines(tables: dict[str, Normalized]) -> DataFrame:
    """Per source: events and rejects, counted in one pass over its lines."""
    counts = None
    for source, table in tables.items():
        one = table.checked.agg(*_line_counts()).select(F.lit(source).alias("source"), "events", "parse_errors")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def observed(table: Normalized, observation: Observation | str) -> DataFrame:
    """The events, which count events and rejects while they are read, by no further pass.

    In a batch, an `Observation` has the counts once an action has run. On a stream, a name: each
    progress report has the counts of its batch under it.
    """
    seen = table.checked.observe(observation, *_line_counts())
    return seen.filter(F.col("reason").isNull()).drop("reason")
