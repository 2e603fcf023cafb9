"""Honeypot session tables and the block list."""

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from emberwatch.functions.honeypot import commands, login_attempts, sessionize
from emberwatch.schemas import (
    BLOCK_CHANGE,
    SESSION,
    SESSION_COMMAND,
    SESSION_LOGIN,
    conform,
)
from emberwatch.session import remove_folder


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return conform(spark.read.parquet(path), schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def session_tables(honeypot: DataFrame) -> dict[str, DataFrame]:
    """Sessions, logins and commands of a honeypot event table."""
    return {
        "sessions": conform(sessionize(honeypot), SESSION),
        "session_logins": conform(login_attempts(honeypot), SESSION_LOGIN),
        "session_commands": conform(commands(honeypot), SESSION_COMMAND),
    }


#: The columns whose first time puts a row into its day.
TIMES = {
    "sessions": ["start_time", "end_time"], "session_logins": ["timestamp"], "session_commands": ["ran_at"],
}
NO_DAY = "1970-01-01"


def _day(*times: str) -> Column:
    """The day of a row, never NULL, so that days can be compared by equality and pruned."""
    return F.to_date(F.coalesce(*times, F.lit(NO_DAY).cast("timestamp")))


def not_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose values are not stored yet. The line number is not compared: it counts from the
    start of a scan, so a line has another one in the next scan."""
    same = " and ".join(f"new.{n} {'=' if n == 'day' else '<=>'} old.{n}" for n in rows.columns if n != "seq")
    return rows.alias("new").join(stored.alias("old"), F.expr(same), "left_anti")


def unstored(spark: SparkSession, honeypot: DataFrame, folder: str) -> dict[str, DataFrame]:
    """What an event table says that is not stored yet, of every table, with its day.

    Equal rows have one day, so only the days that the events touch are read of the store; they are
    as many as there are days in the events.
    """
    days = [r.day for r in honeypot.select(_day("ts").alias("day")).distinct().collect()]
    days = F.col("day").isin([F.lit(d) for d in {*days, date.fromisoformat(NO_DAY)}])
    new = {}
    for name, rows in session_tables(honeypot).items():
        stored = _with_days(spark, f"{folder}/{name}", rows.schema).filter(days)
        new[name] = not_stored(rows.withColumn("day", _day(*TIMES[name])), stored)
    return new


def _with_days(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_table(spark, path, StructType([*schema, StructField("day", DateType())]))


def store_sessions(spark: SparkSession, honeypot: DataFrame, folder: str) -> None:
    """Append what is new, by day: logins and commands, also of sessions stored before, and the
    session rows that say something new, such as the close of a session that an earlier run saw open.

    Nothing stored is written again, so a run that dies in between is simply repeated: each table is
    compared with itself. Rows are gathered by day, and the rebalance splits a day with most rows. A
    table starts with a file without rows, so that one without rows differs from one that lost its files.
    """
    for name, rows in unstored(spark, honeypot, folder).items():
        empty = spark.createDataFrame([], rows.drop("day").schema)
        empty.write.mode("ignore").parquet(f"{folder}/{name}/day={NO_DAY}")
        rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{folder}/{name}")


def read_sessions(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored tables, with one row per session made of all that was stored about it."""
    sessions = read_table(spark, f"{folder}/sessions", SESSION)
    closed = F.max(F.struct("end_time", "duration_ms"))
    whole = sessions.groupBy("session_id").agg(
        F.min("src_ip").alias("src_ip"),
        F.min("start_time").alias("start_time"),
        closed["end_time"].alias("end_time"),
        closed["duration_ms"].alias("duration_ms"),
    )
    return {
        "sessions": whole,
        "session_logins": read_table(spark, f"{folder}/session_logins", SESSION_LOGIN),
        "session_commands": read_table(spark, f"{folder}/session_commands", SESSION_COMMAND),
    }


def newest_sessions(sessions: DataFrame, src_ip: str | None = None) -> DataFrame:
    """Sessions of one address, newest first; without an address all of them, by address."""
    if src_ip is not None:
        return sessions.filter(F.col("src_ip") == src_ip).orderBy(F.desc("start_time"), "session_id")
    return sessions.orderBy("src_ip", F.desc("start_time"), "session_id")


def oldest_commands(session_commands: DataFrame, session_id: str | None = None) -> DataFrame:
    """Commands of one session in the order typed; without a session all of them, by session."""
    if session_id is not None:
        return session_commands.filter(F.col("session_id") == session_id).orderBy("ran_at", "seq")
    return session_commands.orderBy("session_id", "ran_at", "seq")


def logins_per_address(sessions: DataFrame, logins: DataFrame) -> DataFrame:
    """Login attempts per address. Logins are counted per session before the join, so a session
    with very many of them joins as one row."""
    per_session = logins.groupBy("session_id").agg(F.count("*").alias("n"))
    return (
        per_session.join(sessions.select("session_id", "src_ip"), "session_id")
        .groupBy("src_ip")
        .agg(F.sum("n").alias("attempt_count"))
    )


def block_counts(sessions: DataFrame, logins: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Sessions and login attempts per address, as recorded when an address is blocked.

    With `addresses` (`ip`) only theirs: the sessions of other addresses, and the logins of those, go
    before anything is counted.
    """
    sessions = sessions.select("session_id", "src_ip")
    if addresses is not None:
        sessions = sessions.join(addresses.select(F.col("ip").alias("src_ip")), "src_ip", "left_semi")
        logins = logins.join(sessions, "session_id", "left_semi")
    per_session = logins.groupBy("session_id").agg(F.count("*").alias("n"))
    return (
        sessions.join(per_session, "session_id", "left")
        .groupBy("src_ip")
        .agg(
            F.count("*").alias("session_count"),
            F.sum(F.coalesce("n", F.lit(0))).alias("attempt_count"),
        )
    )


def block(
    addresses: DataFrame,
    sessions: DataFrame,
    logins: DataFrame,
    reason: str,
    blocked_by: str = "manual",
    at: Column | None = None,
) -> DataFrame:
    """Block rows for the `ip` column of `addresses`, with the counts known now."""
    if blocked_by not in ("manual", "auto"):
        raise ValueError("blocked_by must be 'manual' or 'auto'")
    counts = block_counts(sessions, logins, addresses).withColumnRenamed("src_ip", "ip")
    return conform(
        addresses.select("ip")
        .distinct()
        .join(counts, "ip", "left")
        .na.fill(0, ["attempt_count", "session_count"])
        .withColumn("changed_at", F.current_timestamp() if at is None else at)
        .withColumn("blocked", F.lit(True))
        .withColumn("reason", F.lit(reason))
        .withColumn("blocked_by", F.lit(blocked_by)),
        BLOCK_CHANGE,
    )


def unblock(addresses: DataFrame, at: Column | None = None) -> DataFrame:
    return conform(
        addresses.select("ip")
        .distinct()
        .withColumn("changed_at", F.current_timestamp() if at is None else at)
        .withColumn("blocked", F.lit(False)),
        BLOCK_CHANGE,
    )


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each address; of two at one time the block counts."""
    columns = [f.name for f in BLOCK_CHANGE if f.name != "ip"]
    return (
        changes.groupBy("ip")
        .agg(F.max_by(F.struct(*columns), F.struct("changed_at", "blocked")).alias("c"))
        .select("ip", "c.*")
    )


def blocked_list(changes: DataFrame) -> DataFrame:
    """Addresses blocked now, newest first: the last change of each address decides."""
    return (
        last_changes(changes)
        .filter("blocked")
        .select(
            "ip", F.col("changed_at").alias("blocked_at"), "attempt_count", "session_count",
            "reason", "blocked_by",
        )
        .orderBy(F.desc("blocked_at"), "ip")
    )


def append_changes(changes: DataFrame, folder: str) -> None:
    """Append blocks and unblocks to the log of a block list, as a folder of their own."""
    conform(changes, BLOCK_CHANGE).write.parquet(f"{folder}/log-{uuid.uuid4().hex}")


def block_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What a block list is made of: its snapshot, with one row for each address, and its log."""
    parts = _parts(spark, folder)
    if not parts:
        return spark.createDataFrame([], BLOCK_CHANGE)
    return conform(spark.read.schema(BLOCK_CHANGE).parquet(*parts), BLOCK_CHANGE)


def compact_changes(spark: SparkSession, folder: str) -> None:
    """Make one snapshot of the snapshot and the log, then remove what went into it.

    The last change decides, so a change that stands in a snapshot and in a log counts once: a
    compaction that dies, a reader in between and a log that is appended meanwhile leave the list right.
    Unblocked addresses stay, or an older block that is appended late would come back.
    """
    parts = _parts(spark, folder)
    if not parts:
        return
    merged = last_changes(conform(spark.read.schema(BLOCK_CHANGE).parquet(*parts), BLOCK_CHANGE))
    conform(merged, BLOCK_CHANGE).write.parquet(f"{folder}/snapshot-{uuid.uuid4().hex}")
    for part in parts:
        remove_folder(spark, part)


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The folders of a block list that were written to their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    home = hadoop.Path(folder)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(home):
        return []
    found = [status.getPath() for status in system.listStatus(home)]
    return sorted(p.toString() for p in found if system.exists(hadoop.Path(p, "_SUCCESS")))


def blocked_only(rows: DataFrame, changes: DataFrame, address: str = "src_ip") -> DataFrame:
    """Rows whose address is blocked now."""
    blocked = blocked_list(changes).select(F.col("ip").alias(address))
    return rows.join(blocked, address, "left_semi")
