"""Failures followed by a success from the same address within a time limit."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failures_by_address(auth: DataFrame) -> DataFrame:
    """Per address: number of failures, first and last one in (time, line) order."""
    failed = auth.filter((F.col("auth_result") == "failed") & F.col("source_ip").isNotNull())
    return failed.groupBy("source_ip").agg(
        F.count("*").alias("failures"),
        F.min("ts").alias("first_failure"),
        F.max("ts").alias("last_failure"),
    )


def success_after_failures(auth: DataFrame, threshold: int, window_seconds: int) -> DataFrame:
    """Every accepted login 0 to W seconds after the last failure of its address."""
    return matches(auth, failures_by_address(auth), threshold, window_seconds)


def matches(
    auth: DataFrame, failures: DataFrame, threshold: int, window_seconds: int
) -> DataFrame:
    """Accepted logins against failures per address.

    There is one row per address on the failure side. A match lies in the time slot of the last
    failure or the next one, so both sides also join on the slot: the logins of one busy address
    spread over tasks by time.
    """
    width = int(window_seconds) * 1_000_000
    slot = lambda t: ((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("bigint")
    slotted = (
        failures.filter(F.col("failures") >= threshold)
        .withColumn("last_t", F.unix_micros("last_failure"))
        .withColumn("slot", F.explode(F.array(slot(F.col("last_t")), slot(F.col("last_t")) + 1)))
    )
    accepted = (
        auth.filter((F.col("auth_result") == "accepted") & F.col("source_ip").isNotNull())
        .select("source_ip", "username", "seq", F.col("ts").alias("success_time"))
        .withColumn("t", F.unix_micros("success_time"))
        .withColumn("slot", slot(F.col("t")))
    )
    return (
        accepted.join(slotted, ["source_ip", "slot"])
        .withColumn("gap", F.col("t") - F.col("last_t"))
        .filter((F.col("gap") >= 0) & (F.col("gap") <= width))
        .select(
            "source_ip", "username", "seq", "failures", "first_failure", "last_failure",
            "success_time", "gap",
        )
    )


def success_at_login(
    auth: DataFrame, threshold: int, window_seconds: int, known: DataFrame | None = None,
    chunk_seconds: int = 86_400,
) -> DataFrame:
    """Every accepted login 0 to W seconds after the last failure of its address before it, with
    the failures up to the login (those of the same moment included).

    Unlike `success_after_failures`, later failures change nothing, so a stream can answer as soon
    as the login's time has passed. `known` has what `failures_by_address` found in earlier rows.
    Addresses are cut into time chunks: one row per chunk carries the count of the chunks before
    it, so no address is sorted as a whole.
    """
    failed = F.col("auth_result") == "failed"
    rows = (
        auth.filter(F.col("auth_result").isin("failed", "accepted") & F.col("source_ip").isNotNull())
        .withColumn("t", F.unix_micros("ts"))
        .withColumn("chunk", F.floor(F.col("t") / F.lit(int(chunk_seconds) * 1_000_000)).cast("bigint"))
    )
    chunks = rows.groupBy("source_ip", "chunk").agg(
        F.count_if(failed).alias("failures"),
        F.min(F.when(failed, F.col("ts"))).alias("first_failure"),
        F.max(F.when(failed, F.col("ts"))).alias("last_failure"),
    )
    if known is not None:
        first = F.lit(-(1 << 62)).cast("bigint").alias("chunk")
        chunks = chunks.unionByName(known.select("*", first))
    earlier = Window.partitionBy("source_ip").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        "source_ip",
        "chunk",
        F.coalesce(F.sum("failures").over(earlier), F.lit(0)).alias("n_before"),
        F.min("first_failure").over(earlier).alias("first_before"),
        F.max("last_failure").over(earlier).alias("last_before"),
    )
    upto = Window.partitionBy("source_ip", "chunk").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.select(
        "source_ip",
        "chunk",
        "username",
        "seq",
        "auth_result",
        "t",
        F.col("ts").alias("success_time"),
        F.count_if(failed).over(upto).alias("n_inside"),
        F.min(F.when(failed, F.col("ts"))).over(upto).alias("first_inside"),
        F.max(F.when(failed, F.col("ts"))).over(upto).alias("last_inside"),
    ).filter("auth_result = 'accepted'")
    return (
        inside.join(carried, ["source_ip", "chunk"])
        .withColumn("failures", F.col("n_before") + F.col("n_inside"))
        .withColumn("first_failure", F.least("first_before", "first_inside"))
        .withColumn("last_failure", F.greatest("last_before", "last_inside"))
        .withColumn("gap", F.col("t") - F.unix_micros("last_failure"))
        .filter((F.col("failures") >= threshold) & (F.col("gap") <= int(window_seconds) * 1_000_000))
        .select(
            "source_ip", "username", "seq", "failures", "first_failure", "last_failure",
            "success_time", "gap",
        )
    )
