"""Honeypot JSON lines to typed events, login attempts, commands and sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.auth import Normalized, split_rejects
from emberwatch.functions.predicates import download_tools, makes_executable
from emberwatch.functions.times import iso_time
from emberwatch.schemas import HONEYPOT_EVENT, HONEYPOT_LINE


def parse_honeypot(lines: DataFrame) -> DataFrame:
    """`lines` has `value` and `seq`. Lines without a session are dropped, not rejected."""
    parsed = lines.filter(F.trim("value") != "").select(
        "seq",
        F.col("value").alias("raw"),
        F.from_json(
            "value",
            HONEYPOT_LINE,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_line"},
        ).alias("j"),
    )
    login = F.col("eventid").isin(K.POT_LOGIN_OK, K.POT_LOGIN_FAILED)
    return (
        parsed.select("seq", "raw", "j.*")
        .withColumn("broken", F.col("broken_line").isNotNull())
        .withColumnRenamed("session", "session_id")
        .withColumn("source", F.lit(K.COWRIE))
        .withColumn("ts", iso_time(F.col("timestamp")))
        .withColumn("extra", F.create_map().cast("map<string,string>"))
        .withColumn(
            "reason",
            F.when(F.col("broken"), F.lit("broken json"))
            .when(F.col("ts").isNull(), F.lit("bad time"))
            .when(F.col("eventid").isNull() | F.col("src_ip").isNull(), F.lit("missing field"))
            .when(login & (F.col("username").isNull() | F.col("password").isNull()), F.lit("missing field"))
            .when((F.col("eventid") == K.POT_COMMAND) & F.col("input").isNull(), F.lit("missing field")),
        )
        .filter(F.col("broken") | (F.coalesce(F.col("session_id"), F.lit("")) != ""))
    )


def normalize_honeypot(lines: DataFrame) -> Normalized:
    return split_rejects(parse_honeypot(lines), K.COWRIE, HONEYPOT_EVENT)


def login_attempts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("eventid").isin(K.POT_LOGIN_OK, K.POT_LOGIN_FAILED)).select(
        "session_id",
        "seq",
        "username",
        "password",
        (F.col("eventid") == K.POT_LOGIN_OK).alias("success"),
        F.col("ts").alias("timestamp"),
    )


def commands(events: DataFrame) -> DataFrame:
    return events.filter(F.col("eventid") == K.POT_COMMAND).select(
        "session_id", "seq", F.col("input").alias("command_text"), F.col("ts").alias("ran_at")
    )


def sessionize(events: DataFrame, by: list = ("session_id",)) -> DataFrame:
    """One row per session with its login and command facts.

    `by` are the grouping columns, with `session_id` among them.

    Every aggregate has a fixed-size state and a map-side part, so one huge session is as
    cheap as many small ones. The tool list holds at most the five known tools.
    """
    marked = events.select(
        "*",
        (F.col("eventid") == K.POT_CONNECT).alias("is_connect"),
        (F.col("eventid") == K.POT_CLOSED).alias("is_closed"),
        F.col("eventid").isin(K.POT_LOGIN_OK, K.POT_LOGIN_FAILED).alias("is_login"),
        (F.col("eventid") == K.POT_LOGIN_OK).alias("is_success"),
        (F.col("eventid") == K.POT_COMMAND).alias("is_command"),
    )
    tools = F.when(F.col("is_command"), download_tools(F.col("input")))
    per_event = marked.withColumn("tools", tools).withColumn(
        "chmod", F.col("is_command") & makes_executable(F.col("input"))
    )
    per_tool = [
        F.max(F.array_contains("tools", tool)).alias(f"has_{tool}")
        for tool in sorted(K.DOWNLOAD_TOOLS)
    ]
    grouped = per_event.groupBy(*by).agg(
        F.min("seq").alias("seq"),
        F.min_by("src_ip", "seq").alias("src_ip"),
        F.expr("max_by(ts, seq) FILTER (WHERE is_connect)").alias("start_time"),
        F.expr("max_by(struct(ts, duration_ms), seq) FILTER (WHERE is_closed)").alias("closed"),
        F.count_if("is_login").alias("login_attempt_count"),
        F.count_if("is_success").alias("success_count"),
        F.count_if("is_command").alias("command_count"),
        F.expr(
            "min_by(struct(ts, username, password), seq) FILTER (WHERE is_success)"
        ).alias("first_success"),
        F.coalesce(F.bool_or("chmod"), F.lit(False)).alias("chmod_x_used"),
        *per_tool,
    )
    found = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"has_{tool}"), F.lit(tool))
                for tool in sorted(K.DOWNLOAD_TOOLS)
            ]
        )
    )
    return grouped.select(
        "session_id",
        "seq",
        "src_ip",
        "start_time",
        F.col("closed.ts").alias("end_time"),
        F.col("closed.duration_ms").alias("duration_ms"),
        "login_attempt_count",
        "success_count",
        "command_count",
        "first_success",
        found.alias("download_tools"),
        "chmod_x_used",
    )
