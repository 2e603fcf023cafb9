"""Authentication log lines to typed events, as column expressions."""

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from emberwatch import constants as K
from emberwatch.functions.addresses import is_address
from emberwatch.functions.text import SPACE, strip
from emberwatch.functions.times import (
    iso_offset_text,
    iso_offset_time,
    syslog_text,
    syslog_time,
)
from emberwatch.schemas import AUTH_EVENT, conform


@dataclass(frozen=True)
class Normalized:
    """Typed events and the lines that could not be typed (source, raw, seq, reason).

    `checked` has both, events with a NULL `reason`, for what looks at every line in one pass.
    """

    events: DataFrame
    rejects: DataFrame
    checked: DataFrame

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.events, self.rejects))


def parsed_once(parsed: DataFrame, schema) -> DataFrame:
    """The columns of `schema` and `reason`, behind a one-row generator.

    A filter on a parsed column would otherwise be pushed below the parsing and run the patterns
    a second time.
    """
    missing = [f for f in schema if f.name not in parsed.columns]
    columns = [
        (F.lit(None) if f in missing else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return parsed.select(F.inline(F.array(F.struct(*columns, "reason"))))


def split_rejects(parsed: DataFrame, source: str, schema, once: bool = True) -> Normalized:
    """`parsed` carries the event columns and `reason`, NULL for good rows.

    `once` is for parsers whose patterns would run again in a pushed-down filter; without it,
    columns nobody asks for are not computed.
    """
    rows = parsed_once(parsed, schema) if once else parsed
    events = conform(rows.filter(F.col("reason").isNull()), schema)
    rejects = rows.filter(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"), "raw", "seq", "reason"
    )
    return Normalized(events, rejects, conform(rows, StructType([*schema, StructField("reason", StringType())])))


def auth_header(lines: DataFrame) -> DataFrame:
    """Adds the time texts, hostname, process and pid; tokens shift with the time format."""
    line = F.col("line")
    staged = (
        lines.withColumn("iso_text", iso_offset_text(line))
        .withColumn("iso", F.col("iso_text") != "")
        .withColumn("tokens", F.split(line, f"{SPACE}+", 6))
        .withColumn("at", F.when(F.col("iso"), F.lit(2)).otherwise(F.lit(4)))
        .withColumn("token", F.coalesce(F.try_element_at("tokens", F.col("at") + 1), F.lit("")))
        .withColumn("bare", F.rtrim("token", F.lit(":")))
        .withColumn("tag", F.split_part("bare", F.lit("["), F.lit(2)))
    )
    return staged.select(
        "*",
        F.coalesce(F.try_element_at("tokens", "at"), F.lit("")).alias("hostname"),
        F.substring_index("bare", "[", 1).alias("process"),
        F.rtrim("tag", F.lit("]")).try_cast("int").alias("pid"),
    )


def auth_fields(lines: DataFrame) -> DataFrame:
    """First matching class wins: failed, accepted, new user, sudo, other.

    A cheap substring test guards every pattern, so most lines never reach the regex engine. A
    login pattern is matched once: its text ends in `USER from ADDRESS port NUMBER`, and none of
    the three holds a blank.
    """
    line = F.col("line")

    def matched(text, pattern, index):
        return F.when(line.contains(text), F.regexp_extract(line, pattern, index)).otherwise("")

    failed, accepted = F.col("failed"), F.col("accepted")
    return (
        lines.withColumn("failed", matched("Failed password for ", K.AUTH_FAILED, 0))
        .withColumn("accepted", matched("Accepted p", K.AUTH_ACCEPTED, 0))
        .withColumn("added", matched("new user", K.AUTH_NEW_USER, 1))
        .withColumn("sudo_by", matched("COMMAND=", K.AUTH_SUDO, 1))
        .withColumn(
            "kind",
            F.when(failed != "", F.lit("failed"))
            .when(accepted != "", F.lit("accepted"))
            .when(F.col("added") != "", F.lit("new_user"))
            .when(F.col("sudo_by") != "", F.lit("sudo"))
            .otherwise(F.lit("other")),
        )
        .withColumn(
            "login",
            F.when(F.col("kind") == "failed", F.split(failed, " ")).when(
                F.col("kind") == "accepted", F.split(accepted, " ")
            ),
        )
        .select(
            "*",
            F.when(F.col("login").isNotNull(), F.col("kind")).alias("auth_result"),
            F.try_element_at("login", F.lit(-5)).alias("username"),
            F.try_element_at("login", F.lit(-3)).alias("source_ip"),
            F.try_element_at("login", F.lit(-1)).try_cast("int").alias("port"),
            F.when(F.col("kind") == "failed", F.lit("password")).alias("auth_method"),
            F.when(F.col("kind") == "new_user", F.col("added")).alias("new_username"),
            F.when(F.col("kind") == "sudo", F.col("sudo_by")).alias("sudo_user"),
            F.when(
                F.col("kind") == "sudo", strip(F.regexp_extract(line, K.AUTH_SUDO, 3))
            ).alias("sudo_command"),
        )
    )


def parse_auth(lines: DataFrame, year=None) -> DataFrame:
    """All auth columns plus `reason` for rejects. `lines` has `value` and `seq`."""
    year = F.year(F.current_date()) if year is None else F.lit(year)
    trimmed = lines.select("seq", F.col("value").alias("raw"), strip(F.col("value")).alias("line"))
    typed = auth_fields(auth_header(trimmed.filter("line != ''")))
    timed = typed.withColumn(
        "sys_text", F.when(F.col("iso"), F.lit("")).otherwise(syslog_text(F.col("line")))
    ).withColumn(
        "ts",
        F.when(F.col("iso"), iso_offset_time(F.col("iso_text"))).otherwise(
            syslog_time(F.col("sys_text"), year)
        ),
    )
    return timed.select(
        "*",
        F.lit(K.AUTH_LOG).alias("source"),
        F.create_map().cast("map<string,string>").alias("extra"),
        F.when(F.col("ts").isNull(), F.lit("bad time"))
        .when(
            F.col("source_ip").isNotNull() & ~is_address(F.col("source_ip")),
            F.lit("bad address"),
        )
        .alias("reason"),
    )


def normalize_auth(lines: DataFrame, year=None) -> Normalized:
    return split_rejects(parse_auth(lines, year), K.AUTH_LOG, AUTH_EVENT)
