"""Time parsing and epoch arithmetic. All results are UTC timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.constants import ISO_TIME, SYSLOG_TIME


def iso_offset_text(line: Column) -> Column:
    """Leading ISO-8601 time with a numeric offset as text, '' when absent."""
    return F.when(F.substr(line, F.lit(5), F.lit(1)) == "-", F.regexp_extract(line, ISO_TIME, 1)).otherwise("")


def syslog_text(line: Column) -> Column:
    """Leading `Mon d HH:MM:SS` as text, '' when absent."""
    return F.regexp_extract(line, SYSLOG_TIME, 1)


def iso_offset_time(text: Column) -> Column:
    return F.when(text.rlike(r"^[^.]{19}(\.\d+)?[+-]\d{2}:\d{2}$"), F.try_to_timestamp(text))


def syslog_time(text: Column, year: Column) -> Column:
    """The text in the given year. Impossible dates give NULL."""
    stamped = F.concat(year.cast("string"), F.lit(" "), F.initcap(F.regexp_replace(text, r"\s+", " ")))
    return F.when(text != "", F.try_to_timestamp(stamped, F.lit("yyyy MMM d HH:mm:ss")))


def iso_time(text: Column) -> Column:
    """ISO-8601 with `Z`, a numeric offset, or no zone (read as UTC)."""
    shaped = text.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    )
    return F.when(shaped, F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def epoch_time(seconds_text: Column) -> Column:
    """Decimal epoch seconds as text, rounded to microseconds."""
    micros = F.round(seconds_text.try_cast("decimal(28,10)") * F.lit(1_000_000), 0)
    return F.timestamp_micros(micros.cast("bigint"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def as_utc(column: Column, data_type: str) -> Column:
    """Timestamps stay, zone-less ones are read as UTC, numbers are epoch seconds."""
    if data_type in ("timestamp", "timestamp_ntz"):
        return column.cast("timestamp")
    if data_type in ("int", "bigint", "smallint", "tinyint", "float", "double") or (
        data_type.startswith("decimal")
    ):
        return epoch_time(column.cast("decimal(28,10)").cast("string"))
    return iso_time(column.cast("string"))
