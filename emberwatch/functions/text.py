"""Text helpers: Python-style trimming, path parts and message formatting as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators 0x1c-0x1f count as white space in the log tools, but not in Java's \s.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def or_none(value: Column) -> Column:
    """The text of a value inside a message or key: missing values read 'None'."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def message(template: str, *values: Column) -> Column:
    """Fill the `{}` places of a template; missing values read 'None'."""
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError("template places and values differ in number")
    pieces = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:]):
        pieces.append(or_none(value))
        if text:
            pieces.append(F.lit(text))
    return F.concat(*pieces)


def whole_seconds(micros: Column) -> Column:
    """Seconds without decimals, ties to the even number."""
    return F.bround(micros / F.lit(1_000_000.0), 0).cast("bigint").cast("string")


def time_text(ts: Column) -> Column:
    """`2026-01-15 10:00:20+00:00`, with six decimals only when they are not zero."""
    plain = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(plain, fraction, F.lit("+00:00"))


def quoted_set(values: Column) -> Column:
    """`{'a', 'b'}` from an array, in sorted order."""
    quoted = F.transform(F.array_sort(values), lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def one_of(text: Column, values) -> Column:
    """True when the text is one of a few constants; NULL reads as no."""
    return F.coalesce(text.isin(list(values)), F.lit(False))
