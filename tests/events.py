"""Small typed tables of events, built from a few fields each."""

from datetime import datetime, timedelta

START = datetime(2026, 1, 15, 10, 30, 0)


def at(seconds):
    return START + timedelta(seconds=seconds)


def table(spark, schema, defaults, rows):
    """Typed events from a few fields each; `seq` is the place in the list."""
    full = [{"ts": START, "raw": "line", "extra": {}, "seq": i, **defaults, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in full], schema)
