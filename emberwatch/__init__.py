"""Security-log analytics on Spark: normalise, detect, deduplicate, report."""

__version__ = "0.1.0"
