"""Alert deduplication: within a batch and against the stored history."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import or_none


def dedup_key() -> Column:
    """`rule:key`, or rule, address, user and audit id where a rule sets no key. Never NULL."""
    own = F.when(F.col("dedup_key") != "", F.concat_ws(":", "rule_id", "dedup_key"))
    fallback = F.concat(
        F.col("rule_id"), F.lit(":"), or_none(F.col("source_ip")), F.lit(":"),
        or_none(F.col("username")), F.lit(":"),
        F.when(F.map_contains_key("extra", F.lit("auid")), or_none(F.col("extra")["auid"]))
        .otherwise(F.lit("")),
    )
    return F.coalesce(own, fallback)


def keep_first(alerts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The first alert of each key in `ord` order; with `columns`, its `alert_key` and only these.

    An aggregate and not a window: a key repeated in every line shrinks to one row per task
    before the shuffle. A task sorts its rows for that, so they hold no more than is asked for.
    """
    if columns is None:
        return _first(alerts, alerts.columns).drop("_key")
    return _first(alerts, columns).withColumnRenamed("_key", "alert_key")


def _first(alerts: DataFrame, columns: list[str]) -> DataFrame:
    others = [name for name in columns if name != "ord"]
    found = (
        alerts.withColumn("_key", dedup_key())
        .groupBy("_key")
        .agg(F.min_by(F.struct(*others), "ord").alias("a"), F.min("ord").alias("ord"))
    )
    # Alerts without an order have no first one.
    key = F.when(F.col("ord").isNotNull(), F.col("_key")).alias("_key")
    return found.select(key, *[F.col(n if n == "ord" else f"a.{n}") for n in columns])


def new_alerts(alerts: DataFrame, history: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First alert of each key that is not in the history yet. `columns` as in `keep_first`; a history with
    an `alert_key` is compared by it."""
    key = F.col("alert_key") if "alert_key" in history.columns else dedup_key()
    return unknown_alerts(alerts, history.select(key.alias("alert_key")), columns)


def unknown_alerts(alerts: DataFrame, known: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First alert of each key that is not among the known ones (`alert_key`)."""
    found = keep_first(alerts, alerts.columns if columns is None else columns)
    fresh = found.join(known, "alert_key", "left_anti")
    return fresh.drop("alert_key") if columns is None else fresh


def with_run(alerts: DataFrame, run: int) -> DataFrame:
    """Stamp the run number, which orders alerts of different runs."""
    return alerts.withColumn("ord", F.col("ord").withField("run", F.lit(run).cast("bigint")))


def history_plus_new(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """History followed by the new alerts; `ord` keeps the sequence."""
    return history.unionByName(fresh)
