"""First alerts of their keys with some of their columns."""

from datetime import datetime

from emberwatch.operators.dedup import keep_first, new_alerts
from emberwatch.schemas import ALERT


def _alert(rule_id, key, order, seq, extra=None, source="auditd"):
    at = datetime(2024, 1, 1)
    return (
        None, rule_id, "T1", "HIGH", at, at, None, "1.1.1.1", None, None, f"text {seq}", None, source, key, extra,
        order and (1, 2, *order),
    )


def _alerts(spark):
    rows = [
        _alert("r", "a", (5, 1), 1, source="x"), _alert("r", "a", (4, 9), 2, source="y"),
        _alert("r", "a", (None, 3), 3, source=None), _alert("r", None, (1, None), 4, {"auid": "7"}),
        _alert("r", "", (1, 2), 5, {"auid": "7"}, source="z"), _alert("q", "a", (0, 0), 6), _alert("q", "n", None, 7),
    ]
    return spark.createDataFrame(rows, ALERT)


def _texts(rows):
    return sorted(map(str, rows))


def test_columns_of_the_first_alerts_are_those_of_whole_ones(spark):
    alerts = _alerts(spark)
    whole = keep_first(alerts)
    assert whole.columns == alerts.columns
    some = keep_first(alerts, ["log_source", "ord"])
    assert some.columns == ["alert_key", "log_source", "ord"]
    assert _texts(some.drop("alert_key").collect()) == _texts(whole.select("log_source", "ord").collect())
    found = {r.alert_key: r.log_source for r in some.collect()}
    assert found == {"r:a": None, "r:1.1.1.1:None:7": "auditd", "q:a": "auditd", None: None}
    history = alerts.where("rule_id = 'q'")
    fresh = new_alerts(alerts, keep_first(history, ["ord"]), ["ord"])
    assert _texts(fresh.select("ord").collect()) == _texts(new_alerts(alerts, keep_first(history)).select("ord").collect())
    assert fresh.count() == 3


def test_sort_holds_no_column_that_is_not_asked_for(spark, tmp_path):
    _alerts(spark).write.parquet(str(tmp_path / "alerts"))
    some = keep_first(spark.read.parquet(str(tmp_path / "alerts")), ["log_source", "ord"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "severity" not in plan


def test_a_task_reads_a_small_piece(spark):
    """What a task sorts stays the same when the input grows."""
    from emberwatch.session import configure

    assert configure(spark).conf.get("spark.sql.files.maxPartitionBytes") == "16m"
