"""Queries against their SQL on the smallest data, and the shape of the plans."""

import os

import duckdb
import pytest

from check import TABLES, rows
from emberwatch.plans.queries import QUERIES, SQL, Logs
from emberwatch.plans.rules import rule_book
from emberwatch import constants as K

FOLDER = "/root/testdata/sf0.001"
FAST = [
    "src_3", "nrm_3", "nrm_5", "nrm_7", "nrm_8", "nrm_11", "det_001", "det_007", "det_012",
    "det_014", "det_015", "agg_1", "agg_5", "agg_8", "agg_10", "agg_11", "win_1", "set_3", "srt_4",
    "vw_1", "sig_001", "sig_002", "sig_012", "str_3", "str_4", "str_6", "str_7", "udf_1",
]
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = rows(frame.columns, frame.collect())
    result = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert got == rows(result.columns, result.fetchall())
    assert got


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_rule_plans_stay_in_the_jvm(spark):
    logs = Logs(spark, FOLDER)
    for rule in rule_book().rules.values():
        plan = rule.run(logs.events(rule.source))._jdf.queryExecution().executedPlan().toString()
        for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoop"):
            assert node not in plan, (rule.name, node)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "audit")
    Logs(spark, FOLDER).audit.events.write.parquet(path)
    events = spark.read.parquet(path)
    plan = rule_book().rules["det_011"].run(events)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(key,{K.SUDOERS_KEY})" in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "raw" not in scan.split("ReadSchema")[1] and "extra" not in scan.split("ReadSchema")[1]


def test_stateless_rules_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "cloud")
    Logs(spark, FOLDER).cloud.events.write.parquet(path)
    plan = rule_book().run_source(K.CLOUDTRAIL, spark.read.parquet(path))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_pairs_of_a_line_are_taken_apart_once(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 9} 00:00:00", i % 3, "error") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts STRING, user_id BIGINT, event_type STRING")
    events.selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type").write.parquet(
        str(tmp_path / "events.parquet")
    )
    pairs = QUERIES["nrm_5"](spark, str(tmp_path))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert pairs.filter("seq = 0 and k = 'ses'").first()["v"] == "2"
    # A line without any pair in lower case has no rows.
    assert pairs.filter("k is null").isEmpty()


def test_only_grown_audit_logs_are_written_again(spark, tmp_path, monkeypatch):
    from pyspark.sql.utils import AnalysisException

    from emberwatch.plans import queries as Q

    columns = ["id AS event_id", "timestamp_seconds(1704844800 + id * 600) AS ts", "id % 7 AS user_id", "'error' AS event_type"]
    spark.range(2000).selectExpr(*columns).write.parquet(str(tmp_path / "events.parquet"))
    written = []
    monkeypatch.setattr(Q, "_write_logs", lambda lines, folder, host: written.append(lines.select(host.alias("h"))))
    monkeypatch.setattr("emberwatch.streaming.run.run_available", lambda *_: None)
    with pytest.raises(AnalysisException):  # no stream has run, so there is nothing to read
        QUERIES["str_7"](spark, str(tmp_path))
    assert len(written) == 4 and written[3].distinct().count() == 1
