"""The whole report against its SQL: every section with every field, in memory and written."""

import json
import os

import duckdb
import pytest

from check import TABLES, rows
from emberwatch.plans import reports as R
from emberwatch.plans.queries import QUERIES, SQL, Logs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables not present")
TIMES = {"first_seen", "last_seen"}
SECTIONS = {
    "summary": {"coverage_percent", "source_counts", "generated_at", "severity_counts", "total_alerts"},
    "techniques": {"name", "detected", "status", "alert_count"},
    "attacker_ips": {"attempts", "attack_speed"} | TIMES,
    "alerts": {"technique", "severity", "timestamp", "first_seen", "description", "log_source", "extra"},
    "auid_alert_counts": {"alert_count"},
    "user_technique_map": {"techniques"},
    "privilege_escalations": {"auid", "euid", "technique", "comm", "timestamp"},
    "ssh_attackers": TIMES,  # here each address's last alert is of the honeypot, which counts no attempts
}


def test_report_has_every_section_and_field(spark):
    alerts = Logs(spark, FOLDER).stored_alerts
    fields, count = {}, {}
    for section, _, value in R.full_report(alerts).collect():
        fields.setdefault(section, set()).update(json.loads(value))
        count[section] = count.get(section, 0) + 1
    assert set(fields) == set(SECTIONS)
    assert {s: SECTIONS[s] - fields[s] for s in SECTIONS} == {s: set() for s in SECTIONS}
    assert count["alerts"] == alerts.count() and count["attacker_ips"] == R.attacker_list(alerts).count()


@pytest.mark.parametrize("name", ["vw_5", "vw_7", "snk_2", "snk_5"])
def test_query(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    got, result = rows(frame.columns, frame.collect()), duck.sql(SQL[name])
    want = rows(result.columns, result.fetchall())
    assert sorted(frame.columns) == sorted(result.columns) and got
    assert not set(got) ^ set(want) and got == want


def test_summary_counts_sources_of_registered_rules(spark):
    alerts = spark.createDataFrame(
        [("T1548", "HIGH", "vpn"), ("T1548", "LOW", "vpn"), ("T1036", "HIGH", "auditd"), ("T1036", "HIGH", None)],
        "technique STRING, severity STRING, log_source STRING",
    )
    found = R.summary_view(alerts).first()
    assert found.total_alerts == 4 and list(found.source_counts.items()) == [("auditd", 1), ("vpn", 2)]
    assert R.summary_view(alerts.limit(0)).first().source_counts == {}


def test_alerts_are_sorted_before_they_are_displayed(spark):
    schema = (
        "alert_id STRING, rule_id STRING, technique STRING, severity STRING, timestamp TIMESTAMP, first_seen TIMESTAMP,"
        " last_seen TIMESTAMP, description STRING, raw_log STRING, log_source STRING, dedup_key STRING,"
        " source_ip STRING, username STRING, extra MAP<STRING,STRING>, ord STRUCT<run: BIGINT, seq: BIGINT>"
    )
    made = [("LOW", 1), ("HIGH", 3), ("CRITICAL", 4), ("HIGH", 2)]
    row = lambda s, n: (None, "r", "T1036", s, *[None] * 9, {"exe": f"/x{n}"}, (0, n))
    view = R.alerts_view(spark.createDataFrame([row(*x) for x in made], schema))
    assert [(r.severity, r.exe) for r in view.collect()] == [
        ("CRITICAL", "/x4"), ("HIGH", "/x2"), ("HIGH", "/x3"), ("LOW", "/x1"),
    ]
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert "[exe]" in plan.partition("Sort [")[0] and "[exe]" not in plan.partition("Sort [")[2]
