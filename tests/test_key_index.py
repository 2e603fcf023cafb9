import os
import re

import pytest
from pyspark.sql import functions as F

from emberwatch.operators.dedup import dedup_key, unknown_alerts, with_run
from emberwatch.plans.rules import rule_book
from emberwatch.sources import alert_store
from emberwatch.sources.key_index import KeyIndex


def keys(spark, run, *values):
    return spark.createDataFrame([(v, run) for v in values], "alert_key STRING, run BIGINT")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges_over_index(frame):
    """Exchanges that have the index below them: a line of the plan that is an exchange and is followed, deeper, by
    the scan of the table."""
    lines = plan(frame).splitlines()
    depth = lambda line: len(re.match(r"[ :+\-|*()0-9]*", line)[0])
    (scan,) = [i for i, line in enumerate(lines) if "keys_" in line and "Scan" in line]
    found, level = 0, depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            found += "Exchange" in line
    return found


def test_known_keys_do_not_move(spark, audit, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), buckets=16)
    assert index.newest() is None and index.keys().count() == 0
    alerts = rule_book().rules["det_011"].run(
        audit(dict(key="sudoers_tamper"), dict(key="sudoers_tamper", exe="/bin/x"))
    )
    first, second = sorted(r.k for r in alerts.select(dedup_key().alias("k")).collect())
    index.add(keys(spark, 1, first, "else"))
    index.add(keys(spark, 2, *map(str, range(100))))
    fresh = unknown_alerts(alerts, index.keys())
    assert [r.k for r in fresh.select(dedup_key().alias("k")).collect()] == [second]
    assert "SortMergeJoin" in plan(fresh) and "SelectedBucketsCount: 16 out of 16" in plan(fresh)
    assert exchanges_over_index(fresh) == 0
    assert exchanges_over_index(index.keys().groupBy(F.length("alert_key")).count()) == 1


def test_compaction_keeps_the_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), buckets=4)
    for run in (1, 2, 3):
        index.add(keys(spark, run, *map(str, range(run * 50))))
    index.compact()
    assert sorted(int(r.alert_key) for r in index.keys().collect()) == list(range(150))
    assert index.keys(before=2).count() == 50
    assert len([f for f in os.listdir(index.folder) if f.endswith(".parquet")]) == 4
    index.compact(buckets=8)
    again = KeyIndex(spark, str(tmp_path / "keys"))
    assert (again.generation, again.buckets, again.keys().count(), again.newest()) == (2, 8, 150, 3)
    assert os.listdir(tmp_path / "keys") == ["gen-2-buckets-8"]


def test_half_written_generation_does_not_count(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), buckets=4)
    index.add(keys(spark, 1, "a"))
    (tmp_path / "keys" / "gen-1-buckets-4").mkdir()
    (tmp_path / "keys" / "gen-1-buckets-4" / "part-0.parquet").write_bytes(b"half")
    again = KeyIndex(spark, str(tmp_path / "keys"))
    assert again.generation == 0 and again.keys().count() == 1
    again.compact()
    assert again.generation == 1 and again.keys().count() == 1


def test_run_that_died_before_it_indexed(spark, audit, tmp_path):
    path = str(tmp_path / "alerts")
    rule = rule_book().rules["det_011"]
    one, two = rule.run(audit(dict(key="sudoers_tamper"))), rule.run(audit(dict(key="sudoers_tamper", exe="/bin/x")))
    alert_store.store_new_alerts(spark, one, path, 1)
    alert_store.append_alerts(with_run(two, 2), path)
    alert_store.store_new_alerts(spark, one.unionByName(two), path, 3)
    assert sorted(r.ord.run for r in alert_store.load_alerts(spark, path).collect()) == [1, 2]
    with pytest.raises(ValueError):
        alert_store.store_new_alerts(spark, one, path, 1)


def test_history_without_an_index_gets_one(spark, audit, tmp_path):
    path = str(tmp_path / "alerts")
    one = rule_book().rules["det_011"].run(audit(dict(key="sudoers_tamper")))
    alert_store.append_alerts(one, path)
    alert_store.store_new_alerts(spark, one, path, 5)
    assert alert_store.load_alerts(spark, path).count() == 1


def test_repeated_keys_are_reduced_before_they_move(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), buckets=4)
    index.add(keys(spark, 3, *["a"] * 50, "b").union(keys(spark, 5, "a")))
    assert sorted(map(tuple, spark.table(index.table).collect())) == [("a", 3), ("a", 5), ("b", 3)]
    assert index.newest() == 5 and index.keys(before=4).count() == 2
