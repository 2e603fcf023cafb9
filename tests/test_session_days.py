import os
import re

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.schemas import BLOCK_CHANGE, conform
from emberwatch.sources import session_store
from events import at

DAY = 86_400


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def login(session, seconds):
    return dict(session_id=session, ts=at(seconds), username="u", password="p", eventid=K.POT_LOGIN_FAILED)


def test_only_the_days_of_the_batch_are_read(spark, honeypot, tmp_path):
    folder = str(tmp_path / "sessions")
    session_store.store_sessions(spark, honeypot(login("a", 0), login("b", DAY), login("c", 2 * DAY)), folder)
    days = sorted(n for n in os.listdir(f"{folder}/session_logins") if n.startswith("day="))
    assert [d[4:] for d in days] == [session_store.NO_DAY, "2026-01-15", "2026-01-16", "2026-01-17"]
    new = session_store.unstored(spark, honeypot(login("b", DAY), login("b", DAY + 1)), folder)["session_logins"]
    assert [r.timestamp for r in new.collect()] == [at(DAY + 1)]
    # The days of the batch and the one of rows without a time are a condition on the folders.
    (filters,) = set(re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(new)))
    assert set(re.findall(r"\d{4}-\d\d-\d\d", filters)) == {session_store.NO_DAY, days[2][4:]}


def test_rows_without_a_time_are_stored_once(spark, honeypot, tmp_path):
    folder = str(tmp_path / "sessions")
    events = honeypot(dict(session_id="a", username="u", eventid=K.POT_LOGIN_FAILED, ts=None))
    for _ in range(2):
        session_store.store_sessions(spark, events, folder)
    stored = session_store.read_sessions(spark, folder)
    assert {n: t.count() for n, t in stored.items()} == {"sessions": 1, "session_logins": 1, "session_commands": 0}


def test_compaction_leaves_the_list_equal_and_the_log_empty(spark, tmp_path):
    folder = str(tmp_path / "blocks")
    day = lambda n: F.lit(f"2026-02-0{n}").cast("timestamp")
    ips = spark.createDataFrame([(f"192.0.2.{i}",) for i in range(9)], "ip STRING")

    def change(where, n, blocked):
        rows = ips.filter(where).withColumn("changed_at", day(n)).withColumn("blocked", F.lit(blocked))
        return conform(rows, BLOCK_CHANGE)

    now = lambda: [r.ip for r in session_store.blocked_list(session_store.block_changes(spark, folder)).collect()]
    assert now() == []
    session_store.compact_changes(spark, folder)
    session_store.append_changes(change("true", 1, True), folder)
    session_store.append_changes(change("ip <= '192.0.2.3'", 3, False), folder)
    before = now()
    assert before == [f"192.0.2.{i}" for i in range(4, 9)]
    for _ in range(2):
        session_store.compact_changes(spark, folder)
        assert now() == before
        (only,) = os.listdir(folder)
        assert only.startswith("snapshot-")
    assert session_store.block_changes(spark, folder).count() == 9
    # An older block that comes late does not undo the unblock.
    session_store.append_changes(change("true", 2, True), folder)
    assert now() == sorted(before)
    # Two changes at one time: the block counts, in the log as in a snapshot.
    session_store.append_changes(change("ip = '192.0.2.0'", 3, True), folder)
    assert now()[0] == "192.0.2.0"


def test_counts_of_few_addresses(spark):
    sessions = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b")], "session_id STRING, src_ip STRING")
    logins = spark.createDataFrame([("s1",), ("s1",), ("s3",)], "session_id STRING")
    all_rows = {r.src_ip: (r.session_count, r.attempt_count) for r in session_store.block_counts(sessions, logins).collect()}
    few = session_store.block_counts(sessions, logins, spark.createDataFrame([("a",), ("x",)], "ip STRING"))
    assert all_rows == {"a": (2, 2), "b": (1, 1)}
    assert {r.src_ip: (r.session_count, r.attempt_count) for r in few.collect()} == {"a": (2, 2)}
