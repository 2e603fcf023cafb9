"""File scans and the stored tables."""

import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from events import at
from emberwatch import constants as K
from emberwatch.functions.honeypot import login_attempts
from emberwatch.operators.dedup import dedup_key, keep_first, new_alerts
from emberwatch.plans.rules import rule_book
from emberwatch.schemas import SESSION
from emberwatch.sources import alert_store, files, session_store
from emberwatch.streaming.run import run_available


def test_lines(spark, tmp_path):
    (tmp_path / "auth.log").write_bytes(b"one\n\n   \n two \xff\xfe\n\x1f\n")
    rows = files.read_lines(spark, str(tmp_path / "auth.log")).orderBy("seq").collect()
    assert [r.value for r in rows] == ["one", " two ��"]
    assert files.read_lines_or_empty(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException):
        files.read_lines(spark, str(tmp_path / "none")).count()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("order", ["time", "name"])
def test_lines_follow_the_log_over_its_files(spark, tmp_path, small_splits, order):
    """Three files; the newest is the largest, and the name order is not the time order."""
    sizes = {"b.log": 700, "c 1.log": 150, "a.log": 3000}
    for age, (name, n) in enumerate(sizes.items()):
        (tmp_path / name).write_text("".join(f"{name}:{i}\n\n" for i in range(n)))
        os.utime(tmp_path / name, (1_700_000_000 + age, 1_700_000_000 + age))
    lines = files.read_lines(spark, str(tmp_path), order=order)
    assert lines.select("seq").distinct().count() == 3850
    want = [f"{n}:{i}" for n in (sizes if order == "time" else sorted(sizes)) for i in range(sizes[n])]
    assert [r.value for r in lines.orderBy("seq").collect()] == want


def test_many_files_join_by_shuffle(spark, tmp_path, monkeypatch):
    for i, name in enumerate(("x.log", "y.log")):
        (tmp_path / name).write_text(f"{name} 1\n{name} 2\n")
        os.utime(tmp_path / name, (1_700_000_000 - i, 1_700_000_000 - i))
    monkeypatch.setattr(files, "BROADCAST_FILES", 0)
    rows = files.read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["y.log 1", "y.log 2", "x.log 1", "x.log 2"]


def test_first_login_of_a_session_in_two_files(spark, tmp_path):
    """Events of one time; the earlier file is the smaller one."""
    def login(name):
        return json.dumps({
            "session": "s", "src_ip": "192.0.2.1", "eventid": "cowrie.login.success",
            "timestamp": "2026-01-15T10:30:00Z", "username": name, "password": "p",
        })

    (tmp_path / "pot.json.1").write_text(login("first") + "\n")
    (tmp_path / "pot.json").write_text("".join(login(f"later{i}") + "\n" for i in range(200)))
    os.utime(tmp_path / "pot.json.1", (1_700_000_000, 1_700_000_000))
    events = files.read_events(spark, str(tmp_path), K.COWRIE).events
    typed = login_attempts(events).orderBy("seq").first()
    assert typed.username == "first"
    assert [r.first_user for r in events.groupBy("session_id").agg(
        F.min_by("username", F.struct("ts", "seq")).alias("first_user")).collect()] == ["first"]


def write_cloud(path, records):
    with gzip.open(path, "wt") as f:
        f.write(records if isinstance(records, str) else json.dumps(records))


def cloud_record(name):
    return {
        "eventVersion": "1", "eventTime": "2026-01-15T10:30:00Z", "eventSource": "s",
        "eventName": name, "awsRegion": "r", "userIdentity": {"type": "Root"}, "z": {"b": 1, "a": 2},
    }


def test_cloud_files(spark, tmp_path):
    write_cloud(tmp_path / "a_1.json.gz", {"Records": [cloud_record("A"), cloud_record("B")]})
    write_cloud(tmp_path / "a_2.json.gz", '{"Records": [{"eventName": "cut')
    write_cloud(tmp_path / "a_3.json.gz", {"Other": 1})
    write_cloud(tmp_path / "a_4.json.gz", {"Records": [cloud_record("C")]})
    records, broken = files.read_cloud_files(spark, str(tmp_path))
    assert sorted(json.loads(r.record)["eventName"] for r in records.collect()) == ["A", "B", "C"]
    assert [r.file_name for r in broken.collect()] == ["a_2.json.gz"]
    later, _ = files.read_cloud_files(spark, str(tmp_path), after="a_1.json.gz")
    assert [json.loads(r.record)["eventName"] for r in later.collect()] == ["C"]
    assert files.last_file_name(spark, str(tmp_path)).first().last_file == "a_4.json.gz"
    events, rejects = files.read_events(spark, str(tmp_path), K.CLOUDTRAIL)
    assert events.count() == 3
    assert [r.reason for r in rejects.collect()] == ["broken file"]
    assert json.loads(events.filter("event_name = 'C'").first().raw) == cloud_record("C")


def test_incremental_lines(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "1.log").write_text("a\nb\n")
    run_available(files.stream_lines(spark, landing), out, state)
    run_available(files.stream_lines(spark, landing), out, state)
    (tmp_path / "landing" / "2.log").write_text("\nc\n")
    run_available(files.stream_lines(spark, landing), out, state)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_cloud_files_as_a_stream(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    (tmp_path / "landing").mkdir()
    write_cloud(tmp_path / "landing" / "1.json.gz", {"Records": [cloud_record("A")]})
    write_cloud(tmp_path / "landing" / "2.json.gz", '{"Records": [{"eventName": "cut')
    run_available(files.stream_cloud_files(spark, landing), out, state)
    write_cloud(tmp_path / "landing" / "3.json.gz", {"Records": [cloud_record("B")]})
    run_available(files.stream_cloud_files(spark, landing, files_per_trigger=1), out, state)
    stored = spark.read.parquet(out).collect()
    assert sorted(json.loads(r.record)["eventName"] for r in stored) == ["A", "B"]


def test_strict_and_counts(spark, lines):
    bad = files.normalize(lines("no time", "Jan 15 10:30:00 h p: x"), K.AUTH_LOG, 2026)
    counts = files.count_lines({K.AUTH_LOG: bad}).first()
    assert (counts.events, counts.parse_errors) == (1, 1)
    with pytest.raises(PySparkException):
        files.strictly(bad).collect()
    good = files.normalize(lines("Jan 15 10:30:00 h p: x"), K.AUTH_LOG, 2026)
    assert len(files.strictly(good).collect()) == 1
    with pytest.raises(ValueError):
        files.normalize(lines("x"), "syslog")


def test_dedup(spark, audit):
    book = rule_book()
    rows = [
        dict(exe="/tmp/evil", comm="sshd", auid=1000), dict(exe="/tmp/worse", comm="sshd", auid=1000),
        dict(exe="/tmp/evil", comm="sshd", auid=1001), dict(exe="/tmp/evil", comm="sshd", auid=1000),
    ]
    alerts = book.rules["det_014"].run(audit(*rows))
    assert alerts.count() == 8
    keys = {r.k for r in alerts.select(dedup_key().alias("k")).collect()}
    assert "rule_014_masquerading:None:None:1000" in keys
    first = keep_first(alerts)
    assert sorted((r.ord.seq, r.extra["signal"]) for r in first.collect()) == [
        (0, "name_mismatch"), (0, "untrusted_path"), (1, "name_mismatch"),
        (2, "name_mismatch"), (2, "untrusted_path"),
    ]
    history = book.rules["det_014"].run(audit(rows[0]))
    fresh = new_alerts(alerts, history).collect()
    assert sorted((r.ord.seq, r.extra["signal"]) for r in fresh) == [
        (1, "name_mismatch"), (2, "name_mismatch"), (2, "untrusted_path"),
    ]


def test_alert_history(spark, audit, tmp_path):
    path = str(tmp_path / "alerts")
    assert alert_store.load_alerts(spark, path).count() == 0
    alerts = rule_book().rules["det_011"].run(audit(dict(key="sudoers_tamper")))
    for run in (1, 2):
        alert_store.store_new_alerts(spark, alerts, path, run)
    (stored,) = alert_store.load_alerts(spark, path).collect()
    assert (stored.rule_id, stored.ord.run, stored.extra["auid"]) == ("rule_011_sudoers_tamper", 1, "1000")
    (tmp_path / "alerts" / "day=2026-01-15" / "part-bad.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        alert_store.load_alerts(spark, path).collect()


def test_history_without_alerts_is_not_a_history_without_files(spark, audit, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = rule_book().rules["det_011"].run(audit(dict(key="sudoers_tamper")))
    alert_store.store_new_alerts(spark, alerts.filter("false"), path, 1)
    assert alert_store.load_alerts(spark, path).count() == 0
    alert_store.store_new_alerts(spark, alerts, path, 2)
    assert alert_store.load_alerts(spark, path).count() == 1
    (tmp_path / "lost").mkdir()
    with pytest.raises(PySparkException):
        alert_store.load_alerts(spark, str(tmp_path / "lost"))
    with pytest.raises(PySparkException):
        session_store.read_table(spark, str(tmp_path / "lost"), SESSION)


def test_repeated_batch_is_stored_once(spark, audit, tmp_path):
    path = str(tmp_path / "alerts")
    rule = rule_book().rules["det_011"]
    one = rule.run(audit(dict(key="sudoers_tamper")))
    two = rule.run(audit(dict(key="sudoers_tamper"), dict(key="sudoers_tamper", exe="/bin/x")))
    for alerts, batch in ((one, 0), (one, 0), (two, 1), (two, 1)):
        alert_store.store_batch(spark, alerts, path, batch)
    stored = alert_store.load_batches(spark, path).collect()
    assert sorted(r.extra["exe"] for r in stored) == ["/bin/x", "/usr/bin/python3"]


def pot_rows():
    login = lambda s, ip, ok, t: dict(
        session_id=s, src_ip=ip, ts=at(t), username="u", password="p",
        eventid=K.POT_LOGIN_OK if ok else K.POT_LOGIN_FAILED,
    )
    return [
        dict(session_id="a", src_ip="1.1.1.1", ts=at(0), eventid=K.POT_CONNECT),
        login("a", "1.1.1.1", False, 1), login("a", "1.1.1.1", True, 2),
        dict(session_id="a", src_ip="1.1.1.1", ts=at(3), eventid=K.POT_COMMAND, input="ls"),
        dict(session_id="b", src_ip="1.1.1.1", ts=at(9), eventid=K.POT_CONNECT),
        dict(session_id="c", src_ip="2.2.2.2", ts=at(9), eventid=K.POT_COMMAND, input="id"),
    ]


def test_session_store(spark, honeypot, tmp_path):
    folder = str(tmp_path / "sessions")
    events = honeypot(*pot_rows())
    for _ in range(2):
        session_store.store_sessions(spark, events, folder)
    stored = session_store.read_sessions(spark, folder)
    assert {n: t.count() for n, t in stored.items()} == {
        "sessions": 3, "session_logins": 2, "session_commands": 2
    }
    newest = session_store.newest_sessions(stored["sessions"], "1.1.1.1").collect()
    assert [r.session_id for r in newest] == ["b", "a"]
    typed = session_store.oldest_commands(stored["session_commands"], "a").collect()
    assert [r.command_text for r in typed] == ["ls"]


def test_session_stored_over_two_runs(spark, honeypot, tmp_path):
    folder = str(tmp_path / "sessions")
    rows = [
        *pot_rows(),
        dict(session_id="a", src_ip="1.1.1.1", ts=at(20), eventid=K.POT_LOGIN_OK, username="v", password="q"),
        dict(session_id="a", src_ip="1.1.1.1", ts=at(21), eventid=K.POT_COMMAND, input="id"),
        dict(session_id="a", src_ip="1.1.1.1", ts=at(30), eventid=K.POT_CLOSED, duration_ms=30000),
    ]
    # The second run sees the later lines only, numbered from 0 again; then all lines come once more.
    for part in (rows[:6], rows[6:], rows):
        session_store.store_sessions(spark, honeypot(*part), folder)
    stored = session_store.read_sessions(spark, folder)
    whole = session_store.session_tables(honeypot(*rows))
    for name, table in stored.items():
        columns = [n for n in table.columns if n != "seq"]
        assert sorted(map(str, table.select(columns).collect())) == sorted(map(str, whole[name].select(columns).collect()))
    (a,) = stored["sessions"].filter("session_id = 'a'").collect()
    assert (a.start_time, a.end_time, a.duration_ms) == (at(0), at(30), 30000)


def test_block_list(spark, honeypot):
    tables = session_store.session_tables(honeypot(*pot_rows()))
    sessions, logins = tables["sessions"], tables["session_logins"]
    day = lambda n: F.lit(f"2026-02-0{n}").cast("timestamp")
    ips = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), ("3.3.3.3",)], "ip STRING")
    changes = (
        session_store.block(ips, sessions, logins, "first", at=day(1))
        .unionByName(session_store.unblock(ips.filter("ip = '2.2.2.2'"), at=day(2)))
        .unionByName(
            session_store.block(ips.filter("ip = '3.3.3.3'"), sessions, logins, "again", "auto", at=day(3))
        )
    )
    listed = session_store.blocked_list(changes).collect()
    assert [(r.ip, r.attempt_count, r.session_count, r.reason, r.blocked_by) for r in listed] == [
        ("3.3.3.3", 0, 0, "again", "auto"), ("1.1.1.1", 2, 2, "first", "manual"),
    ]
    assert listed[0].blocked_at == datetime(2026, 2, 3)
    kept = session_store.blocked_only(sessions, changes).collect()
    assert sorted(r.session_id for r in kept) == ["a", "b"]
    with pytest.raises(ValueError):
        session_store.block(ips, sessions, logins, "x", "robot")
