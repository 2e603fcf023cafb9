"""Log lines to events."""

import ipaddress
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.addresses import is_address
from emberwatch.functions.audit import normalize_audit
from emberwatch.functions.auth import normalize_auth
from emberwatch.functions.cloud import normalize_cloud
from emberwatch.functions.honeypot import commands, login_attempts, normalize_honeypot, sessionize
from emberwatch.functions.times import as_utc, iso_time


def test_auth_lines(lines):
    events, rejects = normalize_auth(
        lines(
            "Jan 15 10:30:00 web sshd[12345]: Failed password for root from 198.51.100.68 port 22 ssh2",
            "  Jan  5 10:30:00 web sshd[1]: Failed password for invalid user bob from 2001:db8::1 port 9 ssh2 ",
            "Jan 15 10:31:05 web useradd[12346]: new user: name=attacker, UID=1001, GID=1001",
            "Jan 15 10:31:05 web sudo[7]: ubuntu : TTY=pts/0 ; PWD=/home/u ; USER=root ; COMMAND=/usr/sbin/useradd x ",
            "2026-01-15T10:30:00.5+02:00 web sshd[5]: Accepted publickey for eve from 10.0.0.1 port 5 ssh2",
            "Jan 15 10:30:00 web CRON: nothing special",
            "Jan 15 10:30:00 web sshd[1]: Failed password for root from 999.1.1.1 port 22 ssh2",
            "Feb 29 10:30:00 web sshd[1]: no such day in 2026",
            "no time at all",
            "2026-01-15T10:30:00Z web sshd[1]: zone letter",
            "",
        ),
        2026,
    )
    by_seq = {e.seq: e for e in events.collect()}
    assert sorted(by_seq) == [0, 1, 2, 3, 4, 5]
    first = by_seq[0]
    assert (first.hostname, first.process, first.pid) == ("web", "sshd", 12345)
    assert (first.auth_result, first.username, first.source_ip, first.port, first.auth_method) == (
        "failed", "root", "198.51.100.68", 22, "password",
    )
    assert first.ts == datetime(2026, 1, 15, 10, 30)
    assert (by_seq[1].username, by_seq[1].source_ip) == ("bob", "2001:db8::1")
    assert by_seq[1].ts == datetime(2026, 1, 5, 10, 30)
    assert by_seq[2].new_username == "attacker"
    assert (by_seq[3].sudo_user, by_seq[3].sudo_command) == ("ubuntu", "/usr/sbin/useradd x")
    assert (by_seq[4].auth_result, by_seq[4].auth_method) == ("accepted", None)
    assert by_seq[4].ts == datetime(2026, 1, 15, 8, 30, 0, 500000)
    assert (by_seq[4].hostname, by_seq[4].pid) == ("web", 5)
    assert (by_seq[5].process, by_seq[5].pid, by_seq[5].auth_result) == ("CRON", None, None)
    reasons = {r.seq: r.reason for r in rejects.collect()}
    assert reasons == {6: "bad address", 7: "bad time", 8: "bad time", 9: "bad time"}


ADDRESSES = [
    "1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "::", "::1",
    "1::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1::2::3",
    "::ffff:1.2.3.4", "::ffff:1.2.3.400", "1:2:3:4:5:6:1.2.3.4", "12345::", ":1", "1:", ":::",
    "g::1", "", "1:2:3:4:5:6:7", "::1.2.3.4", "1::2:3:4:5:6:7:8", "1.2.3.4:80",
]


def test_addresses(spark):
    def valid(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a STRING")
    got = {r.a: r.ok for r in rows.select("a", is_address(F.col("a")).alias("ok")).collect()}
    assert got == {a: valid(a) for a in ADDRESSES}


def test_two_hosts_with_one_audit_number(lines):
    events, _ = normalize_audit(
        lines(
            *[f'node={n} type=SYSCALL msg=audit(1705312200.123:456): comm="{n}"' for n in ("a", "b")],
            'node=b type=PATH msg=audit(1705312200.123:456): name="/of/b"',
        )
    )
    assert sorted(((e.comm, e.name) for e in events.collect()), key=str) == [("a", None), ("b", "/of/b")]


def test_audit_lines(lines):
    gs = "\x1d"
    events, rejects = normalize_audit(
        lines(
            'type=SYSCALL msg=audit(1705312200.123:456): arch=c000003e syscall=2 success=yes auid=1000 uid=0 euid=0 pid=5 ppid=4 ses=1 ses=2 comm="python3" exe="/tmp/a b" key="shadow_access"' + gs + 'ARCH=x86_64 AUID="ubuntu"',
            'type=PATH msg=audit(1705312200.123:456): item=0 name="/etc/shadow" nametype=NORMAL',
            'type=PATH msg=audit(1705312200.123:456): item=1 name="/second"',
            'type=PATH msg=audit(1705312200.500:9): name="/orphan"',
            "type=SYSCALL no id here",
            "type=SYSCALL msg=audit(1705312300.000:7): key=(null)" + gs + "ARCH=x",
            "type=SYSCALL msg=audit(1705312300.000:8): auid=unset",
            "type=SYSCALL msg=audit(1705399999.000:456): success=no comm=\"\" exe=/bin/x msg='op=x acct=\"root\"",
            "type=SYSCALL msg=audit(1705312300.000:10): syscall=open",
        )
    )
    by_seq = {e.seq: e for e in events.collect()}
    assert sorted(by_seq) == [0, 5, 7]
    event = by_seq[0]
    assert event.ts == datetime(2024, 1, 15, 9, 50, 0, 123000)
    assert (event.auid, event.syscall, event.success, event.name) == (1000, 2, True, "/etc/shadow")
    assert (event.exe, event.comm, event.key) == ("/tmp/a b", "python3", "shadow_access")
    assert event.extra == {"arch": "c000003e", "ses": "2"}
    bare = by_seq[5]
    assert (bare.auid, bare.uid, bare.pid, bare.exe, bare.success) == (4294967295, 0, 0, "", True)
    assert bare.key == "(null)"
    # A later msg= replaces the first one, and with it the time.
    assert (by_seq[7].success, by_seq[7].exe, by_seq[7].ts) == (False, "/bin/x", datetime(1970, 1, 1))
    assert by_seq[7].extra == {"acct": "root"}
    assert sorted(r.reason for r in rejects.collect()) == ["bad number", "bad number"]


def record(**changes):
    base = {
        "eventVersion": "1.11",
        "userIdentity": {
            "type": "IAMUser", "userName": "buddy",
            "sessionContext": {"attributes": {"mfaAuthenticated": "false"}},
        },
        "eventTime": "2026-01-15T10:30:00Z", "eventSource": "signin.amazonaws.com",
        "eventName": "ConsoleLogin", "awsRegion": "us-east-1", "sourceIPAddress": "203.0.113.5",
        "responseElements": {"ConsoleLogin": "Success"}, "errorCode": None, "open": {"x": [1]},
    }
    merged = {**base, **changes}
    return {k: v for k, v in merged.items() if v != "ABSENT"}


CLOUD = [
    (record(), "buddy", False),
    (record(userIdentity={"type": "Root"}), "root", None),
    (record(userIdentity={"type": "AssumedRole", "sessionIssuer": {"userName": "r"}}), "r", None),
    (
        record(userIdentity={"type": "AssumedRole", "sessionContext": {"sessionIssuer": {"userName": "n"}}}),
        "n", None,
    ),
    (record(userIdentity={"type": "AWSService", "principalId": "AROA:svc"}), "svc", None),
    (record(userIdentity={"userName": ""}), None, None),
    (record(userIdentity={}, additionalEventData={"MFAUsed": "Yes"}), None, True),
    (record(userIdentity={}, additionalEventData={"MFAUsed": "No"}), None, False),
    (
        record(
            userIdentity={"sessionContext": {"attributes": {"mfaAuthenticated": "TRUE"}}},
            additionalEventData={"MFAUsed": "No"},
        ),
        None, True,
    ),
    (record(eventName="ABSENT", responseElements=None), "buddy", False),
]
BAD_CLOUD = [
    record(eventTime="ABSENT"), record(eventTime="yesterday"), record(eventName=None),
    record(userIdentity=None),
]


def test_cloud_records(spark):
    texts = [json.dumps(r) for r, _, _ in CLOUD] + [json.dumps(r) for r in BAD_CLOUD]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq BIGINT, record STRING")
    events, rejects = normalize_cloud(frame)
    rows = events.orderBy("seq").collect()
    assert [(r.actor_username, r.mfa_authenticated) for r in rows] == [(u, m) for _, u, m in CLOUD]
    assert rows[0].ts == datetime(2026, 1, 15, 10, 30)
    assert json.loads(rows[0].raw) == CLOUD[0][0]
    assert rows[-1].event_name == ""
    assert sorted(r.seq for r in rejects.collect()) == [len(CLOUD) + i for i in range(len(BAD_CLOUD))]


def pot(session, eventid, second, **fields):
    return json.dumps(
        {
            "session": session, "src_ip": "172.18.0.1", "eventid": eventid,
            "timestamp": f"2026-08-03T09:57:{second:02d}.574711Z", "protocol": "ssh", **fields,
        }
    )


def test_honeypot_lines(lines):
    events, rejects = normalize_honeypot(
        lines(
            pot("a", "cowrie.session.connect", 4),
            pot("b", "cowrie.session.connect", 5, src_ip="9.9.9.9"),
            pot("a", "cowrie.login.success", 17, username="root", password="12345678"),
            pot("a", "cowrie.command.input", 26, input="whoami"),
            pot("b", "cowrie.command.input", 27, input="ls"),
            pot("a", "cowrie.command.input", 29, input="ls"),
            pot("a", "cowrie.command.input", 33, input="cd .."),
            pot("a", "cowrie.command.input", 34, input="ls"),
            pot("a", "cowrie.session.closed", 49, duration_ms=44963),
            "", '{"eventid": "x"}', '{"session": ', pot("a", "cowrie.login.failed", 50),
        )
    )
    sessions = {s.session_id: s for s in sessionize(events).collect()}
    assert set(sessions) == {"a", "b"}
    a = sessions["a"]
    assert (a.src_ip, a.duration_ms, a.login_attempt_count, a.command_count) == ("172.18.0.1", 44963, 1, 4)
    assert a.start_time == datetime(2026, 8, 3, 9, 57, 4, 574711)
    assert a.end_time == datetime(2026, 8, 3, 9, 57, 49, 574711)
    assert (a.first_success.username, a.first_success.password) == ("root", "12345678")
    assert (sessions["b"].src_ip, sessions["b"].end_time) == ("9.9.9.9", None)
    (attempt,) = login_attempts(events).collect()
    assert (attempt.username, attempt.success) == ("root", True)
    typed = commands(events).filter("session_id = 'a'").orderBy("seq").collect()
    assert [t.command_text for t in typed] == ["whoami", "ls", "cd ..", "ls"]
    assert sorted(r.reason for r in rejects.collect()) == ["broken json", "missing field"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-15T10:30:00Z", datetime(2024, 1, 15, 10, 30)),
        ("2024-01-15T10:30:00.25+01:00", datetime(2024, 1, 15, 9, 30, 0, 250000)),
        ("2024-01-15 10:30:00", datetime(2024, 1, 15, 10, 30)),
        ("15 Jan", None),
        ("2024-13-45T10:30:00Z", None),
    ],
)
def test_iso_time(spark, text, expected):
    assert spark.range(1).select(iso_time(F.lit(text)).alias("t")).first().t == expected


def test_as_utc(spark):
    row = spark.range(1).select(
        as_utc(F.lit(1705312200.123), "double").alias("n"),
        as_utc(F.expr("timestamp_ntz'2024-01-15 09:50:00'"), "timestamp_ntz").alias("z"),
    ).first()
    assert row.n == datetime(2024, 1, 15, 9, 50, 0, 123000)
    assert row.z == datetime(2024, 1, 15, 9, 50)
