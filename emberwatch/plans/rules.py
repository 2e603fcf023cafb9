"""The fifteen detection rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions import predicates as P
from emberwatch.functions.honeypot import sessionize
from emberwatch.functions.text import (
    basename,
    message,
    one_of,
    or_none,
    quoted_set,
    time_text,
    whole_seconds,
)
from emberwatch.operators.burst import burst_windows
from emberwatch.operators.success import success_after_failures
from emberwatch.plans.alerts import Case, Rule, RuleBook, alert

c = F.col


def key_of(*columns: str) -> Column:
    """Columns joined by ':' for a dedup key; missing values read 'None'."""
    return F.concat_ws(":", *[or_none(c(name)) for name in columns])


def picked(*columns: str) -> dict[str, Column]:
    return {name: c(name) for name in columns}


def escalated() -> Column:
    return P.is_escalation(c("euid"), c("auid"))


def critical_if(condition: Column) -> Column:
    return F.when(condition, F.lit("CRITICAL")).otherwise(F.lit("HIGH"))


# --- authentication log --------------------------------------------------------------------------
def ssh_brute_force(
    auth: DataFrame,
    threshold: int = K.SSH_THRESHOLD,
    window_seconds: int = K.SSH_WINDOW_SECONDS,
) -> DataFrame:
    failed = auth.filter((c("auth_result") == "failed") & (c("source_ip") != "")).select(
        "source_ip", "ts", "seq", "username"
    )
    hits = burst_windows(
        failed, ["source_ip"], threshold, window_seconds, last=["username"]
    )
    span = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    rate = P.attack_rate(c("count"), span)
    rated = hits.withColumn("span", span).withColumn("speed", P.attack_speed(rate)).withColumn(
        "severity", P.attack_severity(rate)
    )
    row = alert(
        rule_id=K.RULE_SSH_BRUTE_FORCE,
        rule=1,
        technique="T1110.001",
        severity=c("severity"),
        log_source=K.AUTH_LOG,
        first_seen="first_seen",
        last_seen=c("last_seen"),
        source_ip=c("source_ip"),
        username=c("username"),
        dedup_key=c("source_ip"),
        description=message(
            "{} failed SSH attempts from {} in {}s — {}",
            c("count"), c("source_ip"), whole_seconds(c("span")), c("speed"),
        ),
        extra={
            "attempt_count": c("count"),
            "attack_speed": c("speed"),
            "window_seconds": F.lit(window_seconds),
        },
        at=F.unix_micros("last_seen"),
    )
    return rated.select(row.alias("a")).select("a.*")


def new_user() -> list[Case]:
    name = c("new_username")
    suspicious = one_of(name, K.SUSPICIOUS_USERNAMES)
    return [
        Case(
            name.isNotNull(),
            alert(
                rule_id=K.RULE_NEW_USER,
                rule=2,
                technique="T1136.001",
                severity=critical_if(suspicious),
                log_source=K.AUTH_LOG,
                username=name,
                dedup_key=name,
                description=F.concat(
                    message("New user '{}' created on {}", name, c("hostname")),
                    F.when(suspicious, F.lit(" [SUSPICIOUS NAME]")).otherwise(F.lit("")),
                ),
                extra=picked("new_username", "hostname", "sudo_user", "sudo_command"),
            ),
        )
    ]


def brute_force_success(
    auth: DataFrame,
    threshold: int = K.SUCCESS_THRESHOLD,
    window_seconds: int = K.SUCCESS_WINDOW_SECONDS,
) -> DataFrame:
    matched = success_after_failures(auth, threshold, window_seconds)
    row = alert(
        rule_id=K.RULE_BRUTE_SUCCESS,
        rule=3,
        technique="T1110.001",
        severity="CRITICAL",
        log_source=K.AUTH_LOG,
        first_seen="first_failure",
        last_seen=c("success_time"),
        source_ip=c("source_ip"),
        username=c("username"),
        dedup_key=key_of("source_ip", "username"),
        description=message(
            "Brute force SUCCESS — {} failures from {} followed by successful login as"
            " '{}' {}s after last failure",
            c("failures"), c("source_ip"), c("username"), whole_seconds(c("gap")),
        ),
        extra={
            "attempt_count": c("failures"),
            "seconds_after_last_failure": c("gap") / F.lit(1_000_000.0),
            "last_failure_time": time_text(c("last_failure")),
            "success_time": time_text(c("success_time")),
        },
    )
    return matched.select(row.alias("a")).select("a.*")


# --- kernel audit --------------------------------------------------------------------------------
def shadow_access() -> list[Case]:
    plain_admin = c("auid").isin(K.ADMIN_AUIDS) & (c("euid") != 0)
    return [
        Case(
            (c("key") == K.SHADOW_KEY) & ~c("exe").isin(K.SHADOW_ALLOWED_EXES) & ~plain_admin,
            alert(
                rule_id=K.RULE_SHADOW,
                rule=4,
                technique="T1003.008",
                severity="CRITICAL",
                log_source=K.AUDITD,
                dedup_key=key_of("exe", "auid"),
                description=message(
                    "Unauthorized /etc/shadow access by {} (auid={}, euid={})",
                    c("exe"), c("auid"), c("euid"),
                ),
                extra=picked("exe", "comm", "auid", "euid", "key"),
            ),
        )
    ]


def cron_persistence() -> list[Case]:
    return [
        Case(
            (c("key") == K.CRON_KEY)
            & (c("auid") != K.UNSET_AUID)
            & c("syscall").isin(K.CRON_SYSCALLS),
            alert(
                rule_id=K.RULE_CRON,
                rule=5,
                technique="T1053.003",
                severity=critical_if(escalated()),
                log_source=K.AUDITD,
                dedup_key=key_of("exe", "auid", "name"),
                description=message(
                    "Cron file modified: {} by {} (auid={}, euid={})",
                    F.coalesce(F.when(c("name") != "", c("name")), F.lit("unknown")),
                    c("exe"), c("auid"), c("euid"),
                ),
                extra={**picked("exe", "comm", "auid", "euid", "syscall"), "file": c("name")},
            ),
        )
    ]


def audit_tamper() -> list[Case]:
    return [
        Case(
            c("key").isin(K.TAMPER_KEYS),
            alert(
                rule_id=K.RULE_AUDIT_TAMPER,
                rule=6,
                technique="T1562.001",
                severity=critical_if(escalated()),
                log_source=K.AUDITD,
                dedup_key=key_of("exe", "auid", "key"),
                description=message(
                    "auditctl executed by auid={} euid={} via {} — possible attempt to"
                    " disable audit logging",
                    c("auid"), c("euid"), c("exe"),
                ),
                extra=picked("exe", "comm", "auid", "euid"),
            ),
        )
    ]


def sudoers_tamper() -> list[Case]:
    return [
        Case(
            c("key") == K.SUDOERS_KEY,
            alert(
                rule_id=K.RULE_SUDOERS,
                rule=7,
                technique="T1548",
                severity="CRITICAL",
                log_source=K.AUDITD,
                dedup_key=key_of("exe", "auid"),
                description=message(
                    "Sudoers file modified: {} by auid={} euid={} via {}",
                    c("name"), c("auid"), c("euid"), c("exe"),
                ),
                extra={**picked("exe", "comm", "auid", "euid"), "file": c("name")},
            ),
        )
    ]


def _bursts_by_auid(
    audit: DataFrame,
    condition: Column,
    members: list[str],
    threshold: int,
    window_seconds: int,
) -> DataFrame:
    chosen = audit.filter(~c("auid").isin(K.UNSET_AUID, 0) & condition).select(
        "auid", "ts", "seq", *members
    )
    hits = burst_windows(
        chosen, ["auid"], threshold, window_seconds, members=members
    )
    for name in members:
        used = F.filter(f"{name}_members", lambda v: v != "") if name == "name" else c(f"{name}_members")
        hits = hits.withColumn(f"{name}_set", F.array_sort(F.array_distinct(used)))
    return hits.withColumn("span", F.unix_micros("last_seen") - F.unix_micros("first_seen"))


def enumeration_event() -> Column:
    return one_of(basename(c("exe")), K.ENUMERATION_COMMANDS) | one_of(
        c("name"), K.SENSITIVE_FILES
    )


def discovery_event() -> Column:
    return one_of(basename(c("exe")), K.DISCOVERY_COMMANDS)


def account_enumeration(
    audit: DataFrame,
    threshold: int = K.ENUMERATION_THRESHOLD,
    window_seconds: int = K.ENUMERATION_WINDOW_SECONDS,
) -> DataFrame:
    hits = _bursts_by_auid(
        audit, enumeration_event(), ["comm", "name"], threshold, window_seconds
    )
    row = alert(
        rule_id=K.RULE_ENUMERATION,
        rule=8,
        technique="T1087.001",
        severity="HIGH",
        log_source=K.AUDITD,
        first_seen="first_seen",
        last_seen=c("last_seen"),
        dedup_key=F.concat_ws(":", or_none(c("auid")), time_text(c("first_seen"))),
        description=message(
            "Account enumeration by auid={}: {} events in {}s — commands: {}",
            c("auid"), c("count"), whole_seconds(c("span")), quoted_set(c("comm_set")),
        ),
        extra={
            "auid": c("auid"),
            "commands": F.to_json("comm_set"),
            "files": F.to_json("name_set"),
            "count": c("count"),
        },
        at=F.unix_micros("last_seen"),
    )
    return hits.select(row.alias("a")).select("a.*")


def system_discovery(
    audit: DataFrame,
    threshold: int = K.DISCOVERY_THRESHOLD,
    window_seconds: int = K.DISCOVERY_WINDOW_SECONDS,
) -> DataFrame:
    hits = _bursts_by_auid(
        audit, discovery_event(), ["comm"], threshold, window_seconds
    )
    row = alert(
        rule_id=K.RULE_DISCOVERY,
        rule=9,
        technique="T1082",
        severity="MEDIUM",
        log_source=K.AUDITD,
        first_seen="first_seen",
        last_seen=c("last_seen"),
        dedup_key=F.concat_ws(":", or_none(c("auid")), time_text(c("first_seen"))),
        description=message(
            "System discovery by auid={}: {} recon commands in {}s — possible"
            " post-exploitation fingerprinting",
            c("auid"), c("count"), whole_seconds(c("span")),
        ),
        extra={"auid": c("auid"), "commands": F.to_json("comm_set"), "count": c("count")},
        at=F.unix_micros("last_seen"),
    )
    return hits.select(row.alias("a")).select("a.*")


def privilege_escalation() -> list[Case]:
    return [
        Case(
            c("key").isin(K.ESCALATION_KEYS) & escalated(),
            alert(
                rule_id=K.RULE_ESCALATION,
                rule=10,
                technique="T1548",
                severity="CRITICAL",
                log_source=K.AUDITD,
                dedup_key=key_of("exe", "auid", "pid"),
                description=message(
                    "Privilege escalation detected: auid={} running as euid=0 via {}",
                    c("auid"), c("exe"),
                ),
                extra=picked("exe", "comm", "auid", "uid", "euid", "pid"),
            ),
        )
    ]


def masquerading() -> list[Case]:
    present = (c("exe") != "") & (c("comm") != "")
    shared = dict(
        rule_id=K.RULE_MASQUERADING,
        rule=11,
        technique="T1036",
        severity="CRITICAL",
        log_source=K.AUDITD,
    )
    fields = picked("exe", "comm", "auid", "pid")
    return [
        Case(
            present & P.name_differs(c("comm"), c("exe")),
            alert(
                **shared,
                dedup_key=F.concat_ws(":", key_of("exe", "comm", "auid"), F.lit("True")),
                description=message(
                    "Process name mismatch: comm='{}' but exe='{}' — possible masquerading",
                    c("comm"), c("exe"),
                ),
                extra={**fields, "signal": F.lit("name_mismatch")},
            ),
        ),
        Case(
            present & P.runs_outside(c("comm"), c("exe")),
            alert(
                **shared,
                description=message(
                    "Process claims to be sensitive service '{}' but is running from an"
                    " untrusted location: {}",
                    c("comm"), c("exe"),
                ),
                extra={**fields, "signal": F.lit("untrusted_path")},
            ),
        ),
    ]


# --- cloud audit ---------------------------------------------------------------------------------
def no_mfa() -> list[Case]:
    login = P.is_suspicious_login(c("event_name"), c("console_login"), c("mfa_authenticated"))
    call = P.is_call_without_mfa(c("actor_type"), c("mfa_authenticated"), c("error_code"))
    return [
        Case(
            login | call,
            alert(
                rule_id=K.RULE_NO_MFA,
                rule=12,
                technique="T1078",
                severity=F.when(login, F.lit("CRITICAL")).otherwise(F.lit("MEDIUM")),
                log_source=K.CLOUDTRAIL,
                source_ip=c("source_ip"),
                username=c("actor_username"),
                dedup_key=key_of("actor_username", "event_name"),
                description=F.when(
                    login,
                    message(
                        "Console login without MFA by {} from {}",
                        c("actor_username"), c("source_ip"),
                    ),
                ).otherwise(
                    message(
                        "API call {} without MFA by {} from {}",
                        c("event_name"), c("actor_username"), c("source_ip"),
                    )
                ),
                extra=picked("event_name", "aws_region", "mfa_authenticated"),
            ),
        )
    ]


def root_login() -> list[Case]:
    return [
        Case(
            (c("actor_type") == "Root")
            & P.is_console_login(c("event_name"))
            & P.login_succeeded(c("console_login")),
            alert(
                rule_id=K.RULE_ROOT_LOGIN,
                rule=13,
                technique="T1078.001",
                severity="CRITICAL",
                log_source=K.CLOUDTRAIL,
                dedup_key=c("source_ip"),
                description=message(
                    "Root account console login detected from {} — root should never log in"
                    " directly",
                    c("source_ip"),
                ),
                extra=picked("source_ip", "aws_region", "user_agent", "event_name"),
            ),
        )
    ]


def trail_disabled() -> list[Case]:
    return [
        Case(
            c("event_name").isin(K.TRAIL_CRITICAL_EVENTS + K.TRAIL_HIGH_EVENTS),
            alert(
                rule_id=K.RULE_TRAIL,
                rule=14,
                technique="T1562.002",
                severity=critical_if(c("event_name").isin(K.TRAIL_CRITICAL_EVENTS)),
                log_source=K.CLOUDTRAIL,
                source_ip=c("source_ip"),
                username=c("actor_username"),
                dedup_key=key_of("actor_username", "event_name"),
                description=message(
                    "CloudTrail impaired: {} by {} from {}",
                    c("event_name"), c("actor_username"), c("source_ip"),
                ),
                extra=picked("event_name", "aws_region", "user_agent", "actor_type"),
            ),
        )
    ]


# --- honeypot ------------------------------------------------------------------------------------
def session_alerts(sessions: DataFrame) -> DataFrame:
    """One alert per session with a successful login; `sessions` as from `sessionize`."""
    broken_in = sessions.filter("success_count > 0").select("*", "first_success.*")
    row = alert(
        rule_id=K.RULE_HONEYPOT_LOGIN,
        rule=15,
        technique="T1110.001",
        severity="CRITICAL",
        log_source=K.COWRIE,
        first_seen="ts",
        last_seen=F.coalesce(c("end_time"), c("ts")),
        source_ip=c("src_ip"),
        username=c("username"),
        dedup_key=F.concat(F.lit("cowrie_login:"), c("session_id")),
        description=message(
            "Honeypot login succeeded from {} (session {}) — {} login attempt(s), credentials"
            " {}/{}, {} command(s) run post-login. 100% confidence — no legitimate traffic"
            " reaches this port.",
            c("src_ip"), c("session_id"), c("login_attempt_count"), c("username"), c("password"),
            c("command_count"),
        ),
        extra={
            "session_id": c("session_id"),
            "login_attempt_count": c("login_attempt_count"),
            "command_count": c("command_count"),
            "password": c("password"),
            "download_tools": F.to_json("download_tools"),
            "chmod_x_used": c("chmod_x_used"),
        },
    )
    return broken_in.select(row.alias("a")).select("a.*")


def honeypot_login(honeypot: DataFrame) -> DataFrame:
    return session_alerts(sessionize(honeypot))


def rule_book() -> RuleBook:
    return RuleBook(
        [
            Rule("det_001", K.AUTH_LOG, 1, detect=ssh_brute_force),
            Rule("det_003", K.AUTH_LOG, 2, cases=new_user),
            Rule("det_007", K.AUTH_LOG, 3, detect=brute_force_success),
            Rule("det_004", K.AUDITD, 4, cases=shadow_access),
            Rule("det_008", K.AUDITD, 5, cases=cron_persistence),
            Rule("det_010", K.AUDITD, 6, cases=audit_tamper),
            Rule("det_011", K.AUDITD, 7, cases=sudoers_tamper),
            Rule("det_012", K.AUDITD, 8, detect=account_enumeration),
            Rule("det_013", K.AUDITD, 9, detect=system_discovery),
            Rule("det_005", K.AUDITD, 10, cases=privilege_escalation),
            Rule("det_014", K.AUDITD, 11, cases=masquerading),
            Rule("det_002", K.CLOUDTRAIL, 12, cases=no_mfa),
            Rule("det_006", K.CLOUDTRAIL, 13, cases=root_login),
            Rule("det_009", K.CLOUDTRAIL, 14, cases=trail_disabled),
            Rule("det_015", K.COWRIE, 15, detect=honeypot_login),
        ]
    )
