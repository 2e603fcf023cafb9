"""Table shapes shared by normalisers, rules and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, INT, LONG, BOOL, TIME = (
    StringType(), IntegerType(), LongType(), BooleanType(), TimestampType(),
)
TEXT_MAP = MapType(TEXT, TEXT)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


# Columns every event table starts with. `seq` is the position of the line in its scan.
_HEADER = dict(source=TEXT, ts=TIME, raw=TEXT, extra=TEXT_MAP, seq=LONG)

AUTH_EVENT = _table(
    **_HEADER, hostname=TEXT, process=TEXT, pid=INT, auth_result=TEXT, username=TEXT,
    source_ip=TEXT, port=INT, auth_method=TEXT, new_username=TEXT, sudo_command=TEXT,
    sudo_user=TEXT,
)

AUDIT_EVENT = _table(
    **_HEADER, auid=LONG, uid=LONG, euid=LONG, pid=INT, ppid=INT, comm=TEXT, exe=TEXT,
    syscall=INT, success=BOOL, key=TEXT, name=TEXT, record_type=TEXT,
)

CLOUD_EVENT = _table(
    **_HEADER, event_version=TEXT, event_source=TEXT, event_name=TEXT, aws_region=TEXT,
    source_ip=TEXT, user_agent=TEXT, read_only=BOOL, event_type=TEXT, actor_username=TEXT,
    actor_type=TEXT, actor_arn=TEXT, actor_account_id=TEXT, session_mfa=TEXT,
    mfa_authenticated=BOOL, console_login=TEXT, error_code=TEXT, error_message=TEXT,
)

# One row per honeypot log line; sessions, logins and commands are derived from it.
HONEYPOT_EVENT = _table(
    **_HEADER, session_id=TEXT, eventid=TEXT, src_ip=TEXT, username=TEXT, password=TEXT,
    input=TEXT, duration_ms=LONG,
)

# `broken_line` receives a line that is not JSON.
HONEYPOT_LINE = _table(
    session=TEXT, src_ip=TEXT, eventid=TEXT, timestamp=TEXT, username=TEXT, password=TEXT,
    input=TEXT, duration_ms=LONG, broken_line=TEXT,
)

# `ord` places an alert in (run, rule, time for windowed rules, line) order: keep-first and
# last-wins rollups compare it instead of relying on row order.
ALERT = _table(
    alert_id=TEXT, rule_id=TEXT, technique=TEXT, severity=TEXT, timestamp=TIME, first_seen=TIME,
    last_seen=TIME, source_ip=TEXT, username=TEXT, auid=LONG, description=TEXT, raw_log=TEXT,
    log_source=TEXT, dedup_key=TEXT, extra=TEXT_MAP,
    ord=_table(run=LONG, rule=INT, at=LONG, seq=LONG),
)

SESSION = _table(
    session_id=TEXT, src_ip=TEXT, start_time=TIME, end_time=TIME, duration_ms=LONG
)
SESSION_LOGIN = _table(
    session_id=TEXT, seq=LONG, username=TEXT, password=TEXT, success=BOOL, timestamp=TIME
)
SESSION_COMMAND = _table(session_id=TEXT, seq=LONG, command_text=TEXT, ran_at=TIME)

# Append-only log of block and unblock actions; the newest row per ip is its state.
BLOCK_CHANGE = _table(
    ip=TEXT, changed_at=TIME, blocked=BOOL, attempt_count=LONG, session_count=LONG, reason=TEXT,
    blocked_by=TEXT,
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select exactly the columns of `schema`, cast, in order; absent ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
