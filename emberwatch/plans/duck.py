"""The same queries in SQL for DuckDB, used to check results.

Written separately from the Spark code, as named sub-queries over the `events` view; `query` puts
the needed ones in front of a final SELECT.
"""

from emberwatch import constants as K
from emberwatch.sources import standin as S


def _in(values) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values) + ")"


def _duck(expression: str) -> str:
    return S.render(expression, "duckdb")


# Sub-queries by name. A text may use the ones defined before it.
CTES: dict[str, str] = {}

CTES["auth_lines"] = f"SELECT event_id AS seq, {_duck(S.AUTH_LINE)} AS raw FROM events"
_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
CTES["auth_all"] = rf"""
SELECT seq, raw, kind, iso,
  CASE WHEN iso THEN try_cast(regexp_extract(raw, '^\S+') AS timestamp)
       ELSE try_strptime('{S.YEAR} ' || regexp_extract(raw, '^(\w+\s+\d+ \S+)', 1), '%Y %b %d %H:%M:%S') END AS ts,
  parts[CASE WHEN iso THEN 2 ELSE 4 END] AS hostname,
  rtrim(split_part(parts[CASE WHEN iso THEN 3 ELSE 5 END], '[', 1), ':') AS process,
  try_cast(regexp_extract(parts[CASE WHEN iso THEN 3 ELSE 5 END], '\[(\d+)\]', 1) AS int) AS pid,
  CASE WHEN kind IN ('failed', 'accepted') THEN kind END AS auth_result,
  CASE WHEN kind IN ('failed', 'accepted') THEN regexp_extract(raw, ' for (invalid user )?(\S+) from ', 2) END AS username,
  CASE WHEN kind IN ('failed', 'accepted') THEN regexp_extract(raw, ' from (\S+) port ', 1) END AS source_ip,
  CASE WHEN kind IN ('failed', 'accepted') THEN cast(regexp_extract(raw, ' port (\d+)', 1) AS int) END AS port,
  CASE WHEN kind = 'failed' THEN 'password' END AS auth_method,
  CASE WHEN kind = 'new_user' THEN regexp_extract(raw, 'name=([^,]+),', 1) END AS new_username,
  CASE WHEN kind = 'sudo' THEN trim(regexp_extract(raw, 'COMMAND=(.*)$', 1)) END AS sudo_command,
  CASE WHEN kind = 'sudo' THEN regexp_extract(raw, '(\S+)\s+: TTY=', 1) END AS sudo_user
FROM (SELECT *, CASE WHEN raw LIKE '%Failed password for%' THEN 'failed'
                     WHEN raw LIKE '%Accepted p%' THEN 'accepted'
                     WHEN raw LIKE '%new user: name=%' THEN 'new_user'
                     WHEN raw LIKE '%COMMAND=%' THEN 'sudo' ELSE 'other' END AS kind,
             regexp_matches(raw, '^\d{{4}}-\d\d-\d\dT') AS iso,
             regexp_split_to_array(trim(raw), '\s+') AS parts
      FROM auth_lines)"""
CTES["auth_checked"] = rf"""
SELECT *, CASE WHEN ts IS NULL THEN 'bad time'
               WHEN source_ip IS NOT NULL AND NOT regexp_matches(source_ip, '{_V4}') THEN 'bad address' END AS reason
FROM auth_all"""
CTES["auth"] = "SELECT * FROM auth_checked WHERE reason IS NULL"

CTES["audit_lines"] = " UNION ALL ".join(
    f"SELECT event_id * 4 + {place} AS seq, {_duck(line)} AS value FROM events WHERE {condition}"
    for condition, place, line in S.AUDIT_LINES
)
CTES["audit_ids"] = r"""
SELECT seq, value, regexp_extract(value, 'audit\((\d+\.\d+):', 1) AS epoch,
  regexp_extract(value, 'audit\(\d+\.\d+:(\d+)\)', 1) AS serial
FROM audit_lines WHERE value LIKE '%msg=audit(%'"""
CTES["audit_corr"] = r"""
SELECT epoch, serial, arg_min(value, seq) FILTER (WHERE value LIKE 'type=SYSCALL%') AS raw,
  min(seq) FILTER (WHERE value LIKE 'type=SYSCALL%') AS seq,
  arg_min(regexp_extract(value, ' name="([^"]*)"', 1), seq) FILTER (WHERE value LIKE 'type=PATH%') AS path_name
FROM audit_ids GROUP BY epoch, serial HAVING raw IS NOT NULL"""
CTES["audit_all"] = r"""
SELECT seq, raw, serial, 'SYSCALL' AS record_type, path_name AS name,
  epoch_us(make_timestamp(cast(replace(epoch, '.', '') AS bigint) * 1000)) AS t,
  make_timestamp(cast(replace(epoch, '.', '') AS bigint) * 1000) AS ts,
  try_cast(regexp_extract(raw, ' auid=(\S+)', 1) AS bigint) AS auid,
  cast(regexp_extract(raw, ' uid=(\S+)', 1) AS bigint) AS uid,
  cast(regexp_extract(raw, ' euid=(\S+)', 1) AS bigint) AS euid,
  cast(regexp_extract(raw, ' pid=(\S+)', 1) AS int) AS pid,
  cast(regexp_extract(raw, ' ppid=(\S+)', 1) AS int) AS ppid,
  regexp_extract(raw, ' comm="([^"]*)"', 1) AS comm,
  regexp_extract(raw, ' exe="([^"]*)"', 1) AS exe,
  try_cast(regexp_extract(raw, ' syscall=(\d+)', 1) AS int) AS syscall,
  raw LIKE '% success=yes %' AS success,
  regexp_extract(raw, ' key="?([^"\x1d]*)', 1) AS key
FROM audit_corr"""
CTES["audit"] = """
SELECT *, regexp_extract(exe, '[^/]*$') AS base,
  euid = 0 AND auid <> 0 AND auid <> 4294967295 AS escalated
FROM audit_all WHERE auid IS NOT NULL"""

CTES["cloud_lines"] = f"SELECT event_id AS seq, {_duck(S.CLOUD_LINE)} AS raw FROM events"
CTES["cloud_all"] = """
SELECT seq, raw, try_cast(replace(j ->> '$.eventTime', 'Z', '') AS timestamp) AS ts,
  j ->> '$.eventVersion' AS event_version, j ->> '$.eventSource' AS event_source,
  j ->> '$.eventName' AS event_name, j ->> '$.awsRegion' AS aws_region,
  j ->> '$.sourceIPAddress' AS source_ip, j ->> '$.userAgent' AS user_agent,
  cast(j ->> '$.readOnly' AS boolean) AS read_only,
  coalesce(nullif(j ->> '$.userIdentity.userName', ''),
    nullif(j ->> '$.userIdentity.sessionIssuer.userName', ''),
    CASE WHEN j ->> '$.userIdentity.type' = 'Root' THEN 'root' END,
    nullif(regexp_extract(j ->> '$.userIdentity.principalId', '[^:]*$'), '')) AS actor_username,
  coalesce(j ->> '$.userIdentity.type', '') AS actor_type,
  j ->> '$.userIdentity.sessionContext.attributes.mfaAuthenticated' AS session_mfa,
  CASE WHEN session_mfa IS NOT NULL THEN lower(session_mfa) = 'true'
       WHEN j ->> '$.additionalEventData.MFAUsed' IS NOT NULL
       THEN j ->> '$.additionalEventData.MFAUsed' = 'Yes' END AS mfa_authenticated,
  j ->> '$.responseElements.ConsoleLogin' AS console_login, j ->> '$.errorCode' AS error_code
FROM (SELECT seq, raw, cast(raw AS json) AS j FROM cloud_lines)"""
CTES["cloud_checked"] = """
SELECT *, CASE WHEN ts IS NULL THEN 'bad time' WHEN event_name IS NULL THEN 'bad shape' END AS reason
FROM cloud_all"""
CTES["cloud"] = """
SELECT *, event_name = 'ConsoleLogin' AS is_login,
  coalesce(console_login = 'Success', false) AS login_ok,
  coalesce(mfa_authenticated, true) AS mfa_used,
  actor_type = 'IAMUser' AND coalesce(NOT mfa_authenticated, false) AND coalesce(error_code, '') = '' AS call_no_mfa
FROM cloud_checked WHERE reason IS NULL"""

CTES["pot_lines"] = f"SELECT event_id AS seq, {_duck(S.POT_LINE)} AS raw FROM events"
CTES["pot"] = """
SELECT seq, raw, j ->> '$.session' AS session_id, j ->> '$.src_ip' AS src_ip, j ->> '$.eventid' AS eventid,
  cast(replace(j ->> '$.timestamp', 'Z', '') AS timestamp) AS ts, j ->> '$.username' AS username,
  j ->> '$.password' AS password, j ->> '$.input' AS input,
  cast(j ->> '$.duration_ms' AS bigint) AS duration_ms
FROM (SELECT seq, raw, cast(raw AS json) AS j FROM pot_lines WHERE json_valid(raw))
WHERE j ->> '$.session' <> ''"""
CTES["tools"] = r"""
SELECT session_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM
  (SELECT session_id, unnest(regexp_extract_all(input, '\b(wget|curl|nc|ncat|netcat)\b')) AS tool FROM pot)
GROUP BY session_id"""
CTES["sessions"] = r"""
SELECT session_id, min(seq) AS seq, arg_min(src_ip, seq) AS src_ip,
  arg_max(ts, seq) FILTER (WHERE eventid = 'cowrie.session.connect') AS start_time,
  arg_max(ts, seq) FILTER (WHERE eventid = 'cowrie.session.closed') AS end_time,
  arg_max(duration_ms, seq) FILTER (WHERE eventid = 'cowrie.session.closed') AS duration_ms,
  count(*) FILTER (WHERE eventid LIKE 'cowrie.login.%') AS login_attempt_count,
  count(*) FILTER (WHERE eventid = 'cowrie.login.success') AS success_count,
  count(*) FILTER (WHERE eventid = 'cowrie.command.input') AS command_count,
  arg_min(ts, seq) FILTER (WHERE eventid = 'cowrie.login.success') AS first_ts,
  arg_min(username, seq) FILTER (WHERE eventid = 'cowrie.login.success') AS first_user,
  arg_min(password, seq) FILTER (WHERE eventid = 'cowrie.login.success') AS first_password,
  coalesce(bool_or(regexp_matches(input, 'chmod\s+\+x')), false) AS chmod_x_used,
  coalesce(any_value(tools), '') AS download_tools
FROM pot LEFT JOIN tools USING (session_id) GROUP BY session_id"""


def burst(prefix: str, source: str, key: str, n: int, seconds: int) -> None:
    """Adds {prefix}_rows, {prefix}_cand, {prefix}_pick and {prefix} (one row per hit)."""
    CTES[f"{prefix}_rows"] = f"""
SELECT *, row_number() OVER w AS rn, lag(t, {n - 1}) OVER w AS first_t
FROM ({source}) WINDOW w AS (PARTITION BY {key} ORDER BY t, seq)"""
    CTES[f"{prefix}_cand"] = (
        f"SELECT {key}, rn FROM {prefix}_rows WHERE t - first_t <= {seconds} * 1000000::bigint"
    )
    CTES[f"{prefix}_pick({key}, rn)"] = f"""
SELECT {key}, min(rn) FROM {prefix}_cand GROUP BY {key}
UNION ALL
SELECT p.{key}, min(c.rn) FROM {prefix}_pick p JOIN {prefix}_cand c ON c.{key} = p.{key} AND c.rn >= p.rn + {n}
GROUP BY p.{key}"""
    CTES[prefix] = f"""
SELECT r.*, {n} AS n, round_even((r.t - r.first_t) / 1e6, 0)::bigint AS secs
FROM {prefix}_rows r JOIN {prefix}_pick p USING ({key}, rn)"""


WEEK = 7 * 86400
AUDIT_N, AUDIT_W = 5, 6 * 3600

burst(
    "ssh",
    "SELECT source_ip, epoch_us(ts) AS t, seq, username FROM auth WHERE auth_result = 'failed'",
    "source_ip", 5, WEEK,
)
burst(
    "enum",
    f"""SELECT auid, t, seq, comm, name FROM audit WHERE auid NOT IN (0, 4294967295)
 AND (base IN {_in(K.ENUMERATION_COMMANDS)} OR coalesce(name IN {_in(K.SENSITIVE_FILES)}, false))""",
    "auid", AUDIT_N, AUDIT_W,
)
burst(
    "disc",
    f"""SELECT auid, t, seq, comm FROM audit WHERE auid NOT IN (0, 4294967295)
 AND base IN {_in(K.DISCOVERY_COMMANDS)}""",
    "auid", AUDIT_N, AUDIT_W,
)
CTES["enum_sets"] = f"""
SELECT p.auid, p.rn, list_sort(list_distinct(list(r.comm))) AS comms,
  list_sort(list_distinct(list(r.name) FILTER (WHERE r.name <> ''))) AS names
FROM enum_pick p JOIN enum_rows r ON r.auid = p.auid AND r.rn > p.rn - {AUDIT_N} AND r.rn <= p.rn
GROUP BY p.auid, p.rn"""
CTES["disc_sets"] = f"""
SELECT p.auid, p.rn, list_sort(list_distinct(list(r.comm))) AS comms
FROM disc_pick p JOIN disc_rows r ON r.auid = p.auid AND r.rn > p.rn - {AUDIT_N} AND r.rn <= p.rn
GROUP BY p.auid, p.rn"""
CTES["fails"] = """
SELECT source_ip, count(*) AS failures, min(ts) AS first_failure, max(ts) AS last_failure
FROM auth WHERE auth_result = 'failed' GROUP BY source_ip"""
CTES["success"] = f"""
SELECT a.source_ip, a.username, a.seq, f.failures, f.first_failure, f.last_failure,
  a.ts AS success_time, epoch_us(a.ts) - epoch_us(f.last_failure) AS gap
FROM auth a JOIN fails f USING (source_ip)
WHERE a.auth_result = 'accepted' AND f.failures >= 5
  AND epoch_us(a.ts) - epoch_us(f.last_failure) BETWEEN 0 AND {WEEK} * 1000000::bigint"""


def _pytime(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') || CASE WHEN ({us}) % 1000000 = 0 THEN ''"
        f" ELSE '.' || lpad((({us}) % 1000000)::varchar, 6, '0') END || '+00:00'"
    )


def _extra(**fields: str) -> str:
    """`k=v;...` in key order, as the Spark side prints the extra map."""
    parts = [f"'{k}=' || coalesce(({v})::varchar, 'None')" for k, v in sorted(fields.items())]
    return " || ';' || ".join(parts)


def _alert(
    rule_id, rule, technique, severity, source, description, dedup, extra, table, where="true",
    first="epoch_us(ts)", last="NULL", ip="NULL", user="NULL", at="0", seq="seq", auid="NULL",
    speed="NULL", attempts="NULL", euid="NULL", comm="NULL", signal="NULL", file="NULL",
) -> str:
    return f"""
SELECT '{rule_id}' AS rule_id, '{technique}' AS technique, {severity} AS severity,
  {first} AS first_seen, ({last})::bigint AS last_seen, ({ip})::varchar AS source_ip,
  ({user})::varchar AS username, {description} AS description, '{source}' AS log_source,
  ({dedup})::varchar AS dedup_key, {extra} AS extra, {rule} AS ord_rule, ({at})::bigint AS ord_at,
  ({seq})::bigint AS ord_seq, ({auid})::bigint AS x_auid, ({speed})::varchar AS x_speed,
  ({attempts})::bigint AS x_attempts, ({euid})::bigint AS x_euid, ({comm})::varchar AS x_comm,
  ({signal})::varchar AS x_signal, ({file})::varchar AS x_file
FROM {table} WHERE {where}"""


_RATE = "n / greatest((t - first_t) / 1e6, 1.0)"
_SPEED = f"CASE WHEN {_RATE} > 10 THEN 'aggressive' WHEN {_RATE} > 3 THEN 'moderate' ELSE 'slow_scan' END"
_AUDIT_FIELDS = dict(exe="exe", comm="comm", auid="auid", euid="euid")
_AUDIT_X = dict(auid="auid", euid="euid", comm="comm")
_ESC = "CASE WHEN escalated THEN 'CRITICAL' ELSE 'HIGH' END"

CTES["det_001"] = _alert(
    K.RULE_SSH_BRUTE_FORCE, 1, "T1110.001",
    f"CASE WHEN {_RATE} > 10 THEN 'CRITICAL' WHEN {_RATE} > 3 THEN 'HIGH' ELSE 'MEDIUM' END",
    K.AUTH_LOG,
    f"n || ' failed SSH attempts from ' || source_ip || ' in ' || secs || 's — ' || {_SPEED}",
    "source_ip", _extra(attempt_count="n", attack_speed=_SPEED, window_seconds=str(WEEK)), "ssh",
    first="first_t", last="t", ip="source_ip", user="username", at="t", speed=_SPEED, attempts="n",
)
_SUS = f"new_username IN {_in(K.SUSPICIOUS_USERNAMES)}"
CTES["det_003"] = _alert(
    K.RULE_NEW_USER, 2, "T1136.001", f"CASE WHEN {_SUS} THEN 'CRITICAL' ELSE 'HIGH' END", K.AUTH_LOG,
    f"'New user ''' || new_username || ''' created on ' || hostname || CASE WHEN {_SUS} THEN ' [SUSPICIOUS NAME]' ELSE '' END",
    "new_username",
    _extra(new_username="new_username", hostname="hostname", sudo_user="sudo_user", sudo_command="sudo_command"),
    "auth", "new_username IS NOT NULL", user="new_username",
)
CTES["det_007"] = _alert(
    K.RULE_BRUTE_SUCCESS, 3, "T1110.001", "'CRITICAL'", K.AUTH_LOG,
    "'Brute force SUCCESS — ' || failures || ' failures from ' || source_ip || ' followed by successful login as '''"
    " || username || ''' ' || round_even(gap / 1e6, 0)::bigint || 's after last failure'",
    "source_ip || ':' || username",
    _extra(
        attempt_count="failures", seconds_after_last_failure="gap / 1e6::double",
        last_failure_time=_pytime("epoch_us(last_failure)"),
        success_time=_pytime("epoch_us(success_time)"),
    ),
    "success", first="epoch_us(first_failure)", last="epoch_us(success_time)", ip="source_ip",
    user="username", attempts="failures",
)
CTES["det_004"] = _alert(
    K.RULE_SHADOW, 4, "T1003.008", "'CRITICAL'", K.AUDITD,
    "'Unauthorized /etc/shadow access by ' || exe || ' (auid=' || auid || ', euid=' || euid || ')'",
    "exe || ':' || auid", _extra(**_AUDIT_FIELDS, key="key"), "audit",
    f"key = 'shadow_access' AND exe NOT IN {_in(K.SHADOW_ALLOWED_EXES)} AND NOT (auid = 1000 AND euid <> 0)",
    **_AUDIT_X,
)
CTES["det_008"] = _alert(
    K.RULE_CRON, 5, "T1053.003", _ESC, K.AUDITD,
    "'Cron file modified: ' || coalesce(nullif(name, ''), 'unknown') || ' by ' || exe || ' (auid=' || auid || ', euid=' || euid || ')'",
    "exe || ':' || auid || ':' || coalesce(name, 'None')",
    _extra(**_AUDIT_FIELDS, syscall="syscall", file="name"), "audit",
    "key = 'cron_modification' AND auid <> 4294967295 AND syscall IN (257, 2, 82, 86)",
    **_AUDIT_X, file="name",
)
CTES["det_010"] = _alert(
    K.RULE_AUDIT_TAMPER, 6, "T1562.001", _ESC, K.AUDITD,
    "'auditctl executed by auid=' || auid || ' euid=' || euid || ' via ' || exe || ' — possible attempt to disable audit logging'",
    "exe || ':' || auid || ':' || key", _extra(**_AUDIT_FIELDS), "audit", f"key IN {_in(K.TAMPER_KEYS)}",
    **_AUDIT_X,
)
CTES["det_011"] = _alert(
    K.RULE_SUDOERS, 7, "T1548", "'CRITICAL'", K.AUDITD,
    "'Sudoers file modified: ' || coalesce(name, 'None') || ' by auid=' || auid || ' euid=' || euid || ' via ' || exe",
    "exe || ':' || auid", _extra(**_AUDIT_FIELDS, file="name"), "audit", "key = 'sudoers_tamper'",
    **_AUDIT_X, file="name",
)
_JSON = "'[' || array_to_string(list_transform({}, lambda v: '\"' || v || '\"'), ',') || ']'"
CTES["det_012"] = _alert(
    K.RULE_ENUMERATION, 8, "T1087.001", "'HIGH'", K.AUDITD,
    "'Account enumeration by auid=' || auid || ': ' || n || ' events in ' || secs || 's — commands: {''' || array_to_string(comms, ''', ''') || '''}'",
    f"auid || ':' || {_pytime('first_t')}",
    _extra(
        auid="auid", commands=_JSON.format("comms"), files=_JSON.format("coalesce(names, [])"), count="n"
    ),
    "enum JOIN enum_sets USING (auid, rn)", first="first_t", last="t", at="t", auid="auid",
)
CTES["det_013"] = _alert(
    K.RULE_DISCOVERY, 9, "T1082", "'MEDIUM'", K.AUDITD,
    "'System discovery by auid=' || auid || ': ' || n || ' recon commands in ' || secs || 's — possible post-exploitation fingerprinting'",
    f"auid || ':' || {_pytime('first_t')}",
    _extra(auid="auid", commands=_JSON.format("comms"), count="n"),
    "disc JOIN disc_sets USING (auid, rn)", first="first_t", last="t", at="t", auid="auid",
)
CTES["det_005"] = _alert(
    K.RULE_ESCALATION, 10, "T1548", "'CRITICAL'", K.AUDITD,
    "'Privilege escalation detected: auid=' || auid || ' running as euid=0 via ' || exe",
    "exe || ':' || auid || ':' || pid", _extra(**_AUDIT_FIELDS, uid="uid", pid="pid"), "audit",
    f"key IN {_in(K.ESCALATION_KEYS)} AND escalated", **_AUDIT_X,
)
_INTERP = f"regexp_matches(base, '{K.INTERPRETER}')"
_TRUSTED = " OR ".join(f"starts_with(exe, '{d}')" for d in K.TRUSTED_DIRECTORIES)
_NAME_DIFFERS = (
    f"base <> comm AND NOT (length(comm) = 15 AND starts_with(base, comm))"
    f" AND NOT (comm = 'sh' AND exe IN ('/usr/bin/dash', '/bin/dash')) AND NOT {_INTERP}"
)
_OUTSIDE = f"comm IN {_in(K.SENSITIVE_PROCESSES)} AND NOT ({_TRUSTED}) AND NOT {_INTERP}"
_MASK_FIELDS = dict(exe="exe", comm="comm", auid="auid", pid="pid")
CTES["det_014"] = (
    _alert(
        K.RULE_MASQUERADING, 11, "T1036", "'CRITICAL'", K.AUDITD,
        "'Process name mismatch: comm=''' || comm || ''' but exe=''' || exe || ''' — possible masquerading'",
        "exe || ':' || comm || ':' || auid || ':True'", _extra(**_MASK_FIELDS, signal="'name_mismatch'"),
        "audit", f"exe <> '' AND comm <> '' AND {_NAME_DIFFERS}", auid="auid", comm="comm",
        signal="'name_mismatch'",
    )
    + " UNION ALL "
    + _alert(
        K.RULE_MASQUERADING, 11, "T1036", "'CRITICAL'", K.AUDITD,
        "'Process claims to be sensitive service ''' || comm || ''' but is running from an untrusted location: ' || exe",
        "NULL", _extra(**_MASK_FIELDS, signal="'untrusted_path'"), "audit",
        f"exe <> '' AND comm <> '' AND {_OUTSIDE}", auid="auid", comm="comm", signal="'untrusted_path'",
    )
)
_SUSPICIOUS = "(is_login AND login_ok AND NOT mfa_used)"
CTES["det_002"] = _alert(
    K.RULE_NO_MFA, 12, "T1078", f"CASE WHEN {_SUSPICIOUS} THEN 'CRITICAL' ELSE 'MEDIUM' END", K.CLOUDTRAIL,
    f"CASE WHEN {_SUSPICIOUS} THEN 'Console login without MFA by ' || coalesce(actor_username, 'None') || ' from ' || source_ip"
    " ELSE 'API call ' || event_name || ' without MFA by ' || coalesce(actor_username, 'None') || ' from ' || source_ip END",
    "coalesce(actor_username, 'None') || ':' || event_name",
    _extra(event_name="event_name", aws_region="aws_region", mfa_authenticated="mfa_authenticated"),
    "cloud", f"{_SUSPICIOUS} OR call_no_mfa", ip="source_ip", user="actor_username",
)
CTES["det_006"] = _alert(
    K.RULE_ROOT_LOGIN, 13, "T1078.001", "'CRITICAL'", K.CLOUDTRAIL,
    "'Root account console login detected from ' || source_ip || ' — root should never log in directly'",
    "source_ip",
    _extra(source_ip="source_ip", aws_region="aws_region", user_agent="user_agent", event_name="event_name"),
    "cloud", "actor_type = 'Root' AND is_login AND login_ok",
)
CTES["det_009"] = _alert(
    K.RULE_TRAIL, 14, "T1562.002",
    f"CASE WHEN event_name IN {_in(K.TRAIL_CRITICAL_EVENTS)} THEN 'CRITICAL' ELSE 'HIGH' END", K.CLOUDTRAIL,
    "'CloudTrail impaired: ' || event_name || ' by ' || coalesce(actor_username, 'None') || ' from ' || source_ip",
    "coalesce(actor_username, 'None') || ':' || event_name",
    _extra(event_name="event_name", aws_region="aws_region", user_agent="user_agent", actor_type="actor_type"),
    "cloud", f"event_name IN {_in(K.TRAIL_CRITICAL_EVENTS + K.TRAIL_HIGH_EVENTS)}", ip="source_ip",
    user="actor_username",
)
CTES["det_015"] = _alert(
    K.RULE_HONEYPOT_LOGIN, 15, "T1110.001", "'CRITICAL'", K.COWRIE,
    "'Honeypot login succeeded from ' || src_ip || ' (session ' || session_id || ') — ' || login_attempt_count"
    " || ' login attempt(s), credentials ' || first_user || '/' || first_password || ', ' || command_count"
    " || ' command(s) run post-login. 100% confidence — no legitimate traffic reaches this port.'",
    "'cowrie_login:' || session_id",
    _extra(
        session_id="session_id", login_attempt_count="login_attempt_count", command_count="command_count",
        password="first_password",
        download_tools="CASE WHEN download_tools = '' THEN '[]' ELSE '[\"' || replace(download_tools, ',', '\",\"') || '\"]' END",
        chmod_x_used="chmod_x_used",
    ),
    "sessions", "success_count > 0", first="epoch_us(first_ts)",
    last="epoch_us(coalesce(end_time, first_ts))", ip="src_ip", user="first_user",
)

DETECTIONS = [f"det_{i:03d}" for i in range(1, 16)]
CTES["alerts"] = " UNION ALL ".join(f"SELECT * FROM {d}" for d in DETECTIONS)
CTES["keyed"] = """
SELECT *, CASE WHEN coalesce(dedup_key, '') <> '' THEN rule_id || ':' || dedup_key
  ELSE rule_id || ':' || coalesce(source_ip, 'None') || ':' || coalesce(username, 'None') || ':' || coalesce(x_auid::varchar, '') END AS key
FROM alerts"""
CTES["ranked"] = """
SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord_rule, ord_at, ord_seq) AS rk FROM keyed"""
CTES["deduped"] = "SELECT * FROM ranked WHERE rk = 1"
CTES["techniques"] = "VALUES " + ", ".join(f"('{t}', '{n}')" for t, n in K.TECHNIQUES)

ALERT_COLUMNS = (
    "rule_id, technique, severity, first_seen, last_seen, source_ip, username, description,"
    " log_source, dedup_key, extra"
)


def _uses(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{re.escape(name)}\b", text) is not None


def query(body: str) -> str:
    """`body` with every sub-query it needs in front."""
    names = list(CTES)
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for full in names:
            short = full.split("(")[0]
            if full not in needed and _uses(text, short):
                needed.add(full)
                texts.append(CTES[full])
    parts = [
        f"{name if name != 'techniques' else 'techniques(technique, name)'} AS ({CTES[name]})"
        for name in names
        if name in needed
    ]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
