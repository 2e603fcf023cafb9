"""Every operator as a query over the given tables, with the same query in SQL for checking.

Raw logs are derived from the whole `events` table. Results show times as epoch microseconds and
maps and lists as text, so that two engines can be compared value by value.
"""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions import audit as audit_fn
from emberwatch.functions import auth as auth_fn
from emberwatch.functions import cloud as cloud_fn
from emberwatch.functions import honeypot as pot_fn
from emberwatch.functions import predicates as P
from emberwatch.functions import text as X
from emberwatch.functions import times as T
from emberwatch.operators.burst import burst_windows
from emberwatch.operators.dedup import dedup_key, history_plus_new, keep_first, new_alerts, unknown_alerts, with_run
from emberwatch.operators.success import success_after_failures
from emberwatch.plans import duck as D
from emberwatch.plans import reports as R
from emberwatch.plans.alerts import Rule, alert, union_all
from emberwatch.plans.rules import rule_book
from emberwatch.plans.sigma import sigma_filter
from emberwatch.session import configure, shared_folder
from emberwatch.sources import alert_store, files, session_store
from emberwatch.sources import standin as S
from emberwatch.sources.key_index import KeyIndex

c = F.col
Query = Callable[[SparkSession, str], DataFrame]

WEEK, AUDIT_WINDOW = D.WEEK, D.AUDIT_W
# The derived logs are sparse, so windows are days and not seconds.
PARAMETERS = {
    "det_001": dict(window_seconds=WEEK),
    "det_007": dict(window_seconds=WEEK),
    "det_012": dict(threshold=D.AUDIT_N, window_seconds=AUDIT_WINDOW),
    "det_013": dict(threshold=D.AUDIT_N, window_seconds=AUDIT_WINDOW),
}


class Logs:
    """Raw lines, typed events and alerts derived from the events of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self.base = S.read_base(spark, folder)

    @cached_property
    def auth(self) -> auth_fn.Normalized:
        return auth_fn.normalize_auth(S.auth_lines(self.base), S.YEAR)

    @cached_property
    def audit(self) -> auth_fn.Normalized:
        return audit_fn.normalize_audit(S.audit_lines(self.base))

    @cached_property
    def cloud(self) -> auth_fn.Normalized:
        return cloud_fn.normalize_cloud(cloud_fn.records_from_json(S.cloud_lines(self.base)))

    @cached_property
    def honeypot(self) -> auth_fn.Normalized:
        return pot_fn.normalize_honeypot(S.honeypot_lines(self.base))

    def events(self, source: str) -> DataFrame:
        table = {
            K.AUTH_LOG: "auth", K.AUDITD: "audit", K.CLOUDTRAIL: "cloud", K.COWRIE: "honeypot",
        }[source]
        return getattr(self, table).events

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {source: self.events(source) for source in K.LOG_SOURCES}

    @cached_property
    def sessions(self) -> DataFrame:
        return pot_fn.sessionize(self.honeypot.events)

    @cached_property
    def logins(self) -> DataFrame:
        return pot_fn.login_attempts(self.honeypot.events)

    def written(self, source: str) -> DataFrame:
        """The event table of a source as rules read it, written once: rules that pass over it
        more than once then read columns instead of parsing lines again. The line and its open
        tail are for forensics and not for rules, so they are left out here."""
        path = shared_folder(self.spark, f"events-{source}")
        self.events(source).drop("raw", "extra").write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def alerts(self) -> DataFrame:
        """All alerts of all rules. The two tables that several rules pass over are written first;
        the rules of the other two share one pass."""
        passes = {source: self.written(source) for source in (K.AUTH_LOG, K.AUDITD)}
        return rule_book().run({**self.tables, **passes}, **PARAMETERS)

    @cached_property
    def stored_alerts(self) -> DataFrame:
        """The alert table, as reports read it. It is written by the first query that needs it
        and shared by the later ones of the same application."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _ALERT_TABLES:
            path = shared_folder(self.spark, "alerts")
            alert_store.append_alerts(self.alerts, path)
            _ALERT_TABLES[key] = path
        return alert_store.load_alerts(self.spark, _ALERT_TABLES[key])


_ALERT_TABLES: dict[tuple[str, str], str] = {}


class LandedLogs(Logs):
    """The same logs as text in several files, read back: the scan numbers the lines."""

    def _landed(self, lines: DataFrame, source: str) -> auth_fn.Normalized:
        path = _land_in_order(self, lines, source)
        return files.read_events(self.spark, path, source, S.YEAR, order="name")

    @cached_property
    def auth(self) -> auth_fn.Normalized:
        return self._landed(S.auth_lines(self.base), K.AUTH_LOG)

    @cached_property
    def audit(self) -> auth_fn.Normalized:
        return self._landed(S.audit_lines(self.base), K.AUDITD)

    @cached_property
    def honeypot(self) -> auth_fn.Normalized:
        return self._landed(S.honeypot_lines(self.base), K.COWRIE)


def landed(logs: Logs) -> LandedLogs:
    return LandedLogs(logs.spark, logs.folder)


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def map_text(column: Column) -> Column:
    pairs = F.transform(
        F.map_entries(column),
        lambda e: F.concat(e["key"], F.lit("="), X.or_none(e["value"])),
    )
    return F.array_join(F.array_sort(pairs), ";")


def alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "rule_id", "technique", "severity", micros("first_seen"), micros("last_seen"),
        "source_ip", "username", "description", "log_source", "dedup_key",
        map_text(c("extra")).alias("extra"),
    )


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a function of `Logs` under a name, with its SQL."""

    def register(build: Callable[[Logs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Logs(spark, folder))
        if sql is not None:
            SQL[name] = D.query(sql)
        return build

    return register


# --- sources -------------------------------------------------------------------------------------
def _land(logs: Logs, lines: DataFrame, name: str) -> str:
    """Write lines as text files, with blank lines between some of them."""
    path = shared_folder(logs.spark, name)
    blank = lines.filter("seq % 10 = 0").select(F.lit("  ").alias("value"))
    lines.select("value").unionByName(blank).write.text(path)
    return path


def _land_in_order(logs: Logs, lines: DataFrame, name: str, path: str | None = None) -> str:
    """Write lines as a log in several text files of about equal, never quite equal size, named in
    log order. Ranges are as many as shuffle partitions, so that they grow with the cluster."""
    path = path or shared_folder(logs.spark, name)
    pieces = max(int(logs.spark.conf.get("spark.sql.shuffle.partitions")), 3)
    ordered = lines.repartitionByRange(pieces, "seq").sortWithinPartitions("seq")
    blank = F.when(c("seq") % 10 == 0, F.lit("\n  ")).otherwise(F.lit(""))
    ordered.select(F.concat("value", blank).alias("value")).write.mode("append").text(path)
    return path


@query("src_1", "SELECT raw AS value FROM auth_lines")
def src_1(logs):
    return files.read_lines(logs.spark, _land(logs, S.auth_lines(logs.base), "auth")).select("value")


@query("src_2", "SELECT value FROM audit_lines")
def src_2(logs):
    return files.read_lines(logs.spark, _land(logs, S.audit_lines(logs.base), "audit")).select(
        "value"
    )


BUNDLE = 1000


def _land_cloud(logs: Logs, damaged: bool) -> str:
    """Records in gzip files of up to 1000, as the cloud delivers them. If asked for, some files
    are cut off and some have no records."""
    path = shared_folder(logs.spark, "cloud")
    bundles = (
        S.cloud_lines(logs.base)
        .groupBy(F.expr(f"seq div {BUNDLE}").alias("bundle"))
        .agg(F.array_join(F.collect_list("value"), ",").alias("records"))
    )
    whole = F.concat(F.lit('{"Records":['), c("records"), F.lit("]}"))
    text = whole if not damaged else (
        F.when(c("bundle") % 7 == 3, F.concat(F.lit('{"Records":['), F.substr("records", F.lit(1), F.lit(500))))
        .when(c("bundle") % 7 == 5, F.lit('{"Other":[]}'))
        .otherwise(whole)
    )
    (
        bundles.select(text.alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .text(path)
    )
    return path


_WHOLE = f"(seq // {BUNDLE}) % 7 NOT IN (3, 5)"


@query(
    "src_3",
    f"SELECT event_name, source_ip, raw ->> '$.eventTime' AS event_time FROM cloud_all WHERE {_WHOLE}",
)
def src_3(logs):
    records, _ = files.read_cloud_files(logs.spark, _land_cloud(logs, damaged=True))
    return records.select(cloud_fn.typed_record(c("record")).alias("r")).select(
        c("r.eventName").alias("event_name"),
        c("r.sourceIPAddress").alias("source_ip"),
        c("r.eventTime").alias("event_time"),
    )


@query("src_4", "SELECT session_id, eventid, src_ip, epoch_us(ts) AS ts FROM pot")
def src_4(logs):
    path = _land(logs, S.honeypot_lines(logs.base), "honeypot")
    events = files.read_events(logs.spark, path, K.COWRIE).events
    return events.select("session_id", "eventid", "src_ip", micros("ts"))


def _write_logs(lines: DataFrame, folder: str, host: Column) -> None:
    """One log for each of four hosts, whole and in the order of `part` and `seq`, so that a later
    call with more parts leaves the files longer than before."""

    def write(rows) -> None:
        from emberwatch.sources.growing import opened as file_system

        opened = {}
        for row in rows:
            if row["host"] not in opened:
                place, path = file_system(f"{folder}/host-{row['host']}.log")
                place.create_dir(path.rpartition("/")[0])
                opened[row["host"]] = place.open_output_stream(path)
            opened[row["host"]].write(row["value"].encode() + b"\n")
        for out in opened.values():
            out.close()

    hosts = lines.withColumn("host", host).repartition("host")
    hosts.sortWithinPartitions("host", "part", "seq").foreachPartition(write)


def _rotate(spark: SparkSession, folder: str) -> None:
    """Rename the logs in a folder, as a log rotation does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):
        if found.getPath().getName().endswith(".log"):
            files.rename(found.getPath(), found.getPath().suffix(".1"))


@query("src_5", "SELECT raw AS value FROM auth_lines")
def src_5(logs):
    """Logs that grow, are rotated with lines not read yet, and begin anew: three runs on one
    checkpoint give every line once."""
    from emberwatch.sources import growing
    from emberwatch.streaming.run import run_available

    spark = logs.spark
    folder, out, state = (shared_folder(spark, name) for name in ("logs", "lines", "state"))
    lines = S.auth_lines(logs.base).withColumn("part", c("seq") % 7)
    for parts, rotate in (("part < 2", False), ("part < 4", False), ("part < 5", True), ("part >= 5", False)):
        _write_logs(lines.filter(parts), folder, c("seq") % 4)
        if rotate:
            _rotate(spark, folder)
        else:
            run_available(growing.follow(spark, f"{folder}/host-*"), out, state)
    return spark.read.parquet(out).select("value")


@query(
    "src_6",
    "SELECT count(*) AS first_run, 0::bigint AS second_run FROM cloud_all",
)
def src_6(logs):
    """All files, then only files named after the last one seen."""
    path = _land_cloud(logs, damaged=False)
    newest = files.last_file_name(logs.spark, path).first()["last_file"]
    first, _ = files.read_cloud_files(logs.spark, path)
    second, _ = files.read_cloud_files(logs.spark, path, after=newest)
    return (
        first.select(F.lit(1).alias("run"))
        .unionByName(second.select(F.lit(2).alias("run")))
        .agg(
            F.count_if(c("run") == 1).alias("first_run"),
            F.count_if(c("run") == 2).alias("second_run"),
        )
    )


@query("src_7", "SELECT raw, coalesce(reason, 'ok') AS status FROM auth_checked")
def src_7(logs):
    path = _land(logs, S.auth_lines(logs.base), "auth")
    checked = files.read_events(logs.spark, path, K.AUTH_LOG, S.YEAR).checked
    return checked.select("raw", F.coalesce("reason", F.lit("ok")).alias("status"))


@query("src_8", f"SELECT {D.ALERT_COLUMNS} FROM alerts")
def src_8(logs):
    return alert_rows(logs.stored_alerts)


@query(
    "src_9",
    "SELECT seq % 2 + 1 AS run, event_name, source_ip, raw ->> '$.eventTime' AS event_time FROM cloud_all",
)
def src_9(logs):
    """Half of the records land, a run takes them, then the others land in files named later and a
    second run takes only those."""
    path, out = shared_folder(logs.spark, "cloud"), shared_folder(logs.spark, "records")
    newest = None
    for half in (0, 1):
        (
            S.cloud_lines(logs.base).filter(c("seq") % 2 == half)
            .groupBy(F.expr(f"seq div {BUNDLE}").alias("bundle"))
            .agg(F.array_join(F.collect_list("value"), ",").alias("records"))
            .select(F.concat(F.lit('{"Records":['), c("records"), F.lit("]}")).alias("value"))
            .write.mode("append").option("maxRecordsPerFile", 1).option("compression", "gzip")
            .option("mapreduce.output.basename", f"landing-{half}").text(path)
        )
        records, _ = files.read_cloud_files(logs.spark, path, after=newest)
        records.select(
            F.lit(half + 1).cast("bigint").alias("run"), cloud_fn.typed_record(c("record")).alias("r")
        ).write.mode("append").parquet(out)
        newest = files.last_file_name(logs.spark, path).first()["last_file"]
    return logs.spark.read.parquet(out).select(
        "run",
        c("r.eventName").alias("event_name"),
        c("r.sourceIPAddress").alias("source_ip"),
        c("r.eventTime").alias("event_time"),
    )


# --- sinks ---------------------------------------------------------------------------------------
@query("snk_1", f"SELECT {D.ALERT_COLUMNS} FROM deduped")
def snk_1(logs):
    """Two runs over the same alerts: the second finds nothing new."""
    path = shared_folder(logs.spark, "history")
    for run in (1, 2):
        alert_store.store_new_alerts(logs.spark, logs.stored_alerts, path, run)
    return alert_rows(alert_store.load_alerts(logs.spark, path))


_SUMMARY_SQL = """SELECT 12::bigint AS total_techniques, count(DISTINCT technique) AS detected,
  12 - count(DISTINCT technique) AS missed,
  round(count(DISTINCT technique) / 12.0::double * 100, 1) AS coverage_percent, count(*) AS total_alerts,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
  count(*) FILTER (WHERE severity = 'INFO') AS info,
  count(*) FILTER (WHERE log_source = 'auditd') AS auditd,
  count(*) FILTER (WHERE log_source = 'auth_log') AS auth_log,
  count(*) FILTER (WHERE log_source = 'cloudtrail') AS cloudtrail,
  count(*) FILTER (WHERE log_source = 'cowrie') AS cowrie FROM alerts"""


@query("snk_2", _SUMMARY_SQL)
def snk_2(logs):
    folder = shared_folder(logs.spark, "report")
    R.write_report(logs.stored_alerts, folder)
    stored = logs.spark.read.schema(
        "total_techniques BIGINT, detected BIGINT, missed BIGINT, coverage_percent DOUBLE,"
        " total_alerts BIGINT, severity_counts MAP<STRING,BIGINT>, source_counts MAP<STRING,BIGINT>"
    ).json(f"{folder}/summary")
    return _summary_rows(stored)


def _summary_rows(summary: DataFrame) -> DataFrame:
    return summary.select(
        "total_techniques", "detected", "missed", "coverage_percent", "total_alerts",
        *[c("severity_counts")[s].alias(s.lower()) for s in K.SEVERITIES],
        *[F.coalesce(c("source_counts")[s], F.lit(0)).alias(s) for s in K.LOG_SOURCES],
    )


@query(
    "snk_3",
    """SELECT session_id, src_ip, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time,
  duration_ms, login_attempt_count AS logins, command_count AS commands FROM sessions""",
)
def snk_3(logs):
    """Stored twice; sessions and their children are there once."""
    folder = shared_folder(logs.spark, "sessions")
    events = logs.written(K.COWRIE)
    for _ in range(2):
        session_store.store_sessions(logs.spark, events, folder)
    stored = session_store.read_sessions(logs.spark, folder)
    logins = stored["session_logins"].groupBy("session_id").agg(F.count("*").alias("logins"))
    typed = stored["session_commands"].groupBy("session_id").agg(F.count("*").alias("commands"))
    return (
        stored["sessions"]
        .join(logins, "session_id", "left")
        .join(typed, "session_id", "left")
        .na.fill(0, ["logins", "commands"])
        .select(
            "session_id", "src_ip", micros("start_time"), micros("end_time"), "duration_ms",
            "logins", "commands",
        )
    )


def _block_changes(logs: Logs) -> DataFrame:
    """All addresses blocked, those without a break-in unblocked, busy ones blocked again."""
    at = lambda day: F.lit(f"2024-03-0{day} 00:00:00").cast("timestamp")
    per_ip = logs.sessions.groupBy(c("src_ip").alias("ip")).agg(
        F.sum("success_count").alias("s"), F.sum("command_count").alias("n")
    )
    sessions, logins = logs.sessions, logs.logins
    return union_all(
        [
            session_store.block(per_ip, sessions, logins, "seen", at=at(1)),
            session_store.unblock(per_ip.filter("s < 13"), at=at(2)),
            session_store.block(
                per_ip.filter("n >= 13"), sessions, logins, "busy", "auto", at=at(3)
            ),
        ]
    )


_BLOCKED_SQL = """(SELECT src_ip AS ip, sum(login_attempt_count)::bigint AS attempt_count,
  count(*) AS session_count, CASE WHEN sum(command_count) >= 13 THEN 'busy' ELSE 'seen' END AS reason,
  CASE WHEN sum(command_count) >= 13 THEN 'auto' ELSE 'manual' END AS blocked_by FROM sessions
  GROUP BY src_ip HAVING sum(command_count) >= 13 OR sum(success_count) >= 13)"""


@query("snk_4", f"SELECT * FROM {_BLOCKED_SQL}")
def snk_4(logs):
    """A block list from its snapshot, made after the first changes, and the log of the later ones."""
    folder = shared_folder(logs.spark, "blocks")
    path = shared_folder(logs.spark, "changes")
    _block_changes(logs).write.parquet(path)
    changes = logs.spark.read.parquet(path)
    first = c("changed_at") < F.lit("2024-03-02").cast("timestamp")
    session_store.append_changes(changes.filter(first), folder)
    session_store.compact_changes(logs.spark, folder)
    session_store.append_changes(changes.filter(~first), folder)
    return session_store.blocked_list(session_store.block_changes(logs.spark, folder)).drop("blocked_at")


# --- normalisation -------------------------------------------------------------------------------
def _parsed_auth(logs: Logs) -> DataFrame:
    return auth_fn.parse_auth(S.auth_lines(logs.base), S.YEAR)


@query("nrm_1", "SELECT seq, epoch_us(ts) AS ts FROM auth_all")
def nrm_1(logs):
    return _parsed_auth(logs).select("seq", micros("ts"))


@query("nrm_2", "SELECT seq, hostname, process, pid FROM auth_all")
def nrm_2(logs):
    return _parsed_auth(logs).select("seq", "hostname", "process", "pid")


@query(
    "nrm_3",
    """SELECT seq, kind, auth_result, username, source_ip, port, auth_method, new_username,
  sudo_command, sudo_user FROM auth_all""",
)
def nrm_3(logs):
    return _parsed_auth(logs).select(
        "seq", "kind", "auth_result", "username", "source_ip", "port", "auth_method",
        "new_username", "sudo_command", "sudo_user",
    )


@query("nrm_4", "SELECT seq, source_ip, reason FROM auth_checked")
def nrm_4(logs):
    return _parsed_auth(logs).select("seq", "source_ip", "reason")


@query(
    "nrm_5",
    r"""SELECT seq, k, arg_max(v, pos) AS v FROM (
  SELECT seq, split_part(p, '=', 1) AS k, trim(p[len(split_part(p, '=', 1)) + 2:], '"') AS v, pos FROM (
    SELECT seq, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
      SELECT seq, regexp_extract_all(value, '\w+=(?:"[^"]*"|[^\s\x1c-\x1f]+)') AS ps FROM audit_lines)))
WHERE NOT regexp_matches(k, '^[A-Z]') GROUP BY seq, k""",
)
def nrm_5(logs):
    lines = audit_fn.with_pair_map(audit_fn.with_pairs(S.audit_lines(logs.base)), "fields")
    # For a plain explode Spark first tests the size of the map, below the columns that it is made of:
    # it would take each line apart again for every look-up of a pair.
    return lines.select("seq", F.explode_outer("fields").alias("k", "v")).filter("k is not null")


@query("nrm_6", "SELECT seq, epoch, serial, path_name FROM audit_corr")
def nrm_6(logs):
    return audit_fn.correlate_audit(S.audit_lines(logs.base)).select(
        "seq", "epoch", "serial", "path_name"
    )


_AUDIT_COLUMNS = (
    "auid, uid, euid, pid, ppid, comm, exe, syscall, success, key, name, record_type"
)


@query("nrm_7", f"SELECT seq, epoch_us(ts) AS ts, {_AUDIT_COLUMNS} FROM audit")
def nrm_7(logs):
    return logs.audit.events.select("seq", micros("ts"), *_AUDIT_COLUMNS.split(", "))


_CLOUD_COLUMNS = (
    "event_version, event_source, event_name, aws_region, source_ip, user_agent, read_only,"
    " console_login, error_code"
).replace("\n", "")


@query("nrm_8", f"SELECT seq, epoch_us(ts) AS ts, {_CLOUD_COLUMNS} FROM cloud")
def nrm_8(logs):
    return logs.cloud.events.select("seq", micros("ts"), *[n.strip() for n in _CLOUD_COLUMNS.split(",")])


@query("nrm_9", "SELECT seq, actor_username, actor_type FROM cloud_all")
def nrm_9(logs):
    records = cloud_fn.records_from_json(S.cloud_lines(logs.base))
    return cloud_fn.parse_cloud(records).select("seq", "actor_username", "actor_type")


@query("nrm_10", "SELECT seq, session_mfa, mfa_authenticated FROM cloud_all")
def nrm_10(logs):
    records = cloud_fn.records_from_json(S.cloud_lines(logs.base))
    return cloud_fn.parse_cloud(records).select("seq", "session_mfa", "mfa_authenticated")


@query(
    "nrm_11",
    """SELECT session_id, src_ip, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time,
  duration_ms, login_attempt_count, success_count, command_count FROM sessions""",
)
def nrm_11(logs):
    return landed(logs).sessions.select(
        "session_id", "src_ip", micros("start_time"), micros("end_time"), "duration_ms",
        "login_attempt_count", "success_count", "command_count",
    )


@query(
    "nrm_12",
    """SELECT session_id, seq, username, password, eventid = 'cowrie.login.success' AS success,
  NULL AS command_text, epoch_us(ts) AS at FROM pot WHERE eventid LIKE 'cowrie.login.%'
UNION ALL SELECT session_id, seq, NULL, NULL, NULL, input, epoch_us(ts) FROM pot
WHERE eventid = 'cowrie.command.input'""",
)
def nrm_12(logs):
    events = logs.honeypot.events
    logins = pot_fn.login_attempts(events).withColumn("at", F.unix_micros("timestamp"))
    typed = pot_fn.commands(events).withColumn("at", F.unix_micros("ran_at"))
    return logins.drop("timestamp").unionByName(typed.drop("ran_at"), allowMissingColumns=True).select(
        "session_id", "seq", "username", "password", "success", "command_text", "at"
    )


_ALL_EVENTS_SQL = """SELECT 'auth_log' AS source, seq, epoch_us(ts) AS ts FROM auth
UNION ALL SELECT 'auditd', seq, epoch_us(ts) FROM audit
UNION ALL SELECT 'cloudtrail', seq, epoch_us(ts) FROM cloud
UNION ALL SELECT 'cowrie', seq, epoch_us(ts) FROM pot"""


@query("nrm_13", _ALL_EVENTS_SQL)
def nrm_13(logs):
    return files.all_events(logs.tables).select("source", "seq", micros("ts"))


@query(
    "nrm_14",
    """SELECT 'auth_log' AS source, count(*) FILTER (WHERE reason IS NULL) AS events,
  count(*) FILTER (WHERE reason IS NOT NULL) AS parse_errors FROM auth_checked
UNION ALL SELECT 'auditd', count(*) FILTER (WHERE auid IS NOT NULL), count(*) FILTER (WHERE auid IS NULL) FROM audit_all
UNION ALL SELECT 'cloudtrail', count(*) FILTER (WHERE reason IS NULL), count(*) FILTER (WHERE reason IS NOT NULL) FROM cloud_checked
UNION ALL SELECT 'cowrie', (SELECT count(*) FROM pot), count(*) FILTER (WHERE NOT json_valid(raw)) FROM pot_lines""",
)
def nrm_14(logs):
    return files.count_lines(
        {
            K.AUTH_LOG: logs.auth,
            K.AUDITD: logs.audit,
            K.CLOUDTRAIL: logs.cloud,
            K.COWRIE: logs.honeypot,
        }
    )


@query(
    "nrm_15",
    """SELECT event_id, epoch_us(ts) AS from_zoneless, (epoch_us(ts) // 1000) * 1000 AS from_number,
  epoch_us(ts) / 1e6::double AS epoch FROM events""",
)
def nrm_15(logs):
    events = logs.base.withColumn("zoneless", c("ts").cast("timestamp_ntz")).withColumn(
        "millis", (F.expr("unix_micros(ts) div 1000") / 1000).cast("decimal(20,3)")
    )
    return events.select(
        "event_id",
        F.unix_micros(T.as_utc(c("zoneless"), "timestamp_ntz")).alias("from_zoneless"),
        F.unix_micros(T.as_utc(c("millis"), "decimal(20,3)")).alias("from_number"),
        T.epoch_seconds(c("ts")).alias("epoch"),
    )


@query(
    "nrm_16",
    r"""SELECT 'auditd' AS source, seq, raw, 'a0=7f;arch=c000003e;exit=3;items=1;ses=2;tty=pts0' AS tail FROM audit
UNION ALL SELECT 'auth_log', seq, raw, '' FROM auth
UNION ALL SELECT 'cloudtrail', seq, raw ->> '$.eventTime', raw ->> '$.unknownField' FROM cloud""",
)
def nrm_16(logs):
    audit = logs.audit.events.select("source", "seq", "raw", map_text(c("extra")).alias("tail"))
    auth = logs.auth.events.select("source", "seq", "raw", map_text(c("extra")).alias("tail"))
    cloud = logs.cloud.events.select(
        "source",
        "seq",
        F.get_json_object("raw", "$.eventTime").alias("raw"),
        F.get_json_object("raw", "$.unknownField").alias("tail"),
    )
    return audit.unionByName(auth).unionByName(cloud)


# --- predicates ----------------------------------------------------------------------------------
def _on_audit(name: str, column: str, sql: str, build: Callable[[], Column]) -> None:
    query(name, f"SELECT seq, {sql} AS {column} FROM audit")(
        lambda logs: logs.audit.events.select("seq", build().alias(column))
    )


def _on_cloud(name: str, sql: dict[str, str], build: Callable[[], dict[str, Column]]) -> None:
    listed = ", ".join(f"{text} AS {column}" for column, text in sql.items())
    query(name, f"SELECT seq, {listed} FROM cloud")(
        lambda logs: logs.cloud.events.select("seq", *[v.alias(k) for k, v in build().items()])
    )


_on_audit("prd_1", "escalated", "escalated", lambda: P.is_escalation(c("euid"), c("auid")))
_on_audit("prd_2", "matches", "base = comm", lambda: P.exe_matches_comm(c("exe"), c("comm")))
_on_cloud("prd_3", {"used": "mfa_used"}, lambda: {"used": P.mfa_used(c("mfa_authenticated"))})
_on_cloud(
    "prd_4",
    {"console": "is_login", "succeeded": "login_ok"},
    lambda: {
        "console": P.is_console_login(c("event_name")),
        "succeeded": P.login_succeeded(c("console_login")),
    },
)
_on_cloud(
    "prd_5",
    {"suspicious": "is_login AND login_ok AND NOT mfa_used"},
    lambda: {
        "suspicious": P.is_suspicious_login(
            c("event_name"), c("console_login"), c("mfa_authenticated")
        )
    },
)
_on_cloud(
    "prd_6",
    {"without_mfa": "call_no_mfa"},
    lambda: {
        "without_mfa": P.is_call_without_mfa(
            c("actor_type"), c("mfa_authenticated"), c("error_code")
        )
    },
)
_on_audit("prd_7", "trusted", f"({D._TRUSTED})", lambda: P.in_trusted_directory(c("exe")))
_on_audit(
    "prd_8",
    "cut",
    "length(comm) = 15 AND starts_with(base, comm)",
    lambda: P.is_cut_by_kernel(c("comm"), X.basename(c("exe"))),
)
_on_audit("prd_9", "interpreter", D._INTERP, lambda: P.is_interpreter(c("exe")))


@query(
    "prd_10",
    """SELECT event_id, CASE WHEN r > 10 THEN 'aggressive' WHEN r > 3 THEN 'moderate' ELSE 'slow_scan' END AS speed,
  CASE WHEN r > 10 THEN 'CRITICAL' WHEN r > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT event_id, (user_id % 100) / greatest((epoch_us(ts) % 20000000) / 1e6::double, 1.0) AS r FROM events)""",
)
def prd_10(logs):
    rate = P.attack_rate(c("user_id") % 100, F.unix_micros("ts") % 20_000_000)
    return logs.base.select(
        "event_id", P.attack_speed(rate).alias("speed"), P.attack_severity(rate).alias("severity")
    )


@query(
    "prd_11",
    """SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 50 THEN 'CRITICAL' WHEN count(*) >= 20 THEN 'HIGH'
  WHEN count(*) >= 10 THEN 'MEDIUM' WHEN count(*) >= 3 THEN 'LOW' ELSE 'INFO' END AS severity
FROM events WHERE event_type = 'error' GROUP BY user_id""",
)
def prd_11(logs):
    counts = logs.base.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.withColumn("severity", P.severity_of_count(c("n")))


@query(
    "prd_12",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'INFO' END AS severity,
  CASE event_type WHEN 'error' THEN 'T1036' WHEN 'signup' THEN 'T1136.001' END AS technique FROM events""",
)
def prd_12(logs):
    given = F.create_map(
        *[F.lit(x) for x in ("error", "critical", "click", "Low", "view", "INFO", "signup", "bad")]
    )
    technique = F.create_map(
        *[F.lit(x) for x in ("error", "T1036", "click", "t1036", "view", "T1", "signup", "T1136.001")]
    )
    return logs.base.select(
        "event_id",
        P.clean_severity(F.try_element_at(given, c("event_type"))).alias("severity"),
        P.clean_technique(F.try_element_at(technique, c("event_type"))).alias("technique"),
    )


@query(
    "prd_13",
    f"""SELECT seq, exe IN {D._in(K.SHADOW_ALLOWED_EXES)} AS allowed_exe, key IN {D._in(K.TAMPER_KEYS)} AS tamper_key,
  coalesce(syscall IN (257, 2, 82, 86), false) AS cron_call, coalesce(name IN {D._in(K.SENSITIVE_FILES)}, false) AS sensitive
FROM audit""",
)
def prd_13(logs):
    return logs.audit.events.select(
        "seq",
        X.one_of(c("exe"), K.SHADOW_ALLOWED_EXES).alias("allowed_exe"),
        X.one_of(c("key"), K.TAMPER_KEYS).alias("tamper_key"),
        X.one_of(c("syscall"), K.CRON_SYSCALLS).alias("cron_call"),
        X.one_of(c("name"), K.SENSITIVE_FILES).alias("sensitive"),
    )


@query(
    "prd_14",
    r"""SELECT seq, array_to_string(list_sort(list_distinct(regexp_extract_all(input, '\b(wget|curl|nc|ncat|netcat)\b'))), ',') AS tools,
  regexp_matches(input, 'chmod\s+\+x') AS chmod FROM pot WHERE eventid = 'cowrie.command.input'""",
)
def prd_14(logs):
    typed = pot_fn.commands(logs.honeypot.events)
    return typed.select(
        "seq",
        F.array_join(P.download_tools(c("command_text")), ",").alias("tools"),
        P.makes_executable(c("command_text")).alias("chmod"),
    )


@query(
    "prd_15",
    f"SELECT session_id, src_ip FROM sessions WHERE src_ip IN (SELECT ip FROM {_BLOCKED_SQL})",
)
def prd_15(logs):
    rows = logs.sessions.select("session_id", "src_ip")
    return session_store.blocked_only(rows, _block_changes(logs)).select("session_id", "src_ip")


# --- detections ----------------------------------------------------------------------------------
def _detection(name: str) -> None:
    def build(logs):
        rule = rule_book().rules[name]
        if name == "det_015":  # first and last login of a session, over several files
            logs = landed(logs)
        # Windowed rules pass over their table more than once.
        passes = name in PARAMETERS
        events = logs.written(rule.source) if passes else logs.events(rule.source)
        return alert_rows(rule.run(events, **PARAMETERS.get(name, {})))

    query(name, f"SELECT {D.ALERT_COLUMNS} FROM {name}")(build)


for _name in D.DETECTIONS:
    _detection(_name)


@query("det_all", f"SELECT {D.ALERT_COLUMNS} FROM alerts")
def det_all(logs):
    return alert_rows(logs.alerts)


def _of_sources(logs: Logs, *sources: str) -> DataFrame:
    return logs.stored_alerts.filter(c("log_source").isin(*sources))


# --- joins ---------------------------------------------------------------------------------------
@query(
    "join_1",
    """SELECT source_ip, username, failures, epoch_us(first_failure) AS first_failure,
  epoch_us(last_failure) AS last_failure, epoch_us(success_time) AS success_time, gap FROM success""",
)
def join_1(logs):
    matched = success_after_failures(logs.written(K.AUTH_LOG), 5, WEEK)
    return matched.select(
        "source_ip", "username", "failures", micros("first_failure"), micros("last_failure"),
        micros("success_time"), "gap",
    )


@query("join_2", "SELECT serial, exe, name FROM audit_all")
def join_2(logs):
    path = _land_in_order(logs, S.audit_lines(logs.base), "audit")
    lines = files.read_lines(logs.spark, path, order="name")
    typed = audit_fn.type_audit(audit_fn.correlate_audit(lines))
    return typed.select("serial", "exe", "name")


@query(
    "join_3",
    """SELECT src_ip, sum(login_attempt_count)::bigint AS attempt_count FROM sessions
WHERE login_attempt_count > 0 GROUP BY src_ip""",
)
def join_3(logs):
    return session_store.logins_per_address(logs.sessions, logs.logins)


@query(
    "join_4",
    f"SELECT {D.ALERT_COLUMNS} FROM deduped WHERE log_source NOT IN ('auth_log', 'cloudtrail')",
)
def join_4(logs):
    """Alerts that are unknown to a history of two sources, whose keys lie in buckets."""
    history = _of_sources(logs, K.AUTH_LOG, K.CLOUDTRAIL)
    index = KeyIndex(logs.spark, shared_folder(logs.spark, "keys"))
    index.add(history.select(dedup_key().alias("alert_key"), F.lit(1).alias("run")))
    return alert_rows(unknown_alerts(logs.stored_alerts, index.keys()))


@query(
    "join_5",
    """SELECT session_id, seq FROM pot WHERE eventid LIKE 'cowrie.login.%'
  AND session_id NOT IN (SELECT session_id FROM sessions WHERE success_count > 0)""",
)
def join_5(logs):
    """The step by which the store finds new logins, where the lines of sessions with a break-in
    are stored already."""
    folder = shared_folder(logs.spark, "sessions")
    events = logs.written(K.COWRIE)
    broken_in = events.filter(c("eventid") == K.POT_LOGIN_OK).select("session_id").distinct()
    session_store.store_sessions(logs.spark, events.join(broken_in, "session_id", "left_semi"), folder)
    fresh = session_store.unstored(logs.spark, events, folder)
    return fresh["session_logins"].select("session_id", "seq")


_COVERAGE_SQL = """SELECT technique, name, n IS NOT NULL AS detected, coalesce(n, 0) AS alert_count, src AS log_source
FROM techniques LEFT JOIN (SELECT technique, count(*) AS n, arg_max(log_source, (ord_rule, ord_at, ord_seq)) AS src
  FROM {table} GROUP BY technique) USING (technique)"""


@query("join_6", _COVERAGE_SQL.format(table="(SELECT * FROM alerts WHERE log_source = 'cloudtrail')"))
def join_6(logs):
    """Techniques seen by the cloud rules alone; the others appear as not detected."""
    return R.technique_coverage(_of_sources(logs, K.CLOUDTRAIL))


# --- aggregations --------------------------------------------------------------------------------
@query("agg_1", _COVERAGE_SQL.format(table="alerts"))
def agg_1(logs):
    return R.technique_coverage(logs.stored_alerts)


@query(
    "agg_2",
    """SELECT 12::bigint AS total_techniques, count(DISTINCT technique) AS detected_count,
  round(count(DISTINCT technique) / 12.0::double * 100, 1) AS coverage_pct, count(*) AS total_alerts,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
  count(*) FILTER (WHERE severity = 'HIGH') AS high_count FROM alerts""",
)
def agg_2(logs):
    return R.coverage_summary(logs.stored_alerts)


@query(
    "agg_3",
    "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in reversed(K.SEVERITIES)
    )
    + " FROM alerts",
)
def agg_3(logs):
    return R.severity_counts(logs.stored_alerts)


@query("agg_4", "SELECT log_source, count(*) AS alert_count FROM alerts GROUP BY log_source")
def agg_4(logs):
    return R.source_counts(logs.stored_alerts)


_ATTACKERS_SQL = """(SELECT source_ip AS ip, x_attempts AS attempts, x_speed AS attack_speed, first_seen, last_seen,
  ord_rule, ord_at, ord_seq FROM alerts WHERE technique = 'T1110.001' AND source_ip <> '')"""
_LAST_ATTACK_SQL = f"""SELECT ip, attempts, attack_speed, first_seen, last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ord_rule DESC, ord_at DESC, ord_seq DESC) AS rk FROM {_ATTACKERS_SQL})
WHERE rk = 1"""


def _attacker_rows(table: DataFrame) -> DataFrame:
    return table.select("ip", "attempts", "attack_speed", micros("first_seen"), micros("last_seen"))


@query("agg_5", _LAST_ATTACK_SQL)
def agg_5(logs):
    return _attacker_rows(R.attacker_table(logs.stored_alerts))


@query("agg_6", f"SELECT ip, attempts, attack_speed, first_seen, last_seen FROM {_ATTACKERS_SQL}")
def agg_6(logs):
    return _attacker_rows(R.attacker_list(logs.stored_alerts))


@query("agg_7", "SELECT x_auid AS auid, count(*) AS alert_count FROM alerts WHERE x_auid IS NOT NULL GROUP BY x_auid")
def agg_7(logs):
    return R.alerts_per_auid(logs.stored_alerts)


_USER_TECHNIQUES_SQL = """(SELECT auid, string_agg(technique, ',' ORDER BY o) AS techniques FROM (
  SELECT x_auid AS auid, technique, min((ord_rule, ord_at, ord_seq)) AS o FROM alerts
  WHERE x_auid IS NOT NULL GROUP BY x_auid, technique) GROUP BY auid)"""


@query("agg_8", f"SELECT * FROM {_USER_TECHNIQUES_SQL}")
def agg_8(logs):
    table = R.techniques_per_auid(logs.stored_alerts)
    return table.select("auid", F.array_join("techniques", ",").alias("techniques"))


@query(
    "agg_9",
    """SELECT x_auid::varchar AS auid_human, x_auid AS auid, x_euid AS euid, technique, x_comm AS comm
FROM alerts WHERE technique = 'T1548' AND x_auid IS NOT NULL""",
)
def agg_9(logs):
    return R.escalations(logs.stored_alerts).drop("timestamp", "ord")


_PROFILE_NOW = "2024-01-30 12:00:00"


@query(
    "agg_10",
    f"""SELECT *, least(least(total_attempts * 2, 60) + len(string_split(techniques_used, ',')) * 10
    + CASE attack_speed WHEN 'aggressive' THEN 20 WHEN 'moderate' THEN 10 ELSE 0 END, 100)::bigint AS threat_score
FROM (SELECT source_ip AS ip, coalesce(sum(x_attempts), 0)::bigint AS total_attempts,
    string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques_used,
    arg_max(x_speed, (ord_rule, ord_at, ord_seq)) FILTER (WHERE x_speed IS NOT NULL) AS attack_speed,
    min(first_seen) AS first_seen, max(coalesce(last_seen, first_seen)) AS last_seen,
    epoch_us(timestamp '{_PROFILE_NOW}') - max(coalesce(last_seen, first_seen)) BETWEEN 0 AND 86400000000 AS is_active
  FROM alerts WHERE source_ip <> '' GROUP BY source_ip)""",
)
def agg_10(logs):
    table = R.attacker_profiles(logs.stored_alerts, F.lit(_PROFILE_NOW).cast("timestamp"))
    return table.select(
        "ip", "total_attempts", F.array_join("techniques_used", ",").alias("techniques_used"),
        "attack_speed", micros("first_seen"), micros("last_seen"), "is_active",
        c("threat_score").cast("bigint").alias("threat_score"),
    )


@query(
    "agg_11",
    """SELECT x_auid AS auid, count(*) AS alert_count, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
  coalesce(bool_or(x_euid = 0 AND x_auid NOT IN (0, 4294967295)), false) AS escalated
FROM alerts WHERE x_auid IS NOT NULL GROUP BY x_auid""",
)
def agg_11(logs):
    table = R.user_profiles(logs.stored_alerts)
    n = lambda s: F.coalesce(c("severity_counts")[s], F.lit(0)).alias(s.lower())
    return table.select(
        "auid", "alert_count", F.array_join("techniques_triggered", ",").alias("techniques"),
        n("CRITICAL"), n("HIGH"), n("MEDIUM"), c("is_privileged_escalation").alias("escalated"),
    )


@query(
    "agg_12",
    """SELECT src_ip, count(*) AS session_count, sum(login_attempt_count)::bigint AS attempt_count
FROM sessions GROUP BY src_ip""",
)
def agg_12(logs):
    return session_store.block_counts(logs.sessions, logs.logins)


@query(
    "agg_13",
    """SELECT 12::bigint AS total_techniques, count(DISTINCT technique) AS detected, 12 - count(DISTINCT technique) AS missed,
  round(count(DISTINCT technique) / 12.0::double * 100, 1) AS coverage_percent, count(*) AS total_alerts FROM alerts""",
)
def agg_13(logs):
    return R.report_totals(logs.stored_alerts)


# --- windows -------------------------------------------------------------------------------------
D.burst(
    "errors",
    "SELECT user_id, epoch_us(ts) AS t, event_id AS seq, value FROM events WHERE event_type = 'error'",
    "user_id", 5, WEEK,
)


def _error_bursts(logs: Logs, **columns) -> DataFrame:
    errors = logs.base.filter("event_type = 'error'").withColumnRenamed("event_id", "seq")
    return burst_windows(errors, ["user_id"], 5, WEEK, **columns)


@query("win_1", "SELECT user_id, first_t AS first_seen, t AS last_seen, seq, value FROM errors")
def win_1(logs):
    hits = _error_bursts(logs, last=["value"])
    return hits.select("user_id", micros("first_seen"), micros("last_seen"), "seq", "value")


@query(
    "win_2",
    """SELECT p.user_id, min(r.t) AS first_seen, max(r.t) AS last_seen, string_agg(r.seq::varchar, ',' ORDER BY r.rn) AS members
FROM errors_pick p JOIN errors_rows r ON r.user_id = p.user_id AND r.rn > p.rn - 5 AND r.rn <= p.rn GROUP BY p.user_id, p.rn""",
)
def win_2(logs):
    hits = _error_bursts(logs, members=["seq"])
    return hits.select(
        "user_id", micros("first_seen"), micros("last_seen"),
        F.array_join(c("seq_members").cast("array<string>"), ",").alias("members"),
    )


@query("win_3", f"SELECT {D.ALERT_COLUMNS} FROM deduped WHERE log_source = 'auditd'")
def win_3(logs):
    return alert_rows(keep_first(_of_sources(logs, K.AUDITD)))


@query(
    "win_4",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events)
WHERE rk = 1""",
)
def win_4(logs):
    order = F.struct("ts", "event_id")
    return (
        logs.base.groupBy("user_id")
        .agg(F.max_by(F.struct("event_id", "event_type"), order).alias("l"))
        .select("user_id", "l.*")
    )


# --- sorts ---------------------------------------------------------------------------------------
@query(
    "srt_1",
    f"""SELECT {D.ALERT_COLUMNS}, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 9 END AS rank
FROM alerts ORDER BY rank, ord_rule, ord_at, ord_seq""",
)
def srt_1(logs):
    ranked = R.alerts_by_severity(logs.stored_alerts)
    # The rank is shown next to the alert; the order is that of the sorted rows.
    return ranked.select(
        *alert_rows_columns(), R.severity_rank(c("severity")).alias("rank")
    )


def alert_rows_columns() -> list[Column]:
    return [
        c("rule_id"), c("technique"), c("severity"), micros("first_seen"), micros("last_seen"),
        c("source_ip"), c("username"), c("description"), c("log_source"), c("dedup_key"),
        map_text(c("extra")).alias("extra"),
    ]


@query(
    "srt_2",
    "SELECT src_ip, session_id, epoch_us(start_time) AS start_time FROM sessions ORDER BY src_ip, start_time DESC, session_id",
)
def srt_2(logs):
    ordered = session_store.newest_sessions(logs.sessions)
    return ordered.select("src_ip", "session_id", micros("start_time"))


@query(
    "srt_3",
    """SELECT session_id, epoch_us(ts) AS ran_at, input AS command_text FROM pot WHERE eventid = 'cowrie.command.input'
ORDER BY session_id, ts, seq""",
)
def srt_3(logs):
    ordered = session_store.oldest_commands(pot_fn.commands(logs.honeypot.events))
    return ordered.select("session_id", micros("ran_at"), "command_text")


@query(
    "srt_4",
    f"""SELECT *, CASE WHEN reason = 'busy' THEN epoch_us(timestamp '2024-03-03') ELSE epoch_us(timestamp '2024-03-01') END AS blocked_at
FROM {_BLOCKED_SQL} ORDER BY blocked_at DESC, ip""",
)
def srt_4(logs):
    return session_store.blocked_list(_block_changes(logs)).select(
        "ip", "attempt_count", "session_count", "reason", "blocked_by", micros("blocked_at")
    )


@query(
    "srt_5",
    "SELECT source_ip, epoch_us(ts) AS ts, seq FROM auth WHERE auth_result = 'failed' ORDER BY source_ip, ts, seq",
)
def srt_5(logs):
    failed = logs.auth.events.filter("auth_result = 'failed'")
    return failed.orderBy("source_ip", "ts", "seq").select("source_ip", micros("ts"), "seq")


# --- sets ----------------------------------------------------------------------------------------
@query("set_1", "SELECT rule_id, severity, count(*) AS n FROM alerts GROUP BY rule_id, severity")
def set_1(logs):
    return logs.stored_alerts.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(
    "set_2",
    """SELECT run, log_source, count(*) AS n FROM (
  SELECT CASE WHEN log_source IN ('auth_log', 'cloudtrail') THEN 1 ELSE 2 END::bigint AS run, log_source FROM deduped) GROUP BY run, log_source""",
)
def set_2(logs):
    wanted = ["log_source", "ord"]
    first = _of_sources(logs, K.AUTH_LOG, K.CLOUDTRAIL)
    history = with_run(keep_first(first, wanted), 1)
    fresh = with_run(new_alerts(logs.stored_alerts, history, wanted), 2)
    both = history_plus_new(history, fresh)
    return both.groupBy(c("ord.run").alias("run"), "log_source").agg(F.count("*").alias("n"))


@query("set_3", f"SELECT key, {D.ALERT_COLUMNS} FROM deduped")
def set_3(logs):
    first = keep_first(landed(logs).alerts)
    return first.select(dedup_key().alias("key"), *alert_rows_columns())


@query(
    "set_4",
    """SELECT log_source, count(DISTINCT technique) AS n, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques
FROM alerts GROUP BY log_source""",
)
def set_4(logs):
    distinct = logs.stored_alerts.groupBy("log_source", "technique").agg(F.count("*").alias("alerts"))
    return distinct.groupBy("log_source").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("technique")), ",").alias("techniques"),
    )


# --- scalar functions ----------------------------------------------------------------------------
_on_audit("fn_1", "base", "base", lambda: X.basename(c("exe")))


@query(
    "fn_2",
    """SELECT seq, exe || ':' || auid || ':' || coalesce(name, 'None') AS text, upper(comm) AS up, length(comm) AS n,
  starts_with(exe, '/usr/') AS usr, trim('  ' || comm || ' ') AS trimmed, string_split(exe, '/')[2] AS part FROM audit""",
)
def fn_2(logs):
    return logs.audit.events.select(
        "seq",
        X.message("{}:{}:{}", c("exe"), c("auid"), c("name")).alias("text"),
        F.upper("comm").alias("up"),
        F.length("comm").alias("n"),
        c("exe").startswith("/usr/").alias("usr"),
        X.strip(F.concat(F.lit("  "), "comm", F.lit(" "))).alias("trimmed"),
        F.split("exe", "/")[1].alias("part"),
    )


@query(
    "fn_3",
    r"""SELECT seq, regexp_extract(value, 'type=(\w+)', 1) AS kind, len(regexp_extract_all(value, '\w+=')) AS pairs,
  regexp_matches(value, '^type=PATH') AS is_path FROM audit_lines""",
)
def fn_3(logs):
    return S.audit_lines(logs.base).select(
        "seq",
        F.regexp_extract("value", r"type=(\w+)", 1).alias("kind"),
        F.size(F.regexp_extract_all("value", F.lit(r"\w+="), F.lit(0))).cast("bigint").alias("pairs"),
        c("value").rlike("^type=PATH").alias("is_path"),
    )


@query(
    "fn_4",
    f"""SELECT event_id, {D._pytime('epoch_us(ts)')} AS text, round_even((epoch_us(ts) % 60000000) / 1e6, 0)::bigint::varchar AS secs,
  epoch_us(ts) AS us FROM events""",
)
def fn_4(logs):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return logs.base.select(
        "event_id",
        X.time_text(c("ts")).alias("text"),
        X.whole_seconds(F.unix_micros("ts") % 60_000_000).alias("secs"),
        F.unix_micros(T.iso_time(iso)).alias("us"),
    )


@query(
    "fn_5",
    """SELECT event_id, greatest(value, 10.0) AS hi, least(value, 10.0) AS lo, value / 2 AS half, round(user_id / 12.0::double * 100, 1) AS pct,
  least(least((user_id % 100) * 2, 60) + (event_id % 5) * 10 + CASE event_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END, 100)::bigint AS score
FROM events""",
)
def fn_5(logs):
    speed = F.when(c("event_id") % 3 == 0, K.AGGRESSIVE).when(c("event_id") % 3 == 1, K.MODERATE)
    return logs.base.select(
        "event_id",
        F.greatest("value", F.lit(10.0)).alias("hi"),
        F.least("value", F.lit(10.0)).alias("lo"),
        (c("value") / 2).alias("half"),
        F.round(c("user_id") / 12 * 100, 1).alias("pct"),
        P.threat_score(c("user_id") % 100, c("event_id") % 5, F.coalesce(speed, F.lit(K.SLOW_SCAN)))
        .cast("bigint")
        .alias("score"),
    )


@query(
    "fn_6",
    """SELECT seq, raw ->> '$.userIdentity.type' AS kind, raw ->> '$.userIdentity.sessionContext.attributes.mfaAuthenticated' AS mfa,
  raw ->> '$.responseElements.ConsoleLogin' AS login, cast(raw ->> '$.unknownField' AS bigint) AS open_field FROM cloud_lines""",
)
def fn_6(logs):
    records = S.cloud_lines(logs.base).withColumn("r", cloud_fn.typed_record(c("value")))
    return records.select(
        "seq",
        c("r.userIdentity.type").alias("kind"),
        cloud_fn.session_mfa(c("r")).alias("mfa"),
        c("r.responseElements.ConsoleLogin").alias("login"),
        F.get_json_object("value", "$.unknownField").cast("bigint").alias("open_field"),
    )


@query("fn_7", "SELECT session_id, download_tools AS tools, chmod_x_used FROM sessions")
def fn_7(logs):
    return logs.sessions.select(
        "session_id", F.array_join("download_tools", ",").alias("tools"), "chmod_x_used"
    )


_DISPLAY_SQL = """SELECT rule_id AS rule_name, description AS reason, severity, technique, x_auid AS auid, x_auid::varchar AS auid_human,
  x_attempts AS attempts, x_file AS cron_file, NULL::varchar AS created_by, technique = 'T1548' AS privilege_escalated,
  coalesce(x_signal = 'name_mismatch', false) AS name_suspicious, x_comm AS comm FROM alerts"""


def _display_rows(shown: DataFrame) -> DataFrame:
    return shown.select(
        "rule_name", "reason", "severity", "technique", "auid", "auid_human", "attempts",
        "cron_file", "created_by", "privilege_escalated", "name_suspicious", "comm",
    )


@query("fn_8", _DISPLAY_SQL)
def fn_8(logs):
    return _display_rows(R.display_alerts(logs.stored_alerts))


# --- views ---------------------------------------------------------------------------------------
_TECHNIQUES_VIEW_SQL = """(SELECT technique, name, n IS NOT NULL AS detected,
  CASE WHEN n IS NULL THEN 'missed' ELSE 'detected' END AS status, coalesce(n, 0) AS alert_count
FROM techniques LEFT JOIN (SELECT technique, count(*) AS n FROM alerts GROUP BY technique) USING (technique))"""
_USER_VIEW_SQL = f"""SELECT 'auid_alert_counts' AS part, x_auid::varchar AS key, '{{"alert_count":' || count(*) || '}}' AS value
FROM alerts WHERE x_auid IS NOT NULL GROUP BY x_auid
UNION ALL SELECT 'user_technique_map', auid::varchar, '{{"techniques":["' || replace(techniques, ',', '","') || '"]}}' FROM {_USER_TECHNIQUES_SQL}
UNION ALL SELECT 'privilege_escalations', x_auid::varchar, '{{"auid":' || x_auid || ',"euid":' || x_euid || ',"technique":"' || technique || '","comm":"' || x_comm || '"}}'
FROM alerts WHERE technique = 'T1548' AND x_auid IS NOT NULL
UNION ALL SELECT 'ssh_attackers', ip, '{{' || coalesce('"attempts":' || attempts, '') || coalesce(',"attack_speed":"' || attack_speed || '"', '') || '}}'
FROM ({_LAST_ATTACK_SQL})"""
_FIELDS = {
    "summary": "total_techniques BIGINT, detected BIGINT, missed BIGINT, total_alerts BIGINT, severity_counts STRUCT<"
    + ", ".join(f"{s}: BIGINT" for s in reversed(K.SEVERITIES)) + ">",
    "privilege_escalations": "auid BIGINT, euid BIGINT, technique STRING, comm STRING",
    "ssh_attackers": "attempts BIGINT, attack_speed STRING",
}


def _with_fields(rows: DataFrame, part: str) -> DataFrame:
    """Rows of a report whose parts in _FIELDS have those fields only."""
    value = c("value")
    for name, fields in _FIELDS.items():
        value = F.when(c(part) == name, F.to_json(F.from_json("value", fields))).otherwise(value)
    return rows.withColumn("value", value)


@query(
    "vw_1",
    f"""SELECT 'summary' AS section, '' AS key, '{{"total_techniques":12,"detected":' || detected || ',"missed":' || missed || ',"total_alerts":' || total_alerts
  || ',"severity_counts":{{"CRITICAL":' || critical || ',"HIGH":' || high || ',"MEDIUM":' || medium || ',"LOW":' || low || ',"INFO":' || info || '}}}}' AS value
FROM ({_SUMMARY_SQL})
UNION ALL SELECT 'techniques', technique, '{{"name":"' || name || '","detected":' || detected::varchar || ',"status":"' || status || '","alert_count":' || alert_count || '}}'
FROM {_TECHNIQUES_VIEW_SQL}
UNION ALL {_USER_VIEW_SQL}""",
)
def vw_1(logs):
    """Of the report, the sections and fields of the SQL; vw_7 has all."""
    report = R.full_report(logs.stored_alerts).filter(~c("section").isin("attacker_ips", "alerts"))
    return _with_fields(report, "section")


@query("vw_2", _SUMMARY_SQL)
def vw_2(logs):
    return _summary_rows(R.summary_view(logs.stored_alerts))


@query("vw_3", f"SELECT * FROM {_TECHNIQUES_VIEW_SQL}")
def vw_3(logs):
    return R.techniques_view(logs.stored_alerts)


@query("vw_4", _DISPLAY_SQL)
def vw_4(logs):
    return _display_rows(R.alerts_view(logs.stored_alerts))


@query("vw_5", _USER_VIEW_SQL)
def vw_5(logs):
    """Of the user activity, the fields of the SQL; vw_7 has all."""
    return _with_fields(R.user_activity_view(logs.stored_alerts), "part")


@query("vw_6", _LAST_ATTACK_SQL)
def vw_6(logs):
    return _attacker_rows(R.attackers_view(logs.stored_alerts))


# The whole report. The time of the run, which SQL does not have, is a given one, and an alert's is that of its event.
_REPORT_NOW = "2026-01-15 10:30:00.123456"


def _iso_sql(micros: str) -> str:
    return f"strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S.%fZ')"


def _json_sql(**fields: str) -> str:
    """An object of the fields that are not null."""
    pairs = [f"""CASE WHEN ({e}) IS NOT NULL THEN '"{name}":' || to_json({e})::varchar END""" for name, e in fields.items()]
    return f"'{{' || concat_ws(',', {', '.join(pairs)}) || '}}'"


_TIMES = dict(first_seen=_iso_sql("first_seen"), last_seen=_iso_sql("last_seen"))
_ATTACK = dict(attempts="attempts", attack_speed="attack_speed", **_TIMES)
_ALERT = dict(
    technique="technique", severity="severity", timestamp=_iso_sql("first_seen"), **_TIMES, description="description",
    log_source="log_source", dedup_key="dedup_key",
    source_ip="coalesce(nullif(regexp_extract(extra, '(?:^|;)source_ip=([^;]*)', 1), ''), source_ip)", username="username",
    auid="x_auid", rule_name="rule_id", reason="description", auid_human="x_auid::varchar", attempts="x_attempts",
    attack_speed="x_speed", cron_file="x_file", signal="x_signal", privilege_escalated="technique = 'T1548'",
    name_suspicious="coalesce(x_signal = 'name_mismatch', false)", extra="extra",
)
_REPORT_SQL = f"""SELECT 'summary' AS section, '' AS key, '{{"total_techniques":12,"detected":' || detected || ',"missed":' || missed
  || ',"coverage_percent":' || coverage_percent || ',"total_alerts":' || total_alerts
  || ',"severity_counts":{{"CRITICAL":' || critical || ',"HIGH":' || high || ',"MEDIUM":' || medium || ',"LOW":' || low || ',"INFO":' || info
  || '}},"source_counts":{{' || concat_ws(',', {", ".join(f"""CASE WHEN {s} > 0 THEN '"{s}":' || {s} END""" for s in K.LOG_SOURCES)})
  || '}},"generated_at":"{_REPORT_NOW.replace(" ", "T")}Z"}}' AS value
FROM ({_SUMMARY_SQL})
UNION ALL SELECT 'techniques', technique, {_json_sql(name="name", detected="detected", status="status", alert_count="alert_count")}
FROM {_TECHNIQUES_VIEW_SQL}
UNION ALL SELECT 'attacker_ips', ip, {_json_sql(**_ATTACK)} FROM {_ATTACKERS_SQL}
UNION ALL SELECT 'alerts', rule_id, {_json_sql(**_ALERT)} FROM alerts
UNION ALL SELECT 'auid_alert_counts', x_auid::varchar, '{{"alert_count":' || count(*) || '}}' FROM alerts WHERE x_auid IS NOT NULL GROUP BY x_auid
UNION ALL SELECT 'user_technique_map', auid::varchar, {_json_sql(techniques="string_split(techniques, ',')")} FROM {_USER_TECHNIQUES_SQL}
UNION ALL SELECT 'privilege_escalations', x_auid::varchar,
  {_json_sql(auid="x_auid", euid="x_euid", technique="technique", comm="x_comm", timestamp=_iso_sql("first_seen"))}
FROM alerts WHERE technique = 'T1548' AND x_auid IS NOT NULL
UNION ALL SELECT 'ssh_attackers', ip, {_json_sql(**_ATTACK)} FROM ({_LAST_ATTACK_SQL})"""
_ALERT_TYPES = dict(
    auid="BIGINT", attempts="BIGINT", privilege_escalated="BOOLEAN", name_suspicious="BOOLEAN", extra="MAP<STRING,STRING>"
)
_ALERT_FIELDS = ", ".join(f"{name} {_ALERT_TYPES.get(name, 'STRING')}" for name in _ALERT)


def _report_rows(report: DataFrame) -> DataFrame:
    """Rows of the report, of alerts the fields that SQL has and their extra fields as text."""
    a = F.from_json("value", _ALERT_FIELDS)
    shown = F.to_json(F.struct(*[(map_text(a[x]) if x == "extra" else a[x]).alias(x) for x in _ALERT]))
    return report.withColumn("value", F.when(c("section") == "alerts", shown).otherwise(c("value")))


def _report_input(logs: Logs) -> tuple[DataFrame, Column]:
    return logs.stored_alerts.withColumn("timestamp", c("first_seen")), F.lit(_REPORT_NOW).cast("timestamp")


@query("vw_7", _REPORT_SQL)
def vw_7(logs):
    return _report_rows(R.full_report(*_report_input(logs)))


@query("snk_5", _REPORT_SQL)
def snk_5(logs):
    """All five parts of the report, written and read back."""
    folder = shared_folder(logs.spark, "report")
    alerts, now = _report_input(logs)
    R.write_report(alerts, folder, now)
    return _report_rows(R.report_rows(R.read_report(logs.spark, folder, R.report_parts(alerts, now))))


# --- Sigma filters -------------------------------------------------------------------------------
def _sigma(name: str, source: str, where: str) -> None:
    table = {K.AUTH_LOG: "auth", K.AUDITD: "audit", K.CLOUDTRAIL: "cloud"}[source]
    query(name, f"SELECT seq, epoch_us(ts) AS ts FROM {table} WHERE {where}")(
        lambda logs: sigma_filter(logs.events(source), name).select("seq", micros("ts"))
    )


def _ends(endings: list[str]) -> str:
    return "(" + " OR ".join(f"exe ILIKE '%{e}'" for e in endings) + ")"


_sigma("sig_001", K.AUTH_LOG, "raw ILIKE '%Failed password%' OR raw ILIKE '%Invalid user%'")
_sigma("sig_002", K.CLOUDTRAIL, "is_login AND lower(session_mfa) = 'false'")
_sigma("sig_003", K.AUTH_LOG, "raw ILIKE '%new user added%'")
_sigma("sig_004", K.AUDITD, "key = 'shadow_access'")
_sigma("sig_005", K.AUDITD, "euid = 0 AND auid >= 1000 AND auid <> 4294967295")
_sigma("sig_006", K.CLOUDTRAIL, "is_login AND actor_type = 'Root'")
_sigma("sig_007", K.AUTH_LOG, "raw ILIKE '%Accepted password%'")
_sigma("sig_008", K.AUDITD, "key = 'cron_modification' AND syscall IN (257, 2, 82, 86)")
_sigma(
    "sig_009", K.CLOUDTRAIL, f"event_name IN {D._in(K.TRAIL_CRITICAL_EVENTS + K.TRAIL_HIGH_EVENTS)}"
)
_sigma("sig_010", K.AUDITD, "key = 'auditd_tamper'")
_sigma("sig_011", K.AUDITD, "key = 'sudoers_tamper'")
_sigma(
    "sig_012",
    K.AUDITD,
    f"{_ends(K.SIGMA_ENUMERATION_SUFFIXES)} OR coalesce(name IN {D._in(K.SENSITIVE_FILES)}, false)",
)
_sigma("sig_013", K.AUDITD, _ends(K.SIGMA_DISCOVERY_SUFFIXES))


# --- streaming -----------------------------------------------------------------------------------
def _two_landings(
    logs: Logs, rows: DataFrame, run: Callable[[DataFrame], None], columns: list[str]
) -> None:
    """Land the rows in two parts by time, and at last a row from the end of time; run the stream
    after each."""
    from emberwatch.streaming.stateful import closing_row

    landing = shared_folder(logs.spark, "landing")
    middle = F.lit(_MIDDLE).cast("timestamp")
    for part in (rows.filter(c("ts") < middle), rows.filter(c("ts") >= middle), closing_row(rows)):
        part.select(columns).write.mode("append").parquet(landing)
        run(logs.spark.readStream.schema(rows.select(columns).schema).parquet(landing))


_MIDDLE = "2024-01-16 00:00:00"
_LATE = "1 hour"


#: Rules whose rows depend on more than one event; on a stream they are str_3 and str_6.
_OVER_TIME = ("det_001", "det_007", "det_012", "det_013")
_OVER_TIME_IDS = (K.RULE_SSH_BRUTE_FORCE, K.RULE_BRUTE_SUCCESS, K.RULE_ENUMERATION, K.RULE_DISCOVERY)


@query("str_1", f"SELECT rule_id, dedup_key FROM deduped WHERE rule_id NOT IN {D._in(_OVER_TIME_IDS)}")
def str_1(logs):
    """The scheduled run over all four logs: new lines are parsed, tested by every rule over single
    events and sessions, and stored, in two runs. The lines of an audit event land together."""
    from emberwatch.streaming.run import run_batches

    spark, book, stored = logs.spark, rule_book(), []
    texts = {
        K.AUTH_LOG: (S.auth_lines, c("seq")),
        K.AUDITD: (S.audit_lines, F.floor(c("seq") / 4)),
        K.CLOUDTRAIL: (S.cloud_lines, c("seq")),
        K.COWRIE: (S.honeypot_lines, c("seq")),
    }
    for source, (made, number) in texts.items():
        landing, path, state = (shared_folder(spark, name) for name in ("landing", "history", "state"))
        rules = [rule for rule in book.for_source(source) if rule.name not in _OVER_TIME]

        def each(lines: DataFrame, batch: int) -> None:
            numbered = files.number_batch(lines, batch)
            if source == K.CLOUDTRAIL:
                numbered = cloud_fn.records_from_json(numbered)
            events = files.normalize(numbered, source, S.YEAR).events
            alerts = union_all([rule.run(events) for rule in rules])
            alert_store.store_batch(lines.sparkSession, alerts, path, batch)

        for half in (0, 1):
            made(logs.base).filter(number % 2 == half).select("value").write.mode("append").text(landing)
            run_batches(files.stream_lines(spark, landing), each, state)
        stored.append(alert_store.load_batches(spark, path))
    return union_all(stored).select("rule_id", "dedup_key")


@query("str_2", f"SELECT {D.ALERT_COLUMNS} FROM det_009")
def str_2(logs):
    """A rule over single events, applied to a stream as it is."""
    from emberwatch.streaming.run import run_available

    landing = shared_folder(logs.spark, "cloud-events")
    logs.cloud.events.write.parquet(landing)
    stream = logs.spark.readStream.schema(logs.cloud.events.schema).parquet(landing)
    out, state = shared_folder(logs.spark, "alerts"), shared_folder(logs.spark, "state")
    run_available(alert_rows(rule_book().rules["det_009"].run(stream)), out, state)
    return logs.spark.read.parquet(out)


@query("str_3", "SELECT user_id, first_t AS first_seen, t AS last_seen, seq FROM errors")
def str_3(logs):
    """Bursts over two runs: one that spans both is found, as in one batch."""
    from emberwatch.streaming.run import run_available
    from emberwatch.streaming.stateful import stream_bursts

    errors = logs.base.filter("event_type = 'error'").withColumnRenamed("event_id", "seq")
    out, state = shared_folder(logs.spark, "hits"), shared_folder(logs.spark, "state")
    _two_landings(
        logs,
        errors,
        lambda stream: run_available(stream_bursts(stream, "user_id", 5, WEEK, _LATE), out, state),
        ["user_id", "ts", "seq"],
    )
    hits = logs.spark.read.parquet(out)
    return hits.select("user_id", micros("first_seen"), micros("last_seen"), "seq")


_IDLE_SECONDS = 3 * 86_400


@query(
    "str_4",
    """SELECT session_id, src_ip, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time,
  login_attempt_count, command_count, chmod_x_used FROM sessions""",
)
def str_4(logs):
    """Sessions of a stream, closed by idleness."""
    from emberwatch.streaming.run import run_available
    from emberwatch.streaming.stateful import stream_sessions

    out, state = shared_folder(logs.spark, "sessions"), shared_folder(logs.spark, "state")
    events = logs.honeypot.events.drop("extra", "raw", "source")
    _two_landings(
        logs,
        events,
        lambda stream: run_available(stream_sessions(stream, _IDLE_SECONDS, _LATE), out, state),
        events.columns,
    )
    return logs.spark.read.parquet(out).select(
        "session_id", "src_ip", micros("start_time"), micros("end_time"),
        "login_attempt_count", "command_count", "chmod_x_used",
    )


@query("str_5", f"SELECT {D.ALERT_COLUMNS} FROM deduped WHERE log_source = 'cloudtrail'")
def str_5(logs):
    """Alerts of a stream stored exactly once: the first batch is run a second time, as after a
    failure."""
    from emberwatch.streaming.run import run_batches

    path, state = shared_folder(logs.spark, "history"), shared_folder(logs.spark, "state")
    book = rule_book()

    def each(events: DataFrame, batch: int) -> None:
        alerts = book.run_source(K.CLOUDTRAIL, events)
        for _ in range(2 if batch == 0 else 1):
            alert_store.store_batch(events.sparkSession, alerts, path, batch)

    events = logs.cloud.events
    _two_landings(logs, events, lambda stream: run_batches(stream, each, state), events.columns)
    return alert_rows(alert_store.load_batches(logs.spark, path))


@query(
    "str_6",
    f"""SELECT source_ip, username, seq, failures FROM (
  SELECT *, count(*) FILTER (WHERE auth_result = 'failed') OVER upto AS failures,
    max(ts) FILTER (WHERE auth_result = 'failed') OVER upto AS last_failure
  FROM auth WHERE source_ip IS NOT NULL
  WINDOW upto AS (PARTITION BY source_ip ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE auth_result = 'accepted' AND failures >= 5
  AND epoch_us(ts) - epoch_us(last_failure) BETWEEN 0 AND {WEEK} * 1000000::bigint""",
)
def str_6(logs):
    """Success after failures by event time, where the failures may lie in the run before."""
    from emberwatch.streaming.run import run_available
    from emberwatch.streaming.stateful import stream_success_at_login

    out, state = shared_folder(logs.spark, "found"), shared_folder(logs.spark, "state")
    counted = c("source_ip").isNotNull() & c("auth_result").isin("failed", "accepted")
    _two_landings(
        logs,
        logs.auth.events.filter(counted),
        lambda stream: run_available(
            stream_success_at_login(stream, 5, WEEK, forget_seconds=366 * 86_400, lateness=_LATE), out, state
        ),
        ["source_ip", "username", "seq", "ts", "auth_result"],
    )
    return logs.spark.read.parquet(out).select("source_ip", "username", "seq", "failures")


@query("str_7", "SELECT serial, exe, name FROM audit_all")
def str_7(logs):
    """Growing audit logs of four hosts, followed and correlated: the first run ends between the
    lines of an event, the last one with a line from the end of time. A host has several logs, as
    many as let all tasks of a shuffle write; only logs that grow are written again."""
    from emberwatch.sources import growing
    from emberwatch.streaming.run import run_available
    from emberwatch.streaming.stateful import stream_audit_events

    spark = logs.spark
    folder, out, state = (shared_folder(spark, name) for name in ("logs", "events", "state"))
    at = audit_fn.audit_line_time(c("value"))
    lines = S.audit_lines(logs.base)
    middle = lines.filter(at >= F.lit(_MIDDLE).cast("timestamp")).agg(F.min("seq")).first()[0]
    # This source is read in one batch a run, and a batch has the watermark of the one before: the
    # first line from the end of time moves the watermark, the run of the second one sees it.
    ends = [((1 << 62) + i, f'type=PATH msg=audit(725811840{i}.000:0): item=0 name="/"') for i in (0, 1)]
    part = F.when(c("seq") <= middle, 0).when(c("seq") < 1 << 62, 1).otherwise(c("seq") - (1 << 62) + 2)
    ends = spark.createDataFrame(ends, "seq BIGINT, value STRING")
    lines = lines.select("seq", "value").unionByName(ends).withColumn("part", part)
    logs_of_all = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
    host = F.expr("seq div 1000") % logs_of_all
    grown = lambda part: host == (1 << 62) // 1000 % logs_of_all if part > 1 else F.lit(True)
    for part in (0, 1, 2, 3):
        _write_logs(lines.filter((c("part") <= part) & grown(part)), folder, host)
        run_available(stream_audit_events(growing.follow(spark, f"{folder}/*.log"), _LATE), out, state)
    return spark.read.parquet(out).select("serial", "exe", "name")


# --- extension -----------------------------------------------------------------------------------
@query(
    "udf_1",
    """SELECT 'rule_100_many_errors' AS rule_id, source_ip, count(*) AS failures FROM auth
WHERE auth_result = 'failed' GROUP BY source_ip HAVING count(*) >= 15""",
)
def udf_1(logs):
    """A rule written by a user: addresses with many failures, registered and run by the book."""

    def many_failures(auth: DataFrame, threshold: int = 15) -> DataFrame:
        counted = (
            auth.filter("auth_result = 'failed'")
            .groupBy("source_ip")
            .agg(F.count("*").alias("n"), F.min("ts").alias("ts"), F.min("seq").alias("seq"))
            .filter(c("n") >= threshold)
        )
        row = alert(
            rule_id="rule_100_many_errors", rule=100, technique="T1110.001", severity="LOW",
            log_source=K.AUTH_LOG, source_ip=c("source_ip"), dedup_key=c("source_ip"),
            description=X.message("{} failures from {}", c("n"), c("source_ip")),
            extra={"attempt_count": c("n")},
        )
        return counted.select(row.alias("a")).select("a.*")

    events = logs.auth.events
    rule = Rule("many_failures", K.AUTH_LOG, 100, detect=many_failures)
    book = rule_book().register(rule, events)
    found = book.rules["many_failures"].run(events)
    return found.select(
        "rule_id", "source_ip", c("extra")["attempt_count"].cast("bigint").alias("failures")
    )
