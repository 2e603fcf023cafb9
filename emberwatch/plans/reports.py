"""Rollups and views over the alert table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.predicates import threat_score

c = F.col
N_TECHNIQUES = len(K.TECHNIQUES)
# How a report's JSON shows times: to the microsecond, as they are stored.
REPORT_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def technique_names(spark: SparkSession) -> DataFrame:
    """The fixed list of techniques."""
    return spark.createDataFrame(K.TECHNIQUES, "technique STRING, name STRING")


def technique_coverage(alerts: DataFrame) -> DataFrame:
    """Every technique with its alert count and the source of its last alert."""
    counted = alerts.groupBy("technique").agg(
        F.count("*").alias("alert_count"), F.max_by("log_source", "ord").alias("log_source")
    )
    names = technique_names(alerts.sparkSession)
    return names.join(counted, "technique", "left").select(
        "technique",
        "name",
        c("alert_count").isNotNull().alias("detected"),
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        "log_source",
    )


def coverage_summary(alerts: DataFrame) -> DataFrame:
    """One row of totals. Counted per technique and severity first, so that the distinct count
    runs over a handful of rows."""
    small = alerts.groupBy("technique", "severity").agg(F.count("*").alias("n"))
    detected = F.count_distinct("technique")
    of = lambda s: F.coalesce(F.sum(F.when(c("severity") == s, c("n"))), F.lit(0))
    return small.agg(
        F.lit(N_TECHNIQUES).cast("bigint").alias("total_techniques"),
        detected.alias("detected_count"),
        F.round(detected / N_TECHNIQUES * 100, 1).alias("coverage_pct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
        of("CRITICAL").alias("critical_count"),
        of("HIGH").alias("high_count"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """One row with a column per severity, zero where there is none."""
    return alerts.agg(
        *[F.count_if(c("severity") == s).alias(s) for s in reversed(K.SEVERITIES)]
    )


def source_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("log_source").agg(F.count("*").alias("alert_count"))


def report_totals(alerts: DataFrame) -> DataFrame:
    return coverage_summary(alerts).select(
        "total_techniques",
        c("detected_count").alias("detected"),
        (c("total_techniques") - c("detected_count")).alias("missed"),
        c("coverage_pct").alias("coverage_percent"),
        "total_alerts",
    )


def attacker_list(alerts: DataFrame) -> DataFrame:
    """One row per password-guessing alert with an address."""
    return alerts.filter(
        (c("technique") == "T1110.001") & (c("source_ip") != "")
    ).select(
        c("source_ip").alias("ip"),
        c("extra")["attempt_count"].cast("bigint").alias("attempts"),
        c("extra")["attack_speed"].alias("attack_speed"),
        "first_seen",
        "last_seen",
        "ord",
    )


def attacker_table(alerts: DataFrame) -> DataFrame:
    """Per address the facts of its last password-guessing alert."""
    facts = F.struct("attempts", "attack_speed", "first_seen", "last_seen")
    return (
        attacker_list(alerts).groupBy("ip").agg(F.max_by(facts, "ord").alias("a")).select("ip", "a.*")
    )


def with_auid(alerts: DataFrame) -> DataFrame:
    """Alerts that name an audit id, with `auid` taken from their extra fields."""
    return alerts.withColumn("auid", c("extra")["auid"].cast("bigint")).filter("auid is not null")


def alerts_per_auid(alerts: DataFrame) -> DataFrame:
    return with_auid(alerts).groupBy("auid").agg(F.count("*").alias("alert_count"))


def techniques_per_auid(alerts: DataFrame) -> DataFrame:
    """Distinct techniques per audit id by first appearance; at most twelve each."""
    first = with_auid(alerts).groupBy("auid", "technique").agg(F.min("ord").alias("first_ord"))
    ordered = F.array_sort(F.collect_list(F.struct("first_ord", "technique")))
    return first.groupBy("auid").agg(
        F.transform(ordered, lambda s: s["technique"]).alias("techniques")
    )


def escalations(alerts: DataFrame) -> DataFrame:
    return with_auid(alerts).filter(c("technique") == "T1548").select(
        c("auid").cast("string").alias("auid_human"),
        "auid",
        c("extra")["euid"].cast("bigint").alias("euid"),
        "technique",
        c("extra")["comm"].alias("comm"),
        "timestamp",
        "ord",
    )


def attacker_profiles(alerts: DataFrame, now: Column) -> DataFrame:
    """Per address: attempts, techniques, speed of the last alert, activity and score.

    Techniques are a set of at most twelve values.
    """
    addressed = alerts.filter(c("source_ip") != "")
    speed = c("extra")["attack_speed"]
    grouped = addressed.groupBy(c("source_ip").alias("ip")).agg(
        F.coalesce(F.sum(c("extra")["attempt_count"].cast("bigint")), F.lit(0)).alias(
            "total_attempts"
        ),
        F.array_sort(F.collect_set("technique")).alias("techniques_used"),
        F.max_by(F.when(speed.isNotNull(), speed), F.when(speed.isNotNull(), c("ord"))).alias(
            "attack_speed"
        ),
        F.min("first_seen").alias("first_seen"),
        F.max(F.coalesce("last_seen", "first_seen")).alias("last_seen"),
    )
    age = F.unix_micros(now) - F.unix_micros("last_seen")
    return grouped.withColumn(
        "is_active", (age >= 0) & (age <= F.lit(86_400_000_000))
    ).withColumn(
        "threat_score",
        threat_score(c("total_attempts"), F.size("techniques_used"), c("attack_speed")),
    )


def user_profiles(alerts: DataFrame) -> DataFrame:
    """Per audit id: alerts, techniques, counts by severity, any escalation."""
    counts = (
        with_auid(alerts)
        .withColumn(
            "escalated",
            (c("extra")["euid"] == "0") & ~c("auid").isin(0, K.UNSET_AUID),
        )
        .groupBy("auid", "technique", "severity")
        .agg(F.count("*").alias("n"), F.coalesce(F.bool_or("escalated"), F.lit(False)).alias("e"))
    )
    per_severity = F.map_from_arrays(
        F.array(*[F.lit(s) for s in K.SEVERITIES]),
        F.array(
            *[
                F.coalesce(F.sum(F.when(c("severity") == s, c("n"))), F.lit(0))
                for s in K.SEVERITIES
            ]
        ),
    )
    return counts.groupBy("auid").agg(
        F.sum("n").alias("alert_count"),
        F.array_sort(F.collect_set("technique")).alias("techniques_triggered"),
        F.map_filter(per_severity, lambda _, n: n > 0).alias("severity_counts"),
        F.bool_or("e").alias("is_privileged_escalation"),
    )


# --- views ---------------------------------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "CRITICAL", 0)
        .when(severity == "HIGH", 1)
        .when(severity == "MEDIUM", 2)
        .otherwise(9)
    )


def display_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with their extra fields as columns and the names a front end shows."""
    extra = c("extra")
    text = lambda k: extra[k].alias(k)
    return alerts.select(
        "alert_id", "rule_id", "technique", "severity", "timestamp", "first_seen", "last_seen",
        "description", "raw_log", "log_source", "dedup_key", "ord",
        F.coalesce(extra["source_ip"], c("source_ip")).alias("source_ip"),
        "username",
        extra["auid"].cast("bigint").alias("auid"),
        *[
            text(k)
            for k in (
                "exe", "comm", "euid", "uid", "pid", "syscall", "file", "key", "signal",
                "attempt_count", "attack_speed", "window_seconds", "event_name", "aws_region",
                "user_agent", "actor_type", "new_username", "hostname", "session_id",
                "command_count", "password", "download_tools", "chmod_x_used", "commands",
                "files", "count", "sudo_user", "sudo_command", "mfa_authenticated",
                "seconds_after_last_failure", "last_failure_time", "success_time",
                "login_attempt_count",
            )
        ],
        # All fields, those of rules registered later included.
        extra,
        c("rule_id").alias("rule_name"),
        c("description").alias("reason"),
        extra["auid"].alias("auid_human"),
        extra["attempt_count"].cast("bigint").alias("attempts"),
        extra["file"].alias("cron_file"),
        extra["auid_human"].alias("created_by"),
        (c("technique") == "T1548").alias("privilege_escalated"),
        F.coalesce(extra["signal"] == "name_mismatch", F.lit(False)).alias("name_suspicious"),
    )


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """Worst first; within a severity in alert order."""
    return alerts.orderBy(severity_rank(c("severity")), "ord")


def alerts_view(alerts: DataFrame) -> DataFrame:
    """Sorted first: a displayed row has most of an alert's texts twice or more, and only the alert is moved."""
    return display_alerts(alerts_by_severity(alerts))


def techniques_view(alerts: DataFrame) -> DataFrame:
    return technique_coverage(alerts).select(
        "technique",
        "name",
        "detected",
        F.when(c("detected"), F.lit("detected")).otherwise(F.lit("missed")).alias("status"),
        "alert_count",
    )


def attackers_view(alerts: DataFrame) -> DataFrame:
    return attacker_table(alerts)


def summary_view(alerts: DataFrame) -> DataFrame:
    """One row: totals, counts by severity and by source. All of it comes from the counts per
    technique, severity and source, which are few."""
    small = alerts.groupBy("technique", "severity", "log_source").agg(F.count("*").alias("n"))
    total = lambda when: F.coalesce(F.sum(F.when(when, c("n"))), F.lit(0))
    detected = F.count_distinct("technique")
    # Any source counts, also one that only a registered rule knows; the four logs come first.
    pairs = F.filter(F.col("by_source"), lambda p: p["log_source"].isNotNull())
    found = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["log_source"])))
    names = F.array_union(F.array(*[F.lit(s) for s in K.LOG_SOURCES]), found)
    count = F.transform(
        names,
        lambda name: F.aggregate(
            F.filter(pairs, lambda p: p["log_source"] == name),
            F.lit(0).cast("bigint"),
            lambda n, p: n + p["n"],
        ),
    )
    sources = F.map_filter(F.map_from_arrays(names, count), lambda _, n: n > 0)
    summary = small.agg(
        F.lit(N_TECHNIQUES).cast("bigint").alias("total_techniques"),
        detected.alias("detected"),
        (F.lit(N_TECHNIQUES) - detected).alias("missed"),
        F.round(detected / N_TECHNIQUES * 100, 1).alias("coverage_percent"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
        F.struct(
            *[total(c("severity") == s).alias(s) for s in reversed(K.SEVERITIES)]
        ).alias("severity_counts"),
        F.collect_list(F.struct("log_source", "n")).alias("by_source"),
    )
    return summary.withColumn("source_counts", sources).drop("by_source")


def user_activity_view(alerts: DataFrame) -> DataFrame:
    """The four parts of the user activity as tagged rows (part, key, values as JSON).

    Parts grow with users and addresses, so they stay rows and are never one document.
    """
    counts = alerts_per_auid(alerts).select(
        F.lit("auid_alert_counts").alias("part"),
        c("auid").cast("string").alias("key"),
        F.to_json(F.struct("alert_count")).alias("value"),
    )
    techniques = techniques_per_auid(alerts).select(
        F.lit("user_technique_map"), c("auid").cast("string"), F.to_json(F.struct("techniques"))
    )
    raised = escalations(alerts).select(
        F.lit("privilege_escalations"), c("auid_human"),
        F.to_json(F.struct("auid", "euid", "technique", "comm", "timestamp"), REPORT_JSON),
    )
    attackers = attacker_table(alerts).select(
        F.lit("ssh_attackers"), c("ip"),
        F.to_json(F.struct("attempts", "attack_speed", "first_seen", "last_seen"), REPORT_JSON),
    )
    return counts.union(techniques).union(raised).union(attackers)


def report_parts(alerts: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The whole report: a one-row summary, the techniques, and the parts that grow. `now` is the
    time the summary gives for it."""
    now = F.current_timestamp() if now is None else now
    return {
        "summary": summary_view(alerts).withColumn("generated_at", now),
        "techniques": techniques_view(alerts),
        "attacker_ips": attacker_list(alerts).drop("ord"),
        "alerts": alerts_view(alerts).drop("ord"),
        "user_activity": user_activity_view(alerts),
    }


def write_report(alerts: DataFrame, folder: str, now: Column | None = None) -> None:
    """The report as JSON, one folder per part."""
    for name, frame in report_parts(alerts, now).items():
        frame.write.mode("overwrite").options(**REPORT_JSON).json(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What `write_report` stored, with the columns of `parts`."""
    return {
        name: spark.read.schema(frame.schema).options(**REPORT_JSON).json(f"{folder}/{name}")
        for name, frame in parts.items()
    }


def report_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of a report as rows (section, key, value as JSON). The user activity has such rows
    already and keeps the names of its four parts."""
    keys = {"summary": None, "techniques": "technique", "attacker_ips": "ip", "alerts": "rule_id"}
    rows = [
        parts[name].select(
            F.lit(name).alias("section"),
            (c(key) if key else F.lit("")).alias("key"),
            F.to_json(F.struct(*[x for x in parts[name].columns if x != key]), REPORT_JSON).alias("value"),
        )
        for name, key in keys.items()
    ]
    return reduce(DataFrame.union, [*rows, parts["user_activity"].select("part", "key", "value")])


def full_report(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    """The whole report as rows (section, key, value as JSON)."""
    return report_rows(report_parts(alerts, now))
