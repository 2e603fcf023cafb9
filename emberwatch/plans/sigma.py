"""The thirteen single-event Sigma filters. Text tests ignore case."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.text import one_of
from emberwatch.plans.alerts import any_of


def contains_any(column: str, texts: list[str]) -> Column:
    low = F.lower(F.col(column))
    return any_of([low.contains(t.lower()) for t in texts])


def ends_with_any(column: str, endings: list[str]) -> Column:
    low = F.lower(F.col(column))
    return any_of([low.endswith(t.lower()) for t in endings])


def same_text(column: str, values: list[str]) -> Column:
    return one_of(F.lower(F.col(column)), [v.lower() for v in values])


def conditions() -> dict[str, tuple[str, Column]]:
    """Filter name to (source, condition)."""
    login = same_text("event_name", ["ConsoleLogin"])
    return {
        "sig_001": (K.AUTH_LOG, contains_any("raw", K.SIGMA_FAILED_TEXTS)),
        "sig_002": (K.CLOUDTRAIL, login & same_text("session_mfa", ["false"])),
        "sig_003": (K.AUTH_LOG, contains_any("raw", [K.SIGMA_NEW_USER_TEXT])),
        "sig_004": (K.AUDITD, same_text("key", [K.SHADOW_KEY])),
        "sig_005": (
            K.AUDITD,
            (F.col("euid") == 0) & (F.col("auid") >= 1000) & (F.col("auid") != K.UNSET_AUID),
        ),
        "sig_006": (K.CLOUDTRAIL, login & same_text("actor_type", ["Root"])),
        "sig_007": (K.AUTH_LOG, contains_any("raw", [K.SIGMA_ACCEPTED_TEXT])),
        "sig_008": (
            K.AUDITD,
            same_text("key", [K.CRON_KEY]) & F.col("syscall").isin(K.CRON_SYSCALLS),
        ),
        "sig_009": (
            K.CLOUDTRAIL,
            same_text("event_name", K.TRAIL_CRITICAL_EVENTS + K.TRAIL_HIGH_EVENTS),
        ),
        "sig_010": (K.AUDITD, same_text("key", [K.SIGMA_TAMPER_KEY])),
        "sig_011": (K.AUDITD, same_text("key", [K.SUDOERS_KEY])),
        "sig_012": (
            K.AUDITD,
            ends_with_any("exe", K.SIGMA_ENUMERATION_SUFFIXES)
            | same_text("name", K.SENSITIVE_FILES),
        ),
        "sig_013": (K.AUDITD, ends_with_any("exe", K.SIGMA_DISCOVERY_SUFFIXES)),
    }


def sigma_filter(events: DataFrame, name: str) -> DataFrame:
    return events.filter(conditions()[name][1])
