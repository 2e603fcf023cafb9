"""Named conditions over normalised events. Each takes and returns columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.text import basename, one_of


def is_escalation(euid: Column, auid: Column) -> Column:
    """A process running as root for somebody who did not log in as root."""
    return (euid == 0) & (auid != 0) & (auid != K.UNSET_AUID)


def exe_matches_comm(exe: Column, comm: Column) -> Column:
    return basename(exe) == comm


def mfa_used(mfa: Column) -> Column:
    """Unknown counts as used."""
    return F.coalesce(mfa, F.lit(True))


def is_console_login(event_name: Column) -> Column:
    return F.coalesce(event_name == "ConsoleLogin", F.lit(False))


def login_succeeded(console_login: Column) -> Column:
    return F.coalesce(console_login == "Success", F.lit(False))


def is_suspicious_login(event_name: Column, console_login: Column, mfa: Column) -> Column:
    return is_console_login(event_name) & login_succeeded(console_login) & ~mfa_used(mfa)


def is_call_without_mfa(actor_type: Column, mfa: Column, error_code: Column) -> Column:
    no_error = F.coalesce(error_code, F.lit("")) == ""
    return F.coalesce((actor_type == "IAMUser") & ~mfa & no_error, F.lit(False))


def in_trusted_directory(exe: Column) -> Column:
    hits = [exe.startswith(d) for d in K.TRUSTED_DIRECTORIES]
    condition = hits[0]
    for hit in hits[1:]:
        condition = condition | hit
    return F.coalesce(condition, F.lit(False))


def is_cut_by_kernel(comm: Column, exe_name: Column) -> Column:
    return (F.length(comm) == K.KERNEL_NAME_LENGTH) & exe_name.startswith(comm)


def is_interpreter(exe: Column) -> Column:
    return basename(exe).rlike(K.INTERPRETER)


def is_known_symlink(comm: Column, exe: Column) -> Column:
    condition = F.lit(False)
    for known_comm, known_exe in K.KNOWN_SYMLINKS:
        condition = condition | ((comm == known_comm) & (exe == known_exe))
    return condition


def name_differs(comm: Column, exe: Column) -> Column:
    """The process name does not follow from its program file."""
    name = basename(exe)
    return (
        (name != comm)
        & ~is_cut_by_kernel(comm, name)
        & ~is_known_symlink(comm, exe)
        & ~is_interpreter(exe)
    )


def runs_outside(comm: Column, exe: Column) -> Column:
    """A sensitive service name running from a directory nobody installs into."""
    return (
        one_of(comm, K.SENSITIVE_PROCESSES) & ~in_trusted_directory(exe) & ~is_interpreter(exe)
    )


def attack_rate(count: Column, micros: Column) -> Column:
    return count / F.greatest(micros / F.lit(1_000_000.0), F.lit(1.0))


def attack_speed(rate: Column) -> Column:
    return (
        F.when(rate > 10, F.lit(K.AGGRESSIVE))
        .when(rate > 3, F.lit(K.MODERATE))
        .otherwise(F.lit(K.SLOW_SCAN))
    )


def attack_severity(rate: Column) -> Column:
    return F.when(rate > 10, F.lit("CRITICAL")).when(rate > 3, F.lit("HIGH")).otherwise("MEDIUM")


def severity_of_count(n: Column) -> Column:
    return (
        F.when(n >= 50, F.lit("CRITICAL"))
        .when(n >= 20, F.lit("HIGH"))
        .when(n >= 10, F.lit("MEDIUM"))
        .when(n >= 3, F.lit("LOW"))
        .otherwise(F.lit("INFO"))
    )


def clean_severity(text: Column) -> Column:
    """Upper-cased member of the severity list, else NULL."""
    return F.when(F.upper(text).isin(K.SEVERITIES), F.upper(text))


def clean_technique(text: Column) -> Column:
    return F.when(text.isin([t for t, _ in K.TECHNIQUES]), text)


def download_tools(text: Column) -> Column:
    """Sorted distinct download tools named in a text."""
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(text, F.lit(K.DOWNLOAD_TOOL), F.lit(1)))
    )


def makes_executable(text: Column) -> Column:
    return F.coalesce(text.rlike(K.CHMOD_X), F.lit(False))


def threat_score(attempts: Column, techniques: Column, speed: Column) -> Column:
    bonus = (
        F.when(speed == K.AGGRESSIVE, 20).when(speed == K.MODERATE, 10).otherwise(0)
    )
    return F.least(F.least(attempts * 2, F.lit(60)) + techniques * 10 + bonus, F.lit(100))
