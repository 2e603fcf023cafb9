"""Kernel audit lines to typed events: key=value extraction, correlation, typing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.auth import Normalized, split_rejects
from emberwatch.functions.text import NOT_SPACE, strip
from emberwatch.functions.times import epoch_time
from emberwatch.schemas import AUDIT_EVENT

# name=value or name="quoted value"
PAIR = rf'\w+=(?:"[^"]*"|{NOT_SPACE}+)'
TYPED_FIELDS = [
    "auid", "uid", "euid", "pid", "ppid", "comm", "exe", "syscall", "success", "key", "name",
    "type", "msg",
]


def pairs_backwards(line: Column) -> Column:
    """`name=value` texts from last to first, so that the first hit of a name is its last one."""
    return F.reverse(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)))


def pair_name(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def pair_value(pair: Column, name: Column) -> Column:
    """The text after `name=`, without its quotes."""
    value = F.substr(pair, F.length(name) + 2)
    quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def with_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds `pairs` and `names`, both from last to first."""
    return lines.withColumn("pairs", pairs_backwards(F.col(column))).withColumn(
        "names", F.transform("pairs", pair_name)
    )


def field_text(name: str) -> Column:
    """The last value of a name, NULL when absent. Needs `pairs` and `names`."""
    place = F.nullif(F.array_position("names", F.lit(name)), F.lit(0).cast("bigint"))
    return pair_value(F.try_element_at("pairs", place.cast("int")), F.lit(name))


def with_pair_map(lines: DataFrame, column: str, without: list[str] = ()) -> DataFrame:
    """Adds the pairs as a map, without some names and those starting upper-case; the last
    duplicate wins. Needs `pairs`.

    Names stand in a column of their own, so that a look-up does not compute them again.
    """

    def is_wanted(name):
        lower = ~F.substr(name, F.lit(1), F.lit(1)).between("A", "Z")
        return lower & ~name.isin(list(without)) if without else lower

    def value_of(name):
        place = F.array_position(F.col("map_names"), name).cast("int")
        return pair_value(F.try_element_at(F.col("map_pairs"), place), name)

    return (
        lines.withColumn("map_pairs", F.filter("pairs", lambda p: is_wanted(pair_name(p))))
        .withColumn("map_names", F.transform("map_pairs", pair_name))
        .withColumn("map_distinct", F.array_distinct("map_names"))
        .withColumn(
            column, F.map_from_arrays("map_distinct", F.transform("map_distinct", value_of))
        )
        .drop("map_pairs", "map_names", "map_distinct")
    )


def correlate_audit(lines: DataFrame, lateness: str | None = None) -> DataFrame:
    """One row per audit event: its first SYSCALL line and the name of its first PATH line.

    On a stream, `lateness` says how long to wait for further lines of an event; the row comes
    out when the watermark has passed its time.

    Lines of other types are dropped before the shuffle. Fields are taken apart before it too, so
    that columns nobody asks for are not shuffled, and a PATH line travels as its name only.
    Node, event number and time together identify an event: numbers restart at boot, and two
    hosts of a fleet may use one number at the same time. Lines without a node are of one host.
    """
    value = F.col("value")
    marked = lines.select(
        "seq",
        "value",
        value.contains("type=SYSCALL").alias("is_call"),
        value.contains("type=PATH").alias("is_path"),
        F.regexp_extract(value, K.AUDIT_ID, 0).alias("id"),
    ).filter("id != '' and (is_call or is_path)")
    is_call, is_path = F.col("is_call"), F.col("is_path")
    used = with_pair_map(with_pairs(marked), "tail", TYPED_FIELDS).select(
        F.regexp_extract(value, K.AUDIT_NODE, 1).alias("node"),
        F.regexp_extract("id", r"\((.*):", 1).alias("epoch"),
        F.regexp_extract("id", r":(\d+)\)", 1).alias("serial"),
        F.when(is_call, value).alias("call"),
        F.when(is_call, F.struct(*[field_text(n).alias(n) for n in TYPED_FIELDS])).alias("fields"),
        F.when(is_call, F.col("tail")).alias("tail"),
        F.when(is_call, F.col("seq")).alias("call_seq"),
        F.when(is_path, F.struct(field_text("name").alias("name"))).alias("path"),
        F.when(is_path, F.col("seq")).alias("path_seq"),
    )
    keys = ["node", "epoch", "serial"]
    if lateness is not None:
        used = used.withColumn("at", epoch_time(F.col("epoch"))).withWatermark("at", lateness)
        keys = ["at", *keys]
    return (
        used.groupBy(*keys)
        .agg(
            F.min("call_seq").alias("seq"),
            F.min_by("call", "call_seq").alias("raw"),
            F.min_by("fields", "call_seq").alias("fields"),
            F.min_by("tail", "call_seq").alias("extra"),
            F.min_by("path", "path_seq").alias("path"),
        )
        .filter("seq is not null")
        .withColumn("path_name", F.col("path.name"))
        .drop("path", "at", "node")
    )


def audit_line_time(value: Column) -> Column:
    """The time in a line's audit id; NULL for lines without one."""
    return epoch_time(F.nullif(F.regexp_extract(value, K.AUDIT_ID, 1), F.lit("")))


def type_audit(correlated: DataFrame) -> DataFrame:
    """Adds the typed columns and `reason`."""

    def field(name):
        return F.col(f"fields.{name}")

    def number(name, default, data_type):
        return F.coalesce(field(name), F.lit(default)).try_cast(data_type)

    epoch = F.regexp_extract(
        F.concat(F.lit("msg="), F.coalesce(field("msg"), F.lit(""))), K.AUDIT_ID, 1
    )
    typed = correlated.select(
        "epoch",
        "serial",
        "path_name",
        "raw",
        "extra",
        "seq",
        F.lit(K.AUDITD).alias("source"),
        epoch_time(F.when(epoch != "", epoch).otherwise(F.lit("0.0"))).alias("ts"),
        number("auid", str(K.UNSET_AUID), "bigint").alias("auid"),
        number("uid", "0", "bigint").alias("uid"),
        number("euid", "0", "bigint").alias("euid"),
        number("pid", "0", "int").alias("pid"),
        number("ppid", "0", "int").alias("ppid"),
        strip(F.coalesce(field("comm"), F.lit(""))).alias("comm"),
        strip(F.coalesce(field("exe"), F.lit(""))).alias("exe"),
        field("syscall").try_cast("int").alias("syscall"),
        (field("syscall").isNotNull() & field("syscall").try_cast("int").isNull()).alias("bad_call"),
        (F.lower(F.coalesce(field("success"), F.lit("yes"))) == "yes").alias("success"),
        strip(field("key")).alias("key"),
        strip(F.coalesce("path_name", field("name"))).alias("name"),
        strip(F.coalesce(field("type"), F.lit("SYSCALL"))).alias("record_type"),
    )
    bad_number = F.col("bad_call")
    for name in ("auid", "uid", "euid", "pid", "ppid"):
        bad_number = bad_number | F.col(name).isNull()
    return typed.withColumn(
        "reason",
        F.when(bad_number, F.lit("bad number")).when(F.col("ts").isNull(), F.lit("bad time")),
    )


def normalize_audit(lines: DataFrame) -> Normalized:
    """`lines` has `value` and `seq`."""
    return split_rejects(type_audit(correlate_audit(lines)), K.AUDITD, AUDIT_EVENT, once=False)
