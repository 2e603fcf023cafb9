"""Cloud API records to typed events.

A record is its JSON text: the used paths are read into a struct in one parse, and the text itself
is kept, so that no field is lost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.auth import Normalized, split_rejects
from emberwatch.functions.times import iso_time
from emberwatch.schemas import CLOUD_EVENT

CLOUD_RECORD = (
    "eventVersion STRING, eventTime STRING, eventSource STRING, eventName STRING,"
    " awsRegion STRING, sourceIPAddress STRING, userAgent STRING, readOnly BOOLEAN,"
    " eventType STRING, errorCode STRING, errorMessage STRING,"
    " userIdentity STRUCT<type: STRING, userName: STRING, arn: STRING, accountId: STRING,"
    " principalId: STRING, sessionIssuer: STRUCT<userName: STRING>,"
    " sessionContext: STRUCT<attributes: STRUCT<mfaAuthenticated: STRING>,"
    " sessionIssuer: STRUCT<userName: STRING>>>,"
    " responseElements STRUCT<ConsoleLogin: STRING>, additionalEventData STRUCT<MFAUsed: STRING>"
)
REQUIRED_TEXT = ["eventVersion", "eventSource", "eventName", "awsRegion"]


def typed_record(record: Column) -> Column:
    return F.from_json(record, CLOUD_RECORD)


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def actor_username(r: Column) -> Column:
    """First non-empty of user name, issuer name, 'root', last part of the principal."""
    identity = r["userIdentity"]
    return F.coalesce(
        filled(identity["userName"]),
        filled(identity["sessionIssuer"]["userName"]),
        filled(identity["sessionContext"]["sessionIssuer"]["userName"]),
        F.when(identity["type"] == "Root", F.lit("root")),
        filled(F.substring_index(identity["principalId"], ":", -1)),
    )


def session_mfa(r: Column) -> Column:
    return r["userIdentity"]["sessionContext"]["attributes"]["mfaAuthenticated"]


def mfa_authenticated(r: Column) -> Column:
    """Session attribute first, else the login's own flag, else unknown."""
    attribute, used = session_mfa(r), r["additionalEventData"]["MFAUsed"]
    return F.when(attribute.isNotNull(), F.lower(attribute) == "true").when(
        used.isNotNull(), used == "Yes"
    )


def is_null(record: Column, value: Column, name: str) -> Column:
    """Present and JSON null. The keys are looked at only where the value is missing."""
    return F.when(
        value.isNull(),
        F.coalesce(F.array_contains(F.json_object_keys(record), name), F.lit(False)),
    ).otherwise(F.lit(False))


def parse_cloud(records: DataFrame) -> DataFrame:
    """`records` has `record` (JSON text) and `seq`; adds all columns and `reason`."""
    record, r = F.col("record"), F.col("r")
    identity = r["userIdentity"]
    bad_shape = is_null(record, identity, "userIdentity")
    for name in REQUIRED_TEXT:
        bad_shape = bad_shape | is_null(record, r[name], name)
    text = lambda name: F.coalesce(r[name], F.lit(""))
    return (
        records.withColumn("r", typed_record(record))
        .withColumn("ts", iso_time(r["eventTime"]))
        .select(
            "seq",
            "ts",
            F.lit(K.CLOUDTRAIL).alias("source"),
            record.alias("raw"),
            F.create_map().cast("map<string,string>").alias("extra"),
            text("eventVersion").alias("event_version"),
            text("eventSource").alias("event_source"),
            text("eventName").alias("event_name"),
            text("awsRegion").alias("aws_region"),
            r["sourceIPAddress"].alias("source_ip"),
            r["userAgent"].alias("user_agent"),
            r["readOnly"].alias("read_only"),
            r["eventType"].alias("event_type"),
            actor_username(r).alias("actor_username"),
            F.coalesce(identity["type"], F.lit("")).alias("actor_type"),
            identity["arn"].alias("actor_arn"),
            identity["accountId"].alias("actor_account_id"),
            session_mfa(r).alias("session_mfa"),
            mfa_authenticated(r).alias("mfa_authenticated"),
            r["responseElements"]["ConsoleLogin"].alias("console_login"),
            r["errorCode"].alias("error_code"),
            r["errorMessage"].alias("error_message"),
            F.when(F.col("ts").isNull(), F.lit("bad time"))
            .when(bad_shape, F.lit("bad shape"))
            .alias("reason"),
        )
    )


def normalize_cloud(records: DataFrame) -> Normalized:
    return split_rejects(parse_cloud(records), K.CLOUDTRAIL, CLOUD_EVENT)


def records_from_json(lines: DataFrame) -> DataFrame:
    """One JSON record per line (`value`, `seq`) to `record`."""
    return lines.select("seq", F.col("value").alias("record"))
