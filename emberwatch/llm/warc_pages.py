"""Web pages to WARC archives and back: equal payloads are written once, others revisit them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import stored
from emberwatch.llm.warc import Warc

URN = "urn:page:"


def register(spark: SparkSession) -> None:
    """Make the format `warc` known to the session and let Spark hand predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def _urn(number: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), number, F.lit(">"))


def _number(urn: str) -> Column:
    """The page number in a record id; null where it has none."""
    return F.expr(f"try_cast(substring({urn}, {len(URN) + 2}, length({urn}) - {len(URN) + 2}) AS long)")


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record per row of `pages` (page_id, url, html).

    Of rows with equal payloads of at least `min_bytes`, the one with the smallest page_id is the response and the
    others revisit it. A null html is an empty payload. A null page_id is a response of its own, without a number;
    rows that repeat the smallest page_id are all responses. Equal means equal length, SHA-1 and a second hash.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.select(
        "*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"),
        F.xxhash64("payload").alias("h"),
    )
    narrow = stored(rows.select("page_id", "sha1", "size", "h").where(F.col("size") >= min_bytes), "payloads")
    first = narrow.groupBy("sha1", "size", "h").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = first.where("n > 1").select(
        F.col("sha1").alias("s"), F.col("size").alias("l"), F.col("h").alias("x"), "first"
    )
    # Only repeated payloads take part in the join, by page: the pages themselves are shuffled once.
    later = narrow.join(
        repeated, (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("l")) & (F.col("h") == F.col("x"))
    ).where("page_id > first").select(F.col("page_id").alias("later"), F.col("s"), "first").distinct()
    found = rows.join(later, (F.col("page_id") == F.col("later")) & (F.col("sha1") == F.col("s")), "left")
    revisit = F.col("first").isNotNull()
    found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _urn(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null-"), F.col("h")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("sha1").alias("payload_sha1"),
        F.when(revisit, _urn(F.col("first"))).alias("refers_to"),
        F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of an archive.

    Payloads of responses are unpacked and held against their digest; of revisits only the headers are read, which
    tell length and digest of the full payload.
    """
    register(spark)
    source = spark.read.format("warc").option("path", folder)
    columns = ("record_type", "payload_digest", "record_id", "refers_to")
    first = source.load().where("record_type = 'response'")
    first = first.select(*columns, F.octet_length("content").cast("long").alias("payload_bytes"))
    later = source.option("payload", "false").load().where("record_type = 'revisit'")
    later = later.select(*columns, F.col("payload_length").alias("payload_bytes"))
    return first.unionByName(later).select(
        _number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _number("refers_to").alias("refers_to"),
    )
