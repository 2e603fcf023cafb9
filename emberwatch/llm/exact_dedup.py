"""Exact deduplication over an extendible-hash index kept in shared files. DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import BLANKS, drop, stored

#: A cell is told by so many bits of the hash at most, so that it stays a positive number.
MOST_BITS = 63


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket) for each occupied range of hash prefixes, and the bits that make a cell.

    `keys` has one row per distinct hash `h`. The directory starts with as many bits as an even spread would
    need; buckets over capacity are split by one more bit until none is overfull. Where one is that has no more
    bits, the cells are doubled first, four times at once. Copies of a text share one key and never overfill a
    bucket.
    """
    start = max(0, (keys.count() // capacity).bit_length())
    bits = start + 4

    def counted() -> DataFrame:
        return keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))

    cells = stored(counted().withColumn("depth", F.lit(start)), "cells")
    while True:
        marked = cells.withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)"))
        overfull = (
            marked.groupBy("bucket").agg(F.sum("n").alias("held"), F.max("depth").alias("at"))
            .where((F.col("held") > capacity) & (F.col("at") < MOST_BITS)).select("bucket", "at")
        )
        deepest = overfull.agg(F.max("at")).first()[0]
        if deepest is None:
            return marked.select("cell", "bucket"), bits
        if deepest < bits:
            deeper = F.col("depth") + F.col("at").isNotNull().cast("int")
            split = marked.join(overfull, "bucket", "left").select("cell", "n", deeper.alias("depth"))
        else:
            more = min(4, MOST_BITS - bits)
            bits += more
            known = cells.select(F.col("cell").alias("wide"), "depth")
            split = counted().join(known, F.shiftright("cell", more) == F.col("wide")).select("cell", "n", "depth")
        split = stored(split, "cells")
        drop(cells)
        cells = split


def build_index(entries: DataFrame, capacity: int) -> DataFrame:
    """(bucket, h, n): each distinct hash with its number of rows, in files that the owner of a bucket's key
    range writes in hash order."""
    keys = stored(entries.groupBy("h").agg(F.count("*").alias("n")), "keys")
    cells, bits = directory(keys, capacity)
    owned = keys.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(cells, "cell")
    index = stored(
        owned.select("bucket", "h", "n").repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "index"
    )
    drop(keys)
    return index


def exact_duplicates(docs: DataFrame, capacity: int = 100_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same bytes remain after blanks are deleted. The row with the most code points in
    its original text stays, then the smallest doc_id (null after all others).

    The index is built from narrow rows (hash, sizes). Only texts whose hash has a chain of two or more rows are
    compared: they meet by hash in an equi-join, which adaptive execution may split, and are then grouped by
    hash and bytes, which folds the copies of a chain before they are shuffled again. Different texts that share
    a hash stay apart there.

    Null and empty texts are equal to each other. Repeated rows (same doc_id, same text) count in group_size and
    share one answer. An empty table gives an empty result. Only `doc_id` and `text` are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = normalised(F.col("text"))
    entries = stored(
        docs.select(
            "doc_id", F.length(text).alias("points"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("sha")
        ),
        "entries",
    )
    index = build_index(entries, capacity)
    # One number that orders rows by most code points, then smallest doc_id; a number can be updated in place
    # while rows are grouped by text, where a struct would make Spark sort the texts.
    last = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(19,0)")
    order = last - F.length(text).cast("decimal(10,0)") * F.lit(str(2**64)).cast("decimal(20,0)")
    chained = docs.select(
        "doc_id", F.xxhash64(norm).alias("h"), norm.alias("norm"), order.cast("decimal(38,0)").alias("place")
    ).join(index.where("n > 1").select("h").hint("merge"), "h")
    groups = chained.groupBy("h", "norm").agg(
        F.count("*").alias("group_size"), F.min_by("doc_id", "place").alias("keep_id")
    )
    groups = stored(groups.select("h", F.sha2("norm", 256).alias("sha"), "group_size", "keep_id"), "groups")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return entries.join(groups, ["h", "sha"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, capacity: int = 100_000) -> DataFrame:
    """The documents that stay, whole rows; a row that is repeated in full stays once."""
    kept = exact_duplicates(docs, capacity).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
    return found.dropDuplicates(["doc_id", "text"])
