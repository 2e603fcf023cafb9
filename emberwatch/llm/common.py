"""Helpers the operators share: scratch tables, connected components, pieces of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import remove_folder, shared_folder

#: The characters of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task has as Python objects at a time; a longer text comes alone.
PORTION = 1 << 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for table in tables:
        remove_folder(table.sparkSession, table.stored_path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; the component is the smallest node reachable.

    Large-star and small-star steps in turn until every node is a root or hangs on one. Each step keeps at most one
    row per edge and is a grouped minimum (combined before the shuffle) and an equi-join. Minima are stored
    before the join so that both its sides are plain shuffles, which adaptive execution may split: a node with
    a third of all edges does not stay in one task. The same table tells how many smaller and larger neighbours a
    node has, so the end is seen without another round. Rounds grow with the logarithm of the longest chain.
    """
    found = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        up = found.select("u", "v", F.lit(1).alias("up"))
        both = up.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        least = both.groupBy("u").agg(
            F.least("u", F.min("v")).alias("m"), F.sum("up").alias("smaller"), F.count_if(F.col("up") == 0).alias("larger")
        )
        least = stored(least, "least")
        if least.where("smaller > 1 or smaller = 1 and larger > 0").isEmpty():
            drop(least)
            break
        large = both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(
            small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        drop(found, least, large)
        found = after
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined_components(groups_of: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) when edges come to components that are found: only the components that an edge joins are
    gone through, each as one node."""
    of_u = groups_of.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    of_v = groups_of.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    between = edges.join(of_u, "u", "left").join(of_v, "v", "left")
    between = between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    merged = components(between)
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = groups_of.join(into, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return stored(old.unionByName(merged.join(groups_of, "node", "left_anti")), "components")


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, as slices with at most `limit` bytes in `column`, one row at least: what is made
    of a slice can go before the next one is taken, in the task as well as where its rows are read."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def chunks(texts: list, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of (place, piece) of at most about `limit` characters; a longer text is cut at fixed places."""
    held, size = [], 0
    for place, text in enumerate(texts):
        for at in range(0, len(text), limit):
            piece = text[at : at + limit]
            if size + len(piece) > limit and held:
                yield held
                held, size = [], 0
            held.append((place, piece))
            size += len(piece)
    if held:
        yield held
