"""Line deduplication against levelled, sorted runs of line hashes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import BLANKS, UPPER, drop, stored


class LineRuns:
    """Line keys seen so far, as runs sorted by hash. A new run enters level 0; when a level holds `fanout`
    runs they are merged into one run of the next level, so that there are few runs however many batches came."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """The keys with a column `old`: whether a run holds the key. A key is in one run at most."""
        runs = self.runs()
        if not runs:
            return keys.withColumn("old", F.lit(False))
        held = runs[0]
        for run in runs[1:]:
            held = held.unionByName(run)
        fresh = keys.join(held, ["h1", "h2"], "left_anti").withColumn("old", F.lit(False))
        return fresh.unionByName(keys.join(held, ["h1", "h2"], "left_semi").withColumn("old", F.lit(True)))

    def add(self, keys: DataFrame) -> None:
        """Add keys that no run holds yet, as a run; compact full levels."""
        run, level = _sorted_run(keys.select("h1", "h2")), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:
                merged = merged.unionByName(other)
            run = _sorted_run(merged)
            drop(*full)
            level += 1


def _sorted_run(keys: DataFrame) -> DataFrame:
    return stored(keys.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), "run")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def dedup_batch(docs: DataFrame, runs: LineRuns, min_points: int) -> DataFrame:
    """One batch of documents (doc_id, text) against the runs; adds the batch's own keys to them.

    Returns doc_id, n_lines, n_dropped, kept (text of the lines that stay). A key's lines go where an earlier
    batch holds the key, and else in every document but the smallest doc_id of this batch that has it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rank = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank")
    lines = rows.select("doc_id", rank, "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "rank", "th", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_points).select(
        "doc_id", "rank", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    keyed = stored(keyed, "lines")
    owners = keyed.groupBy("h1", "h2").agg(F.min("rank").alias("owner"), F.max("rank").alias("last"))
    owners = stored(runs.seen(owners), "owners")
    runs.add(owners.where("not old"))
    # Only keys that cost a line take part in the join with the lines.
    costly = owners.where("old or owner <> last").select("h1", "h2", "old", "owner")
    gone = keyed.join(costly, ["h1", "h2"]).where("old or rank <> owner")
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("gone"))
    gone = gone.hint("merge")  # the same join at every size
    found = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    found = found.select("doc_id", F.split("text", "\n", -1).alias("lines"), "text", "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    )
    return found.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_points: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept.

    A line's key is the line without blanks at both ends, A-Z lowered. Keys of at least `min_points` code points
    found in two documents lose their lines in all but the smallest doc_id that has them; a null doc_id is the
    largest. Lines repeated inside the document that owns them stay. A null or empty text is one empty line.
    Rows that repeat a doc_id are one document. Keys are told apart by 128 bits of hash.

    The documents go in `batches` ranges of ascending doc_id; the same steps serve batches that arrive over time.
    """
    runs = LineRuns(fanout)
    share = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", share, 10_000)).first()[0] if share else []
    cuts = sorted(set(cuts or []))
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
        below = F.lit(True) if high is None else F.col("doc_id") <= high
        parts.append(dedup_batch(docs.where(inside & below), runs, min_points))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
