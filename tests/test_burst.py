"""The burst operator against the sequential definition, on random and awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import burst
from emberwatch.operators.burst import burst_windows


def sequential(rows, n, window):
    hits, held = [], {}
    for key, t, seq in sorted(rows):
        kept = [e for e in held.get(key, []) if t - e[0] <= window * 1_000_000] + [(t, seq)]
        if len(kept) >= n:
            hits.append((key, kept[0][0], t, seq, [s for _, s in kept]))
            kept = []
        held[key] = kept
    return sorted(hits)


def random_rows(rng, keys, n, window):
    rows, seq = [], 0
    for key in range(keys):
        t = rng.randrange(-(10**9), 10**9)
        gap = rng.choice([window / n, window / max(n - 1, 1), window / (2 * n), 2 * window / n])
        for _ in range(rng.randrange(0, 90)):
            kind = rng.random()
            if kind < 0.15:
                t += int(window * 1e6 * rng.random() * 4)
            elif kind < 0.6:
                t += round(gap) * 1_000_000
            elif kind > 0.7:
                t += int(gap * 2e6 * rng.random())
            rows.append((key, t, seq))
            seq += 1
    return rows


def found(spark, rows, n, window, chunk):
    events = spark.createDataFrame(rows, "k INT, t BIGINT, seq BIGINT")
    events = events.withColumn("ts", F.timestamp_micros("t")).drop("t")
    hits = burst_windows(events, ["k"], n, window, members=["seq"], chunk_rows=chunk)
    got = hits.select("k", F.unix_micros("first_seen"), F.unix_micros("last_seen"), "seq", "seq_members")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(
    "n, window, chunk", [(5, 60, 1), (5, 60, 3), (3, 10, 4), (2, 5, 7), (1, 5, 5), (4, 20, 4096)]
)
def test_random(spark, n, window, chunk):
    rows = random_rows(random.Random(n * 1000 + window), 60, n, window)
    assert found(spark, rows, n, window, chunk) == sequential(rows, n, window)


def test_unbroken_burst_over_many_chunks(spark, monkeypatch):
    """Every row is a candidate, so each chunk depends on all before it, up three levels of the tree."""
    monkeypatch.setattr(burst, "FAN", 8)
    rows = [(1, i * 7_000_000, i) for i in range(1003)]
    assert found(spark, rows, 5, 60, 2) == sequential(rows, 5, 60)


def test_equal_times(spark):
    """A moment with many rows is cut like any other."""
    rows = [(1, 0, i) for i in range(23)] + [(1, 60_000_000, i) for i in range(23, 26)]
    assert found(spark, rows, 5, 60, 4) == sequential(rows, 5, 60)


def test_rows_without_time_or_key_belong_to_no_key(spark):
    events = spark.sql("SELECT cast(null AS int) AS k, timestamp_seconds(id) AS ts, id AS seq FROM range(9)")
    events = events.unionByName(spark.sql("SELECT 1 AS k, cast(null AS timestamp) AS ts, id AS seq FROM range(9)"))
    assert burst_windows(events, ["k"], 2, 60).count() == 0


def test_scan_against_a_loop(spark, monkeypatch):
    """Random maps of random numbers of chunks, composed in a tree and one after the other."""
    monkeypatch.setattr(burst, "FAN", 3)
    rng = random.Random(4)
    maps = {k: [[rng.randrange(4) for _ in range(4)] for _ in range(rng.choice([1, 2, 9, 40]))] for k in range(9)}
    rows = [(k, i, m) for k, own in maps.items() for i, m in enumerate(own)]
    got = burst.entries(spark.createDataFrame(rows, "k INT, nth BIGINT, exits ARRAY<INT>"), ["k"]).collect()
    want = []
    for k, own in maps.items():
        entry = 0
        for i, m in enumerate(own):
            want.append((k, i, entry))
            entry = m[entry]
    assert sorted(map(tuple, got)) == want


def test_one_key_with_all_rows_over_100_000_chunks(spark):
    """An unbroken burst of one key: hits are every fifth row, and no row holds more than a chunk or
    FAN maps."""
    n = 300_000
    events = spark.sql(f"SELECT 1 AS k, timestamp_seconds(id) AS ts, id AS seq FROM range({n})")
    rows = burst.in_order(events, ["k"], [])
    sizes = [r[0] for r in rows.groupBy(F.shiftright("place", 33)).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < n
    hits = burst_windows(events, ["k"], 5, 60, chunk_rows=3)
    found = hits.agg(F.count("*"), F.count_if(F.col("seq") % 5 == 4), F.count_distinct("seq")).first()
    assert tuple(found) == (n // 5, n // 5, n // 5)
