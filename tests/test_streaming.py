"""State between micro-batches: any cut of the input, also with rows out of order within the
lateness and with rows of one moment in two batches, gives the result of one batch query."""

import random
import time

import pytest
from pyspark.sql import functions as F

from events import START, at
from emberwatch.functions.audit import audit_line_time, correlate_audit, type_audit
from emberwatch.functions.honeypot import sessionize
from emberwatch.operators.burst import burst_windows
from emberwatch.operators.success import success_after_failures, success_at_login
from emberwatch.sources import files
from emberwatch.streaming.run import run_every
from emberwatch.streaming.stateful import (
    END_OF_TIME,
    closing_row,
    stream_audit_events,
    stream_bursts,
    stream_sessions,
    stream_success_at_login,
)


#: A watermark starts at 1970.
EPOCH = 1_700_000_000_000_000


def replay(spark, folder, batches, operator, restarts=()):
    """What an operator gives for batches of rows, one file each; the query is stopped and started
    again before the batches in `restarts`. Also the numbers of late rows and of rows of state."""
    landing, out, state = (str(folder / name) for name in ("landing", "out", "state"))
    late = held = 0

    def run():
        nonlocal late, held
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(landing)
        query = operator(stream).writeStream.format("parquet").option("path", out)
        query = query.option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [o for p in query.recentProgress for o in p["stateOperators"]]
        late += sum(o["numRowsDroppedByWatermark"] for o in progress)
        held = progress[-1]["numRowsTotal"] if progress else held

    for i, batch in enumerate(batches):
        if i in restarts:
            run()
        batch.coalesce(1).write.mode("append").parquet(landing)
        time.sleep(0.02)  # files are taken in the order of their times
    run()
    return spark.read.parquet(out), late, held


def cut(rows, cuts):
    """Batches of rows in the order of arrival, and one that closes the stream."""
    edges = [-1, *cuts, 1 << 40]
    parts = [rows.filter((F.col("arrival") > a) & (F.col("arrival") <= b)) for a, b in zip(edges, edges[1:])]
    return [part.drop("arrival") for part in [*parts, closing_row(rows)]]


def shuffled(rng, data, lateness):
    """(arrival, row): rows in order of time plus a delay below the lateness."""
    delayed = sorted(data, key=lambda r: r[1] + rng.randrange(lateness))
    return [(i, *r) for i, r in enumerate(delayed)]


@pytest.mark.parametrize("cuts, restarts", [((), ()), ((240,), (1,)), ((30, 60, 61, 62, 300, 420), (3,))])
def test_bursts(spark, tmp_path, cuts, restarts):
    rng = random.Random(11)
    # Whole seconds, so that many rows have one time and some of these arrive in two batches.
    data = [(key, EPOCH + i * 10_000_000 + rng.randrange(12) * 1_000_000) for i in range(90) for key in range(6)]
    data = [(k, t, i) for i, (k, t) in enumerate(sorted(data, key=lambda r: r[1]))]
    rows = spark.createDataFrame(shuffled(rng, data, 40_000_000), "arrival INT, k INT, t BIGINT, seq BIGINT")
    rows = rows.withColumn("ts", F.timestamp_micros("t")).drop("t").persist()
    found, late, _ = replay(spark, tmp_path, cut(rows, cuts), lambda s: stream_bursts(s, "k", 5, 45, "40 seconds"), restarts)
    columns = ["k", "count", "first_seen", "last_seen", "seq"]
    got = sorted(map(tuple, found.select(columns).collect()))
    want = sorted(map(tuple, burst_windows(rows.drop("arrival"), ["k"], 5, 45).select(columns).collect()))
    assert got == want and got and late == 0


def test_a_moment_cut_in_two(spark, tmp_path):
    """Five failures in three seconds, two of them in the last second and in different batches."""
    rows = [(i, 1, at(s), i) for i, s in enumerate([0, 1, 2, 3, 3])]
    rows = spark.createDataFrame(rows, "arrival INT, k INT, ts TIMESTAMP, seq BIGINT")
    found, late, _ = replay(spark, tmp_path, cut(rows, (3,)), lambda s: stream_bursts(s, "k", 5, 60, "1 second"), (1,))
    assert [(r.first_seen, r.last_seen, r.seq) for r in found.collect()] == [(at(0), at(3), 4)] and late == 0


def test_late_rows_are_counted_and_idle_keys_forgotten(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(pairs)], "k INT, ts TIMESTAMP, seq BIGINT")

    # Spark drops what was late a batch before.
    parts = [[(k, 0) for k in range(50)], [(1, 500)], [(2, 501)], [(1, 20), (1, 490)], [(7, 10_000)]]
    batches = [rows(*part) for part in parts]
    found, late, held = replay(spark, tmp_path, batches, lambda s: stream_bursts(s, "k", 2, 60, "30 seconds"))
    assert [(r.k, r.first_seen, r.last_seen) for r in found.collect()] == [(1, at(490), at(500))]
    # Only the row that waits is left, with its timer.
    assert late == 1 and held <= 2


@pytest.mark.parametrize("cuts, restarts", [((), ()), ((100,), (1,)), ((10, 11, 12, 13, 90, 170), ())])
def test_success_after_failures(spark, tmp_path, cuts, restarts):
    rng = random.Random(5)
    kinds = ["failed", "failed", "failed", "accepted"]
    data = [(f"192.0.2.{rng.randrange(4)}", EPOCH + rng.randrange(200) * 10_000_000, i, rng.choice(kinds)) for i in range(200)]
    rows = spark.createDataFrame(
        shuffled(rng, data, 50_000_000), "arrival INT, source_ip STRING, t BIGINT, seq BIGINT, auth_result STRING"
    )
    rows = rows.withColumn("ts", F.timestamp_micros("t")).withColumn("username", F.lit("u")).drop("t").persist()
    found, late, _ = replay(
        spark, tmp_path, cut(rows, cuts), lambda s: stream_success_at_login(s, 5, 60, 10_000, "50 seconds"), restarts
    )
    want = set()
    for ip, t, seq, kind in data:
        failures = [u for other, u, _, k in data if other == ip and k == "failed" and u <= t]
        if kind == "accepted" and len(failures) >= 5 and t - max(failures) <= 60_000_000:
            want.add((ip, seq, len(failures), t - max(failures)))
    found = found.collect()
    assert want and {(r.source_ip, r.seq, r.failures, r.gap) for r in found} == want and len(found) == len(want)
    assert late == 0
    batch = success_at_login(rows, 5, 60, chunk_seconds=100).collect()
    assert {(r.source_ip, r.seq, r.failures, r.gap) for r in batch} == want


def test_failures_after_a_login_do_not_count(spark, auth):
    failed = [dict(ts=at(i), source_ip="192.0.2.1", auth_result="failed") for i in (0, 1, 2, 3, 4, 70)]
    events = auth(*failed, dict(ts=at(60), source_ip="192.0.2.1", auth_result="accepted", username="u"))
    (found,) = success_at_login(events, 5, 600).collect()
    assert (found.failures, found.first_failure, found.last_failure) == (5, at(0), at(4))
    assert success_after_failures(events, 5, 600).count() == 0


def test_old_failures_are_forgotten(spark, auth, tmp_path):
    """One failure, a long pause, then a failure and a login: one failure is too few."""
    def one(s, result):
        return dict(ts=at(s), source_ip="192.0.2.1", auth_result=result, username="u")

    columns = ["source_ip", "username", "seq", "ts", "auth_result"]
    events = auth(one(0, "failed"), one(5000, "failed"), one(5001, "accepted"))
    parts = [events.filter(F.col("seq") == i).select(columns) for i in range(3)]
    parts.append(closing_row(events).select(columns))
    found, _, _ = replay(spark, tmp_path, parts, lambda s: stream_success_at_login(s, 2, 600, 600, "1 second"))
    assert found.count() == 0
    assert success_at_login(events, 2, 600).count() == 1


def test_sessions(spark, honeypot, tmp_path):
    """Given out when idle for five minutes, whatever the batches."""
    events = honeypot(
        dict(session_id="a", eventid="cowrie.session.connect", ts=at(0)),
        dict(session_id="b", eventid="cowrie.session.connect", ts=at(0)),
        dict(session_id="a", eventid="cowrie.command.input", input="ls", ts=at(20)),
        dict(session_id="a", eventid="cowrie.session.closed", duration_ms=30_000, ts=at(30)),
        dict(session_id="c", eventid="cowrie.session.connect", ts=at(40)),
        dict(session_id="c", eventid="cowrie.command.input", input="wget x; chmod +x x", ts=at(300)),
    ).drop("extra").persist()
    parts = [events.filter(F.col("seq").isin(*seqs)) for seqs in ((0, 1, 2), (3,), (4,), (5,))]
    found, late, held = replay(
        spark, tmp_path, [*parts, closing_row(events)], lambda s: stream_sessions(s, 300, "1 minute"), (2,)
    )
    columns = ["session_id", "start_time", "end_time", "command_count", "download_tools", "chmod_x_used"]
    want = sorted(map(tuple, sessionize(events).select(columns).collect()))
    assert sorted(map(tuple, found.select(columns).collect())) == want and len(want) == 3
    assert late == 0 and held == 1


def test_audit_events(spark, tmp_path):
    texts = [
        (i, f'type={kind} msg=audit({1705312200 + i // 4}.123:{i // 2}): exe="/bin/{i}" name="/n{i}"')
        for i in range(40) for kind in ["SYSCALL" if i % 2 == 0 else "PATH"]
    ]
    lines = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "arrival INT, seq BIGINT, value STRING")
    end = spark.createDataFrame([(99, 99, "type=PATH msg=audit(7258118400.000:0): item=0")], lines.schema)
    edges = [-1, 2, 9, 30, 98, 99]
    whole = lines.unionByName(end)
    parts = [whole.filter(f"arrival > {a} and arrival <= {b}").drop("arrival") for a, b in zip(edges, edges[1:])]
    found, late, _ = replay(spark, tmp_path, parts, lambda s: stream_audit_events(s, "5 seconds"), (2,))
    batch = type_audit(correlate_audit(lines.drop("arrival")))
    columns = ["serial", "exe", "name"]
    got = sorted(map(tuple, found.select(columns).collect()))
    assert got == sorted(map(tuple, batch.select(columns).collect())) and len(got) == 20 and late == 0
    assert lines.select(audit_line_time(F.col("value"))).first()[0].year == 2024 and START.year < int(END_OF_TIME[:4])


def test_scheduled_run_numbers_lines_in_log_order(spark, tmp_path):
    landing, seen = tmp_path / "landing", []
    landing.mkdir()
    (landing / "b.log").write_text("1\n2\n")
    (landing / "a.log").write_text("".join(f"later {i}\n" for i in range(300)))

    def each(lines, batch):
        rows = files.number_batch(lines, batch, order="name").orderBy("seq").collect()
        seen.append([r.value for r in rows])
        seen.append([r.seq for r in rows])

    query = run_every(files.stream_lines(spark, str(landing)), each, str(tmp_path / "state"), seconds=1)
    query.processAllAvailable()
    (landing / "0.log").write_text("3\n")
    time.sleep(2)
    query.processAllAvailable()
    query.stop()
    assert seen[0] == [*[f"later {i}" for i in range(300)], "1", "2"] and seen[2] == ["3"]
    assert len(set(seen[1])) == 302 and max(seen[1]) < seen[3][0]


STORE = "spark.sql.streaming.stateStore.providerClass"


def test_processors_bring_their_state_store(spark, tmp_path):
    """A session that sets nothing has a store without column families."""
    before = spark.conf.get(STORE)
    data = [("a", EPOCH + i * 1_000_000, i, "accepted" if i == 6 else "failed", "u") for i in range(7)]
    rows = spark.createDataFrame(data, "source_ip STRING, t BIGINT, seq BIGINT, auth_result STRING, username STRING")
    rows = rows.withColumn("ts", F.timestamp_micros("t")).drop("t")
    try:
        spark.conf.unset(STORE)
        hits, _, _ = replay(
            spark, tmp_path / "bursts", [rows, closing_row(rows)],
            lambda s: stream_bursts(s, "source_ip", 5, 45, "40 seconds"),
        )
        spark.conf.unset(STORE)
        found, _, _ = replay(
            spark, tmp_path / "successes", [rows, closing_row(rows)],
            lambda s: stream_success_at_login(s, 5, 45, 90, "40 seconds"),
        )
        assert [r.seq for r in hits.collect()] == [4]
        assert [(r.seq, r.failures) for r in found.collect()] == [(6, 6)]
    finally:
        spark.conf.set(STORE, before)
