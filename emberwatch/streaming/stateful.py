"""Detections that remember something between micro-batches, in Spark's own state.

Each takes a stream with `ts` and gives a stream in append mode. Its watermark lies `lateness`
behind the newest row seen; rows up to it are complete, are worked off in the order of time and
line, and rows that arrive behind it are dropped by Spark, which counts them
(`numRowsDroppedByWatermark` in the query's progress). So results do not depend on where batches
are cut. Rows of one moment may arrive in different batches, so `lateness` must be positive and has
no default.

What waits for the watermark comes out as later rows move it on. At the end of a bounded stream one
row far in the future (`closing_row`) does so.
"""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch.functions.audit import correlate_audit, type_audit
from emberwatch.functions.honeypot import sessionize
from emberwatch.session import configure

#: What a closing row carries.
END_OF_TIME = "2200-01-01 00:00:00"


def closing_row(rows: DataFrame) -> DataFrame:
    """One of the rows, moved to the end of time: it closes everything and is never complete itself.

    `rows` must be such that the detection counts; it does not see the others.
    """
    return rows.limit(1).withColumn("ts", F.lit(END_OF_TIME).cast("timestamp"))


class InOrder(StatefulProcessor):
    """Gives each row of a key to `advance` once the watermark has passed it.

    Waiting rows are a list, what `advance` remembers is one value. A timer for the oldest waiting row
    wakes the key when it is complete, another forgets what is remembered when it can no longer count.
    """

    #: Columns of a waiting row, `t` (epoch microseconds) and `seq` first, and their types.
    FIELDS = "t BIGINT, seq BIGINT"
    #: Names and types of a result, after the key.
    RESULT = ""

    def __init__(self, key: str, kind: str):
        self.result = f"{key} {kind}, {self.RESULT}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.FIELDS)
        self.memory = handle.getValueState("memory", "value STRING, until BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [field.split()[0] for field in self.FIELDS.split(", ")]
        new = [tuple(row[name] for name in names) for row in rows]
        self.waiting.appendList(new)
        self._wake(min(row[0] for row in new))
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _drain(self, key, watermark: int) -> Iterator[Row]:
        passed = watermark * 1000
        rows = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = [row for row in rows if row[0] <= passed]
        had = self.memory.get() if self.memory.exists() else None
        if due:
            rest = [row for row in rows if row[0] > passed]
            if rest:
                self.waiting.put(rest)
                self._wake(min(row[0] for row in rest))
            else:
                self.waiting.clear()
            memory = json.loads(had[0]) if had else None
            memory, until, found = self.advance(memory, sorted(due, key=self.order))
            if memory is None:
                self.memory.clear()
            else:
                self.memory.update((json.dumps(memory), until))
                self._wake(until)
            result = Row(*[field.split()[0] for field in self.result.split(", ")])
            for values in found:
                yield result(*key, *values)
        elif had is not None and had[1] <= passed and not rows:
            self.memory.clear()

    @staticmethod
    def order(row: tuple) -> tuple:
        return row[:2]

    def advance(self, memory, rows: list[tuple]) -> tuple:
        """(memory or None, until when it counts, results) after complete rows in order."""
        raise NotImplementedError


class Bursts(InOrder):
    """N events within W, starting over after each hit. Remembered are fewer than N rows."""

    RESULT = "count BIGINT, first_t BIGINT, last_t BIGINT, seq BIGINT"

    def __init__(self, key: str, kind: str, threshold: int, window: int):
        super().__init__(key, kind)
        self.n, self.window = threshold, window

    def advance(self, memory, rows):
        held, found = memory or [], []
        for t, seq in rows:
            held = [e for e in held if t - e <= self.window] + [t]
            if len(held) >= self.n:
                found.append((len(held), held[0], t, seq))
                held = []
        return (held, held[-1] + self.window, found) if held else (None, None, found)


class Successes(InOrder):
    """Logins after failures. Remembered are their number, the first and the last of them."""

    FIELDS = "t BIGINT, seq BIGINT, username STRING, failed BOOLEAN"
    RESULT = "username STRING, seq BIGINT, failures BIGINT, first_t BIGINT, last_t BIGINT, t BIGINT"

    def __init__(self, threshold: int, window: int, forget: int):
        super().__init__("source_ip", "STRING")
        self.n, self.window, self.forget = threshold, window, max(forget, window)

    @staticmethod
    def order(row):
        # Failures of the moment of a login count.
        return row[0], not row[3], row[1]

    def advance(self, memory, rows):
        n, first, last = memory or (0, None, None)
        found = []
        for t, seq, username, failed in rows:
            if n and t - last > self.forget:
                n, first, last = 0, None, None
            if failed:
                n, first, last = n + 1, t if first is None else first, t
            elif n >= self.n and t - last <= self.window:
                found.append((username, seq, n, first, last, t))
        return ([n, first, last], last + self.forget, found) if n else (None, None, found)


def _watermarked(events: DataFrame, lateness: str) -> DataFrame:
    """Events with a watermark and `t`. Processors keep more than one kind of state and timers, which Spark's
    default state store cannot; a query takes the store that is set when it starts."""
    configure(events.sparkSession, streaming=True)
    return events.withWatermark("ts", lateness).withColumn("t", F.unix_micros("ts"))


def stream_bursts(events: DataFrame, key: str, threshold: int, window_seconds: int, lateness: str) -> DataFrame:
    """`burst_windows` over a stream: the key, `count`, `first_seen`, `last_seen` and `seq` of each hit."""
    kind = events.schema[key].dataType.simpleString()
    rows = _watermarked(events, lateness).select(key, "ts", "t", "seq").filter(F.col(key).isNotNull())
    bursts = Bursts(key, kind, int(threshold), int(window_seconds) * 1_000_000)
    hits = rows.groupBy(key).transformWithState(bursts, bursts.result, "Append", "EventTime")
    return hits.select(
        key,
        "count",
        F.timestamp_micros("first_t").alias("first_seen"),
        F.timestamp_micros("last_t").alias("last_seen"),
        "seq",
    )


def stream_success_at_login(
    auth: DataFrame, threshold: int, window_seconds: int, forget_seconds: int, lateness: str
) -> DataFrame:
    """`success_at_login` over a stream. Failures of an address that was quiet for longer than
    `forget_seconds` no longer count, so an address is remembered for that time only."""
    rows = _watermarked(auth, lateness).filter(
        F.col("auth_result").isin("failed", "accepted") & F.col("source_ip").isNotNull()
    )
    failed = (F.col("auth_result") == "failed").alias("failed")
    successes = Successes(int(threshold), int(window_seconds) * 1_000_000, int(forget_seconds) * 1_000_000)
    found = rows.select("source_ip", "ts", "t", "seq", "username", failed).groupBy("source_ip")
    found = found.transformWithState(successes, successes.result, "Append", "EventTime")
    return found.select(
        "source_ip", "username", "seq", "failures",
        F.timestamp_micros("first_t").alias("first_failure"),
        F.timestamp_micros("last_t").alias("last_failure"),
        F.timestamp_micros("t").alias("success_time"),
        (F.col("t") - F.col("last_t")).alias("gap"),
    )


def stream_sessions(events: DataFrame, idle_seconds: int, lateness: str) -> DataFrame:
    """Honeypot sessions of a stream, each given out once nothing of it came for `idle_seconds`;
    what comes later under its name is a session of its own. Spark keeps the state of the
    aggregates, not the rows."""
    gap = F.session_window("ts", f"{int(idle_seconds)} seconds")
    return sessionize(events.withWatermark("ts", lateness), by=[gap, "session_id"])


def stream_audit_events(lines: DataFrame, lateness: str) -> DataFrame:
    """Audit events of a stream of lines (`value`, `seq`): an event is complete, and its state gone,
    when the watermark has passed the one time that all its lines carry."""
    return type_audit(correlate_audit(lines, lateness))
