import json

from pyspark.sql import Observation

from emberwatch import constants as K
from emberwatch.sources import files
from emberwatch.streaming.run import run_available


def test_counts_come_from_one_scan(spark, tmp_path):
    (tmp_path / "a.log").write_text("no time\nJan 15 10:30:00 h p: x\n\nJan 15 10:30:01 h p: y\n")
    table = files.read_events(spark, str(tmp_path / "a.log"), K.AUTH_LOG, 2026)
    counts = files.count_lines({K.AUTH_LOG: table})
    # The log itself is scanned once; the other reader lists its files.
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert [(r.source, r.events, r.parse_errors) for r in counts.collect()] == [(K.AUTH_LOG, 2, 1)]
    events, rejects = table
    assert (events.count(), rejects.count(), table.checked.count()) == (2, 1, 3)


def test_events_count_their_rejects(spark, tmp_path, lines):
    table = files.normalize(lines("no time", "Jan 15 10:30:00 h p: x"), K.AUTH_LOG, 2026)
    counts = Observation("auth")
    files.observed(table, counts).write.parquet(str(tmp_path / "events"))
    assert counts.get == {"events": 1, "parse_errors": 1}
    assert spark.read.parquet(str(tmp_path / "events")).columns == table.events.columns


def test_broken_cloud_file_on_a_stream_leaves_its_name(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "1.json").write_text(json.dumps({"Records": [{"eventName": "A"}, {"eventName": "B"}]}))
    (tmp_path / "landing" / "2.json").write_text('{"Records": [{"eventName": "cut')
    (tmp_path / "landing" / "3.json").write_text('{"other": 1}')
    run_available(files.stream_checked_cloud_files(spark, landing), out, state)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.file_name, r.reason, r.record is None) for r in rows if r.reason) == [("2.json", "broken file", True)]
    assert sorted(json.loads(r.record)["eventName"] for r in rows if not r.reason) == ["A", "B"]
