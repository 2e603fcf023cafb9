"""Following logs that grow, are cut off and are rotated."""

import os

import pytest

from emberwatch.sources import growing
from emberwatch.streaming.run import run_available


class Followed:
    """A stream over a folder, run as often as asked; `new` gives what a run added."""

    def __init__(self, spark, folder, path=None, **options):
        self.spark, self.folder, self.options, self.had = spark, folder, options, set()
        self.path = path or str(folder / "log" / "auth.log*")
        (folder / "log").mkdir()

    def new(self):
        out = str(self.folder / "out")
        run_available(growing.follow(self.spark, self.path, **self.options), out, str(self.folder / "state"))
        rows = self.spark.read.parquet(out).collect()
        found = [(r.log, r.seq, r.value) for r in rows]
        assert len(set(found)) == len(found)
        fresh = sorted(set(found) - self.had)
        self.had |= set(fresh)
        return sorted(value for _, _, value in fresh)


def test_growth_shrinking_and_rotation(spark, tmp_path):
    followed, log = Followed(spark, tmp_path), tmp_path / "log" / "auth.log"
    log.write_bytes(b"one\ntwo\n\n  \nthr")
    assert followed.new() == ["one", "two"]
    assert followed.new() == []
    with log.open("ab") as more:
        more.write(b"ee\r\nfour \xff\n")
    assert followed.new() == ["four �", "three"]
    # Renamed with a last line that was not read yet, and a new file in its place.
    with log.open("ab") as more:
        more.write(b"five\n")
    os.rename(log, tmp_path / "log" / "auth.log.1")
    log.write_bytes(b"six\n")
    assert followed.new() == ["five", "six"]
    # Cut off and refilled: it starts at its first byte, also where it is longer than before.
    log.write_bytes(b"seven\neight\nnine\n")
    assert followed.new() == ["eight", "nine", "seven"]
    # Shorter than before with the same first line.
    log.write_bytes(b"seven\n")
    out = growing.new_ranges({"a": {"log": "x", "end": 17}}, {"a": {"log": "x", "end": 6}})
    assert out == [("a", 0, 6)]


def test_splits_give_each_line_once(spark, tmp_path):
    lines = ["x" * (i * 7 % 23) + str(i) for i in range(400)]
    followed = Followed(spark, tmp_path, splitBytes=37)
    (tmp_path / "log" / "auth.log").write_text("\n".join(lines) + "\n")
    assert followed.new() == sorted(lines)


def test_long_lines_and_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 5)
    path = tmp_path / "a.log"
    path.write_bytes(b"first line\n" + b"y" * 5000 + b"\nlast\nopen")
    reader = growing.GrowingLogReader({"path": str(tmp_path), "splitBytes": 11})
    end = reader.latestOffset()
    assert end[str(path)]["end"] == 11 + 5001 + 5
    rows = [r for split in reader.partitions({}, end) for r in reader.read(split)]
    assert [(value, seq) for value, _, _, seq in rows] == [("first line", 0), ("y" * 5000, 11), ("last", 5012)]
    assert reader.partitions(end, end) == []


def test_missing_paths_and_removed_logs(tmp_path):
    assert growing.listed(str(tmp_path / "none")) == {} == growing.listed(str(tmp_path / "none" / "*.log"))
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\n")
    reader = growing.GrowingLogReader({"path": str(tmp_path)})
    splits = reader.partitions({}, reader.latestOffset())
    path.write_bytes(b"other\n")
    with pytest.raises(FileNotFoundError):
        list(reader.read(splits[0]))
    assert list(growing.GrowingLogReader({"path": str(tmp_path), "skipMissing": "true"}).read(splits[0])) == []


def test_two_logs_with_one_first_line(tmp_path):
    """Told apart by their names as long as these stay."""
    for name in ("a", "b"):
        (tmp_path / name).write_text(f"header\n{name}1\n")
    reader = growing.GrowingLogReader({"path": str(tmp_path)})
    start = reader.latestOffset()
    for name in ("a", "b"):
        with (tmp_path / name).open("a") as more:
            more.write(f"{name}2\n")
    rows = [r for s in reader.partitions(start, reader.latestOffset()) for r in reader.read(s)]
    assert sorted(r[0] for r in rows) == ["a2", "b2"]
