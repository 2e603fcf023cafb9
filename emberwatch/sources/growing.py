"""Following log files that grow and are rotated: a streaming Python data source.

The offset of the stream holds, for each file, which log it is and how many bytes of it have been
given out. A log is known by its first line, so a file that shrank or was replaced starts at its
first byte again, and one that was renamed goes on where it stood. Only whole lines are given out;
the rest of a file waits for its line end.

    spark.dataSource.register(GrowingLog)
    spark.readStream.format("growing_log").load("/var/log/auth.log*")

Options: `path`, a file, a folder, or a pattern for the names in a folder; `splitBytes`, how much
of a file one task reads (64 MB); `skipMissing`, whether lines of a log that was removed before
they were read are skipped (by default the query fails). A file cut off and refilled beyond the
old place with the same first line looks like one that grew.

Rows have `value` (undecodable bytes become the replacement character, the line end is left out),
`log_file`, `log` (the first line's digest) and `seq` (the byte of the file the line starts at: it
follows the lines of a log). Blank lines are left out.
"""

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Bytes of a first line that tell logs apart, and bytes read at once to find a line end.
FIRST_LINE, BLOCK = 4096, 1 << 16


def opened(path: str):
    """File system and path. Python tasks have no Hadoop client; what pyarrow opens can be followed."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def listed(path: str) -> dict[str, int]:
    """Sizes of the files that a path names: a file, those in a folder, or those a pattern matches."""
    from pyarrow import fs

    files, place = opened(path)
    folder, _, name = place.rpartition("/")
    info = None if any(c in name for c in "*?[") else files.get_file_info(place)
    if info is not None and info.type == fs.FileType.File:
        return {place: info.size}
    if info is not None and info.type != fs.FileType.Directory:
        return {}
    within, pattern = (place, "*") if info is not None else (folder or "/", name)
    found = files.get_file_info(fs.FileSelector(within, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)}


def log_identity(source) -> str | None:
    """The digest of a file's first line; None while it has no line end yet."""
    source.seek(0)
    head = source.read(FIRST_LINE)
    line, end, _ = head.partition(b"\n")
    return hashlib.sha1(line).hexdigest() if end or len(head) == FIRST_LINE else None


def whole_lines(source, size: int) -> int:
    """Where the last line end before `size` is passed."""
    stop = size
    while stop > 0:
        start = max(0, stop - BLOCK)
        source.seek(start)
        at = source.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


@dataclass
class Split(InputPartition):
    path: str
    log: str
    first: int
    start: int
    stop: int


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.skip_missing = str(options.get("skipMissing", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = opened(self.path)
        found = {}
        for place, size in sorted(listed(self.path).items()):
            try:
                with files.open_input_file(place) as source:
                    log = log_identity(source)
                    if log is not None:
                        found[place] = {"log": log, "end": whole_lines(source, size)}
            except FileNotFoundError:
                continue  # rotated away since it was listed; it is there again under its new name
        return found

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for place, first, stop in new_ranges(start, end):
            for at in range(first, stop, self.split_bytes):
                out.append(Split(place, end[place]["log"], first, at, min(at + self.split_bytes, stop)))
        return out

    def read(self, split: Split) -> Iterator[tuple]:
        files, _ = opened(self.path)
        source = self._open(files, split)
        if source is None:
            return
        with source:
            # A split gives out the lines that start in it; the first range starts at a line's start.
            at = split.start
            if at > split.first:
                source.seek(at - 1)
                at += len(_line(source)) - 1
            source.seek(at)
            while at < split.stop:
                line = _line(source)
                if not line:
                    break
                value = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if value.strip():
                    yield value, split.path, split.log, at
                at += len(line)

    def _open(self, files, split: Split):
        """The file of a split, by its name, or by its first line if it was renamed since."""
        for place in [split.path, *sorted(listed(self.path))]:
            try:
                source = files.open_input_file(place)
            except FileNotFoundError:
                continue
            if log_identity(source) == split.log and source.size() >= split.stop:
                return source
            source.close()
        if self.skip_missing:
            return None
        raise FileNotFoundError(f"{split.path} was rotated out of {self.path} before all its lines were read")


def _line(source) -> bytes:
    """The next line with its end; file handles of pyarrow have no buffered readline."""
    parts = []
    while block := source.read(BLOCK):
        at = block.find(b"\n")
        if at >= 0:
            parts.append(block[: at + 1])
            source.seek(source.tell() - len(block) + at + 1)
            break
        parts.append(block)
    return b"".join(parts)


def new_ranges(start: dict, end: dict) -> list[tuple[str, int, int]]:
    """(file, first byte, stop) of what lies between two offsets."""
    still = {(place, own["log"]) for place, own in end.items()}
    moved = {own["log"]: own["end"] for place, own in start.items() if (place, own["log"]) not in still}
    out = []
    for place, own in end.items():
        before = start.get(place)
        if before and before["log"] == own["log"]:
            first = before["end"]
        else:
            first = moved.get(own["log"], 0)
        first = first if first <= own["end"] else 0
        if first < own["end"]:
            out.append((place, first, own["end"]))
    return out


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "value STRING, log_file STRING, log STRING, seq BIGINT"

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of growing logs as a stream."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").options(**options).load(path)
