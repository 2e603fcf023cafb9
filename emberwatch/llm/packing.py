"""Packing documents into sequences of fixed length by linear grouping.

The lengths of the pieces are whole numbers up to the capacity, so the driver plans with their histogram, which has at
most `capacity` entries however many documents there are. Large lengths are sorted and cut into groups of equal
cardinality; each is rounded up to the largest of its group. With so few sizes, the best shares of configurations (what
can stand in one sequence) are a linear program, solved by column generation. Whole copies of the configurations are
filled with the actual documents, which are at most as long as their group's size; what is left and the small lengths go
into the tightest gaps, longest first, or into new sequences.

The plan names documents by (length, rank among those of that length). Copies of a configuration that hold the same
lengths are one line of it, so its size depends on the capacity and the number of groups, not on the documents.
"""

import json
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

#: Tokens of a sequence, the part of one that a large length exceeds (one of so many), and the sizes that large lengths
#: are rounded up to.
CAPACITY, LARGE, GROUPS = 2048, 4, 48
#: Characters that go to the tokenizer at once, and tokens that leave the task at once.
BLOCK_CHARS, BLOCK_TOKENS = 1_000_000, 2_000_000
#: Rows that are numbered together.
BLOCK_ROWS = 1 << 16
#: What ends a document.
END = 0

PIECE = "row BIGINT, doc_id BIGINT, piece INT, start BIGINT, length INT, ids BINARY"
PLAN = "length INT, first BIGINT, stop BIGINT, each INT, base BIGINT, at INT"


# --- the plan -------------------------------------------------------------------------------------------------------


def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """(size, documents) of groups of equal cardinality, each rounded up to its longest.

    `lengths` are (length, count), longest first. Groups of one size are one, and the cardinality is the smallest that
    leaves at most `groups` sizes: a length that a third of all documents have does not make the others coarse.
    """

    def cut(each: int) -> list[list[int]]:
        found, room = [], 0
        for length, n in lengths:
            while n:
                if not room:
                    if not found or found[-1][0] != length:
                        found.append([length, 0])
                    # As many whole groups as this length fills are one.
                    room = max(each, n // each * each)
                take = min(room, n)
                found[-1][1] += take
                n, room = n - take, room - take
        return found

    least, most = 1, sum(n for _, n in lengths)
    while least < most:
        middle = (least + most) // 2
        if len(cut(middle)) <= groups:
            most = middle
        else:
            least = middle + 1
    return [(size, n) for size, n in cut(least)]


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack), as counts."""
    value, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, value[np.maximum(room - sizes, 0)] + worth, -1.0)
        best = int(gain.argmax())
        if gain[best] > value[room - 1] + 1e-12:
            value[room], chosen[room] = gain[best], best
        else:
            value[room] = value[room - 1]
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(value[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the cheapest fractional cover of the demand.

    Revised simplex: the basis starts with one pattern for each size, and the pattern with the best reduced cost
    enters until none is worth more than a sequence.
    """
    patterns = np.diag(capacity // sizes).astype(float)
    inverse, used = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(40 * len(sizes)):
        worth = inverse.sum(axis=0)
        value, counts = best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-6:
            break
        column = inverse @ counts
        ratio = np.where(column > 1e-9, used / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * column, 0)
        used[out] = step
        patterns[:, out] = counts
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    return patterns.astype(int), used


class _Left:
    """Documents without a place yet: of each length a range of ranks."""

    def __init__(self, counts: dict[int, int]):
        self.ranks = {length: [0, n] for length, n in counts.items()}
        self.lengths = sorted(self.ranks)

    def take(self, longest: int, n: int) -> tuple[int, int, int] | None:
        """(length, first rank, how many) of up to n of the longest documents that are at most so long."""
        place = bisect_right(self.lengths, longest) - 1
        if place < 0:
            return None
        length = self.lengths[place]
        first, stop = self.ranks[length]
        n = min(n, stop - first)
        if first + n == stop:
            self.lengths.pop(place)
        self.ranks[length][0] = first + n
        return length, first, n


class Plan:
    """Lines (length, first, stop, each, base, at): the documents of that length with rank first..stop-1 stand `each`
    in a sequence, from sequence `base` and place `at` on."""

    def __init__(self, capacity: int):
        self.capacity, self.lines, self.sequences = capacity, [], 0
        self.gaps, self.free = [], defaultdict(list)  # distinct gaps, and runs (base, copies) with that gap

    def _line(self, length: int, first: int, n: int, each: int, base: int, at: int) -> None:
        self.lines.append((length, first, first + n, each, base, at))

    def _leave(self, gap: int, base: int, copies: int) -> None:
        if gap and copies:
            if not self.free[gap]:
                insort(self.gaps, gap)
            self.free[gap].append((base, copies))

    def configuration(self, sizes: list[int], copies: int, left: _Left) -> None:
        """Copies of a configuration with actual documents: the longest that are left up to the size of each slot,
        and in the last slot up to the room that the others leave."""
        todo = [(self.sequences, copies, 0, 0)]
        self.sequences += copies
        while todo:
            base, n, slot, at = todo.pop()
            if slot == len(sizes):
                self._leave(self.capacity - at, base, n)
                continue
            room = self.capacity - at
            found = left.take(room if slot == len(sizes) - 1 else min(sizes[slot], room), n)
            if found is None:
                self._leave(room, base, n)
                continue
            length, first, some = found
            self._line(length, first, some, 1, base, at)
            if some < n:
                todo.append((base + some, n - some, slot, at))
            todo.append((base, some, slot + 1, at + length))

    def best_fit(self, length: int, first: int, n: int) -> None:
        """Documents of one length into the tightest gaps, then into new sequences."""
        while n:
            place = bisect_left(self.gaps, length)
            if place == len(self.gaps):
                copies = -(-n // (self.capacity // length))
                self._leave(self.capacity, self.sequences, copies)
                self.sequences += copies
                continue
            gap = self.gaps[place]
            base, copies = self.free[gap].pop()
            if not self.free[gap]:
                self.gaps.pop(place)
            each = min(gap // length, n)
            full = min(copies, n // each)
            self._line(length, first, full * each, each, base, self.capacity - gap)
            self._leave(gap - each * length, base, full)
            self._leave(gap, base + full, copies - full)
            first, n = first + full * each, n - full * each


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: int = LARGE) -> Plan:
    """Where the documents of each length go; `counts` holds lengths from 1 to the capacity."""
    out = Plan(capacity)
    ordered = sorted(counts.items(), reverse=True)
    big = [x for x in ordered if x[0] * large > capacity]
    left = _Left(counts)
    if big:
        grouped = linear_groups(big, groups)
        sizes, demand = (np.array(column) for column in zip(*grouped))
        patterns, used = configurations(sizes, demand.astype(float), capacity)
        for pattern, copies in zip(patterns.T, np.floor(used + 1e-9).astype(int).tolist()):
            if copies:
                out.configuration(np.repeat(sizes, pattern).tolist(), copies, left)
    for length in reversed(left.lengths):
        first, stop = left.ranks[length]
        out.best_fit(length, first, stop - first)
    return out


# --- tokens ---------------------------------------------------------------------------------------------------------

# A blank after a character that is none: the tokenizer's pattern starts a token there whatever comes before or after.
_CUT = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """The vocabulary of a byte-level tokenizer file as ranks.

    Such a file writes each byte as a character: printable ones as themselves, the others as those from U+0100 on.
    The ids must be in the order of the merges, as they are where a vocabulary was written while it was trained.
    """
    import tiktoken

    with open(path, encoding="utf-8") as source:
        model = json.load(source)["model"]
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    places = [model["vocab"][token] for token in merged]
    if places != sorted(places):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    known = [token for token in model["vocab"] if len(token) == 1] + merged
    ranks = {bytes(map(byte.__getitem__, token)): model["vocab"][token] for token in known}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ids(text: str, encoder) -> np.ndarray:
    """Ids of a whole text, a very long one block by block, and the end id."""
    found, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + BLOCK_CHARS)
        stop = cut.start() if cut else len(text)
        found.append(np.array(encoder.encode_ordinary(text[at:stop]), "<u4"))
        at = stop
    return np.concatenate([*found, np.array([END], "<u4")])


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of every document (null text: none) and the end id, cut into pieces of `capacity`; the first piece of
    a document may be shorter. Stored: row, doc_id, piece, start, length, ids (unsigned, 32 bits, low byte first).

    Ids are those of the tokenizer file at `path`, whose pre-tokenisation is `pattern`; special tokens in a text are
    ordinary text. `row` numbers the pieces, so that repeated rows and null doc_ids stay apart.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, size = _encoder(path, pattern), [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = _ids(text.as_py() or "", encoder)
                ends = np.arange(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for piece, end in enumerate(ends.tolist()):
                    start = ends[piece - 1].item() if piece else 0
                    rows.append((doc_id.as_py(), piece, start, end - start, ids[start:end].tobytes()))
                    size += end - start
                    if size >= BLOCK_TOKENS:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE.split(", ", 1)[1])
    return stored(made.select(F.monotonically_increasing_id().alias("row"), "*"), "pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    names = ["doc_id", "piece", "start", "length", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


# --- placing --------------------------------------------------------------------------------------------------------


def place(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> DataFrame:
    """Stored pieces with `ids_crc32`, `sequence_id` and `offset` instead of the ids, as few sequences as the plan
    finds. Pieces of the whole capacity are sequences of their own, with negative numbers.

    To the driver comes one count for each length. Ranks among pieces of one length are counted by blocks of rows, so
    a length with a third of all rows is many tasks.
    """
    spark = found.sparkSession
    block = F.shiftright("row", BLOCK_ROWS.bit_length() - 1).alias("block")
    short = found.where(F.col("length") < capacity)
    numbers = short.groupBy("length", block).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = stored(numbers.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Written, so that Spark knows its size when it chooses the join.
    lines = stored(spark.createDataFrame(plan(counts, capacity, groups, large).lines, PLAN).coalesce(1), "plan")

    wanted = ["row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")]
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1
    ranked = short.select(*wanted, block).withColumn("within", within).join(numbers, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).drop("n", "before", "within", "block")
    placed = ranked.join(lines, "length").where("rank >= first and rank < stop")
    placed = placed.select(
        "row", "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("base + (rank - first) div each").alias("sequence_id"),
        F.expr("cast(at + (rank - first) % each * length as bigint)").alias("offset"),
    )
    own = found.where(F.col("length") == capacity).select(
        *wanted, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return placed.unionByName(own)


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (joined by offset), doc_ids and lengths of their pieces in order."""
    parts = placed.select("row", "sequence_id", "offset").join(found.select("row", "doc_id", "length", "ids"), "row")
    part = F.struct("offset", "doc_id", "length", "ids")
    parts = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )
