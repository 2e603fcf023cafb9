"""Repair of conversations by weighted CYK parsing.

A repaired conversation has role initials `(s?(ua)+)?`. Its repair grammar in Chomsky normal form has a nonterminal for
every two states of that language (nothing yet, after s, after u, after a): [p, q] stands for a span of turns and the
edits that lead from p to q.

    [p, q] -> [p, r] [r, q]     two spans side by side
    [p, q] -> turn              keep, rerole or delete one turn, with the cost of the edit
    [p, p] -> nothing; [p, q] -> insertions from p to q

The last line is closed over repeated insertions and folded into the cells of single turns, so no rule is left that
reads nothing. A cell holds, for each nonterminal, the least (cost, audit). Because the nonterminals are pairs of
states, every split of a span has the same least derivation, so one split is enough: spans of 1, 2, 4, ... turns are
combined bottom-up. Equal costs keep the smaller audit, which stays smaller whatever comes before or after: two audits
of one span and cost cannot be prefixes of each other, as the longer would have to pay for more insertions.

For the same reason spans need not be in one task. Turns are sorted over all partitions, a row holds the cells of at
most `SPAN` turns, and those of a longer conversation are combined `FAN` at a time until one is left.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

#: Turns whose cells are computed in one row (a power of two), and rows that are combined at once.
SPAN, FAN = 512, 64
#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
#: Where a role's initial leads, from each state in which it may come.
MOVES = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: States in which a conversation may end.
ENDS = (START, ASSISTANT)
_VISIBLE = r"[^\x20\x09-\x0D]"

Cells = list[tuple[int, str] | None]



def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which null keys meet."""
    for key in keys:
        right = right.withColumnRenamed(key, f"its_{key}")
    same = [F.col(key).eqNullSafe(F.col(f"its_{key}")) for key in keys]
    return left.join(right, same, how).drop(*[f"its_{key}" for key in keys])


# --- damage and faults ----------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text,
    2 removes its `[.!?]`, 3 repeats it, 4 makes it the user's. Null roles and texts, and nulls in the key, read as one
    space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fate = F.crc32(key) % 20
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), fate.alias("fate"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
    ).where("fate <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit(""))
        .when(F.col("fate") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with `place`, in the order of conversation, turn (nulls first), role and text over all partitions.

    Sorted by ranges, so that a conversation with a third of all rows is many tasks. A place is the partition and the
    row in it: rows of one conversation follow each other.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select("*", F.monotonically_increasing_id().alias("place")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """Stored (conv_id, place, turn, initial, fault): the first fault of each row, `b`lank, `d`uplicate, `t`runcated
    or none. A duplicate has the role and text (by SHA-256) of an earlier row of its conversation."""
    last = F.regexp_extract("text", rf"(?s)({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    marks = rows.select(
        "conv_id", "place", "turn", "role",
        F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("").alias("own"),
        F.sha2("text", 256).alias("digest"),
    )
    first = marks.where("own <> 'b'").groupBy("conv_id", "role", "digest")
    first = first.agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = (F.col("own") != "b") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    found = _with(marks, first, ["conv_id", "role", "digest"], "left").select(
        "conv_id", "place", "turn", "initial", F.when(again, "d").otherwise(F.col("own")).alias("fault")
    )
    return stored(found, "faults")


# --- cells ----------------------------------------------------------------------------------------------------------


def combined(left: Cells, right: Cells) -> Cells:
    """[p, q] -> [p, r] [r, q]."""
    out: Cells = [None] * 16
    for p in STATES:
        for r in STATES:
            a = left[4 * p + r]
            if a is None:
                continue
            for q in STATES:
                b = right[4 * r + q]
                if b is not None:
                    cost, had = a[0] + b[0], out[4 * p + q]
                    if had is None or cost <= had[0]:
                        new = (cost, a[1] + b[1])
                        if had is None or new < had:
                            out[4 * p + q] = new
    return out


def insertions() -> Cells:
    """The closure of inserting turns without reading one."""
    cells: Cells = [None] * 16
    for p in STATES:
        cells[5 * p] = (0, "")
        for role in "ua":
            if p in MOVES[role]:
                cells[4 * p + MOVES[role][p]] = (INSERT, "I")
    while (more := combined(cells, cells)) != cells:
        cells = more
    return cells


@lru_cache(maxsize=None)
def turn_cells(symbol: str) -> Cells:
    """Cells of one turn: `x` must be deleted, else its initial (`o` for other roles), a capital if truncated."""
    cells: Cells = [None] * 16

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        had = cells[4 * p + q]
        if had is None or (cost, edit) < had:
            cells[4 * p + q] = (cost, edit)

    for p in STATES:
        offer(p, p, DELETE, "D")
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for p, q in MOVES.get(symbol.lower(), {}).items():
            offer(p, q, extra, "K")
        for role in "ua":
            for p, q in MOVES[role].items():
                offer(p, q, REROLE + extra, "R")
    around = insertions()
    return combined(combined(around, cells), around)


@lru_cache(maxsize=50_000)
def _few(symbols: str) -> Cells:
    """Cells of a short span; short conversations are much alike."""
    if len(symbols) == 1:
        return turn_cells(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combined(_few(symbols[:half]), _few(symbols[half:]))


def span_cells(symbols: str) -> Cells:
    """Cells of a span: those of neighbouring spans of 1, 2, 4, ... turns are combined until one is left."""
    spans = [_few(symbols[i : i + 8]) for i in range(0, len(symbols), 8)]
    while len(spans) > 1:
        spans = [combined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def least(cells: Cells) -> tuple[int, str]:
    return min(cells[q] for q in ENDS if cells[q] is not None)


def script(symbols: str, audit: str) -> str:
    """The audit of whole turns as edits that name their role: K and D as they are, U and A for a rerole, u and a for
    an insertion."""
    state, out, turn = START, [], 0
    for edit in audit:
        if edit == "D":
            out.append("D")
        elif edit == "K":
            state = MOVES[symbols[turn].lower()][state]
            out.append("K")
        else:
            state = ASSISTANT if state == USER else USER
            role = "a" if state == ASSISTANT else "u"
            out.append(role if edit == "I" else role.upper())
        turn += edit != "I"
    return "".join(out)


_CELL = "array<struct<cost: bigint, audit: string>>"
_NODE = f"conv_id bigint, rank bigint, first string, last string, illegal bigint, symbols string, cells {_CELL}"
_CELL_ARROW = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), _CELL_ARROW]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "rank", "first", "last", "illegal", "symbols", "cells"])


def _as_rows(cells: Cells) -> list[dict | None]:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in cells]


def _as_cells(rows: list[dict | None]) -> Cells:
    return [None if r is None else (r["cost"], r["audit"]) for r in rows]


def _symbol() -> Column:
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(role)).otherwise(role)


def _spans(marks: DataFrame) -> DataFrame:
    """The cells of up to SPAN turns that follow each other in a conversation, with what its illegal pairs need."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = [t["initial"] for t in r["turns"]]
                illegal = sum(not _legal(a, b) for a, b in zip(own, own[1:]))
                symbols = "".join(t["symbol"] for t in r["turns"])
                cells = _as_rows(span_cells(symbols))
                rows.append((r["conv_id"], r["rank"], own[0], own[-1], illegal, symbols, cells))
            if rows:
                yield _node_batch(rows)

    turn = F.struct("place", "initial", _symbol().alias("symbol"))
    span = F.shiftright("place", SPAN.bit_length() - 1).alias("rank")
    spans = marks.groupBy("conv_id", span).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return spans.mapInArrow(parse, _NODE)


def _joined(nodes: DataFrame) -> DataFrame:
    """Neighbouring spans as one, FAN at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = r["parts"]
                cells, illegal = _as_cells(parts[0]["cells"]), parts[0]["illegal"]
                for a, b in zip(parts, parts[1:]):
                    cells = combined(cells, _as_cells(b["cells"]))
                    illegal += b["illegal"] + (not _legal(a["last"], b["first"]))
                symbols = "".join(p["symbols"] for p in parts)
                first, last = parts[0]["first"], parts[-1]["last"]
                rows.append((r["conv_id"], r["rank"], first, last, illegal, symbols, _as_rows(cells)))
            if rows:
                yield _node_batch(rows)

    part = F.struct("rank", "first", "last", "illegal", "symbols", "cells")
    group = F.floor(F.col("rank") / FAN).cast("bigint").alias("rank")
    return nodes.groupBy("conv_id", group).agg(F.array_sort(F.collect_list(part)).alias("parts")).mapInArrow(join, _NODE)


def parse(marks: DataFrame) -> DataFrame:
    """Stored (conv_id, illegal, cost, audit, script) of every conversation with rows."""
    nodes = stored(_spans(marks), "spans")
    number = Window.partitionBy("conv_id")
    counted = nodes.select("conv_id", "rank").withColumn("of", F.count("*").over(number))
    several = stored(
        counted.where("of > 1").withColumn("nth", F.row_number().over(number.orderBy("rank")) - 1), "several"
    )
    long = several.select("conv_id").distinct()
    whole = _with(nodes, long, ["conv_id"], "left_anti")
    if not several.isEmpty():
        parts = _with(nodes, several, ["conv_id", "rank"], "inner").select(
            "conv_id", F.col("nth").cast("bigint").alias("rank"), "first", "last", "illegal", "symbols", "cells"
        )
        most = several.agg(F.max("of")).first()[0]
        while most > 1:
            parts, most = stored(_joined(parts), "spans"), -(-most // FAN)
        whole = whole.unionByName(parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [least(_as_cells(cells)) for cells in batch["cells"].to_pylist()]
            scripts = [script(s, audit) for s, (_, audit) in zip(batch["symbols"].to_pylist(), best)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["conv_id"], batch["illegal"], pa.array([c for c, _ in best], pa.int64()),
                    pa.array([a for _, a in best], pa.string()), pa.array(scripts, pa.string()),
                ],
                ["conv_id", "illegal", "cost", "audit", "script"],
            )

    result = "conv_id bigint, illegal bigint, cost bigint, audit string, script string"
    return stored(whole.mapInArrow(finish, result), "parsed")


# --- repaired turns -------------------------------------------------------------------------------------------------

_ROLES = {"u": "user", "a": "assistant"}


def repaired(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text, edit) of the repaired conversations; inserted turns have an empty text.

    Rows of a conversation are read in order after its script, one by one: a conversation's rows meet in one task,
    which sorts them (and spills) but holds one row at a time.
    """
    none = F.lit(None).cast("string")
    scripts = parsed.select("conv_id", F.lit(-1).cast("bigint").alias("place"), none.alias("role"), F.col("script").alias("text"))
    both = scripts.unionByName(rows.select("conv_id", "place", "role", "text"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, nth = "", 0, 0
        for batch in batches:
            out = []

            def insert() -> None:
                nonlocal at, nth
                while at < len(edits) and edits[at] in _ROLES:
                    out.append((conv_id, nth, _ROLES[edits[at]], "", "I"))
                    at, nth = at + 1, nth + 1

            for conv_id, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place < 0:
                    edits, at, nth = text, 0, 0
                    insert()
                    continue
                edit, at = edits[at], at + 1
                if edit != "D":
                    kept = role if edit == "K" else _ROLES[edit.lower()]
                    out.append((conv_id, nth, kept, text, "K" if edit == "K" else "R"))
                    nth += 1
                insert()
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "nth", "role", "text", "edit"])

    return both.mapInArrow(apply, "conv_id bigint, nth bigint, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` lines, from repaired turns as `repaired` gives them out: in order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            done = []
            for conv_id, nth, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "nth", "role", "text"))):
                if nth == 0:
                    if state is not None:
                        done.append((own, state.hexdigest()))
                    own, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield _digest_batch(done)
        if state is not None:
            yield _digest_batch([(own, state.hexdigest())])

    return turns.select("conv_id", "nth", "role", "text").mapInArrow(hashed, "conv_id bigint, repaired_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, found = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["conv_id", "repaired_sha256"])


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of `turns` (a null one is a conversation as well): faults and gaps after damage, the
    cheapest repair, and the digest of the repaired conversation.

    Rows of one turn stand in the order of role and text; repeated rows follow each other and are duplicates. Roles
    other than system, user and assistant are told apart by their initial. Further columns are not looked at. A
    conversation without rows after damage has zeros, an empty audit and the digest of an empty text; an empty table
    gives an empty one.
    """
    rows = ordered(damaged(turns))
    marks = faults(rows)
    parsed = parse(marks)
    digest = digests(repaired(rows, parsed))

    def number(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault)

    counts = marks.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        number("b").alias("blank"), number("d").alias("duplicate"), number("t").alias("truncated"),
    )
    out = turns.select(F.col("conv_id").cast("long")).distinct()
    for more in (counts, parsed.drop("script"), digest):
        out = _with(out, more, ["conv_id"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
