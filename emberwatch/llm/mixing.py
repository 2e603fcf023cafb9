"""Mixing sources to target weights: blocks of words, drawn by source for each output shard."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import BLANKS, portions, stored

WORD = re.compile(f"[^{BLANKS}]+")


def water_fill(weights: list[float], limits: list[float], total: float) -> list[float]:
    """Shares of `total` by weight that stop at their limits; what is above is shared again by weight."""
    shares, open_ = [0.0] * len(weights), set(range(len(weights)))
    while open_:
        rest = total - sum(shares[i] for i in range(len(weights)) if i not in open_)
        unit = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > limits[i]}
        if not full:
            for i in open_:
                shares[i] = weights[i] * unit
            return shares
        for i in full:
            shares[i] = float(limits[i])
        open_ -= full
    return shares


def _turned(x: np.ndarray, seed: int, turn: int, half: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 4 + turn) * 0xD1B54A32D192ED03 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(29)) & np.uint64((1 << half) - 1)


def permuted(index: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places, or its inverse: a Feistel network over an even number
    of bits, repeated until the value lies below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & low
        for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right ^ _turned(left, seed, turn, half), left
            else:
                left, right = right, left ^ _turned(right, seed, turn, half)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Plan:
    """Of one source: its number, words, target, and its slots. Slot j takes the block at place j mod blocks of the
    permutation of pass j div blocks; the last slot takes `last` words of its block."""

    place: int
    source: str | None
    words: int
    target: float
    blocks: int
    slots: int
    last: int

    def seed(self, seed: int, turn: int) -> int:
        return seed * 1_000_003 + self.place * 97 + turn

    def block(self, slot: np.ndarray, seed: int) -> np.ndarray:
        out = np.empty(len(slot), np.int64)
        for turn in np.unique(slot // self.blocks):
            own = slot // self.blocks == turn
            out[own] = permuted(slot[own] % self.blocks, self.blocks, self.seed(seed, int(turn)))
        return out


def plan_source(place: int, source: str | None, words: int, target: float, size: int, seed: int) -> Plan:
    """Slots whose words add up to the target, rounded: all blocks are full but the source's last one, and the
    inverse permutation tells in which slot of a pass that one comes."""
    blocks = -(-words // size)
    plan = Plan(place, source, words, target, blocks, 0, 0)
    rest, short, turn = min(round(target), 2 * words), size * blocks - words, 0
    while rest > 0:
        at = int(permuted(np.array([blocks - 1]), blocks, plan.seed(seed, turn), back=True)[0])
        whole = min(rest, words)
        used = -(-whole // size) if whole <= at * size else max(at + 1, -(-(whole + short) // size))
        gone = used * size - (short if at < used else 0)
        plan.slots += used
        plan.last = (size - short if at == used - 1 else size) - (gone - whole)
        rest -= whole
        turn += 1
    return plan


def draw_shard(quota: np.ndarray, shard: int, shards: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of each source in a shard.

    The slots are split in halves again and again down to the shard. At each split the left half's counts are drawn
    from a multinomial over what is left of the sources' quotas, cut to these and filled up where there is room. Each
    shard finds its own counts in as many steps as the number of shards has bits, and all shards together use up
    every quota exactly.
    """
    low, high, first, left_over = 0, shards, np.zeros_like(quota), quota.copy()
    while high - low > 1:
        middle = (low + high) // 2
        room = (middle - low) * per_shard
        draw = np.random.default_rng([seed, low, high]).multinomial(room, left_over / left_over.sum())
        draw = np.minimum(draw, left_over)
        while (missing := room - int(draw.sum())) > 0:
            space = left_over - draw
            more = np.minimum(space, np.ceil(missing * (space / space.sum())).astype(np.int64))
            over = np.cumsum(more)
            draw += np.clip(missing - (over - more), 0, more)
        if shard < middle:
            high, left_over = middle, draw
        else:
            low, first, left_over = middle, first + draw, left_over - draw
    return first, left_over


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        # Bytes split at exactly the six blanks of BLANKS.
        sizes = [len(text.encode().split()) for text in batch["text"].to_pylist()]
        yield pa.record_batch(
            {"doc_id": batch["doc_id"], "source": batch["source"], "row": batch["row"], "size": pa.array(sizes, pa.int64())}
        )


def row_key(docs: DataFrame):
    """Rows with one key are alike in all that counts here; they differ by their place in their source."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")), docs["source"].cast("string"))


@dataclass
class Mix:
    """`docs`: (row, doc_id, source, size, place, start); `plans` by source; `slots`: (place, block, shard, slot, words,
    turn) of every slot that is used."""

    docs: DataFrame
    plans: list[Plan]
    slots: DataFrame
    block_words: int

    def spans(self) -> DataFrame:
        """(row, start, turn, shard, slot, first, n): which words of a document a slot takes. Blocks are joined by
        source and number with the documents that reach into them: no key has more rows than the documents in one
        block, however large its source."""
        size = self.block_words
        reach = F.expr(f"sequence(start div {size}, (start + size - 1) div {size})")
        own = self.docs.where("size > 0").select("row", "place", "start", "size", F.explode(reach).alias("block"))
        begin = F.greatest(F.col("start"), F.col("block") * size)
        end = F.least(F.col("start") + F.col("size"), F.col("block") * size + F.col("words"))
        # Spark judges the slots by the range of shards that they are made of; they grow with the input.
        found = own.join(self.slots.hint("merge"), ["place", "block"]).where(end > begin)
        first = (begin - F.col("start")).alias("first")
        return found.select("row", "start", "turn", "shard", "slot", first, (end - begin).alias("n"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
    block_words: int = 256, shard_slots: int = 4096, group_rows: int = 20_000, seed: int = 11,
) -> Mix:
    """Mix (doc_id, text, source) so that each source's words come to its target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at
    `limit` times its source's words. A source's documents are laid one after the other by hashed groups and doc_id and
    cut into blocks. No block is used more than twice.

    Null and empty texts have size 0 and are never taken; rows that repeat a doc_id are documents of their own; an
    empty table gives an empty mix. One row for each source comes to the driver. Running totals are made within groups
    of about `group_rows` documents and over the groups of a source, never over a source's documents in one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), row_key(docs).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = stored(rows.mapInArrow(_sizes, "doc_id long, source string, row long, size long"), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    share_of = [weights[i % len(weights)] for i in range(len(found))]
    targets = water_fill(share_of, [limit * r["words"] for r in found], share * sum(r["words"] for r in found))
    plans = [
        plan_source(i, r["source"], r["words"], t, block_words, seed) for i, (r, t) in enumerate(zip(found, targets))
    ]
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(p.place, p.source, p.words, float(p.target)) for p in plans],
        "place int, source string, source_size long, target double",
    )
    groups = max([r["n"] for r in found], default=0) // group_rows + 1
    named = rows.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    inside = Window.partitionBy("place", "part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = named.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = named.groupBy("place", "part").agg(F.sum("size").alias("held"))
    over = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("place", "part", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("base"))
    laid = laid.join(totals, ["place", "part"]).withColumn("start", F.col("base") + F.col("before"))
    laid = stored(
        laid.select("row", "doc_id", "source", "size", "place", "source_size", "target", "start"), "laid"
    )
    return Mix(laid, plans, _slots(spark, plans, block_words, shard_slots, seed), block_words)


def _slots(spark, plans: list[Plan], size: int, per_shard: int, seed: int) -> DataFrame:
    quota = np.array([p.slots for p in plans], np.int64)
    total = int(quota.sum())
    shards = -(-total // per_shard)
    # The last shard may be short: a source without words fills it up for the draw.
    padded = np.append(quota, shards * per_shard - total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_pylist():
                first, count = draw_shard(padded, shard, shards, per_shard, seed)
                order = np.random.default_rng([seed, shard]).permutation(int(count[:-1].sum()))
                at = 0
                for plan, start, n in zip(plans, first[:-1].tolist(), count[:-1].tolist()):
                    if not n:
                        continue
                    slot = np.arange(start, start + n)
                    words = np.where(slot == plan.slots - 1, plan.last, size)
                    yield pa.record_batch(
                        {
                            "place": np.full(n, plan.place, np.int32), "block": plan.block(slot, seed),
                            "shard": np.full(n, shard, np.int64), "slot": order[at : at + n].astype(np.int64),
                            "words": words.astype(np.int64), "turn": (slot // plan.blocks).astype(np.int32),
                        }
                    )
                    at += n

    return spark.range(shards).mapInArrow(run, "place int, block long, shard long, slot long, words long, turn int")


def taken(mixed: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    found = mixed.spans().groupBy("row", "start").agg(F.sum("n").alias("taken"))
    return mixed.docs.join(found, ["row", "start"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as documents: for each pass over its source a document comes with the words taken in that pass, in
    their order, all columns kept (`n_chars` follows the text). A document taken whole keeps its text as it is; of one
    cut by a block's end the taken stretches are joined by line ends. A document's list of stretches is no longer than
    the document."""
    spans = mixed.spans().groupBy("row", "start", "turn").agg(
        F.array_sort(F.collect_list(F.struct("first", "n"))).alias("__spans")
    )
    spans = spans.select(F.col("row").alias("__row"), "__spans")
    once = docs.withColumn("__row", row_key(docs)).dropDuplicates(["__row"])
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [
                stretches(text or "", [(s["first"], s["n"]) for s in spans])
                for text, spans in zip(batch["text"].to_pylist(), batch["__spans"].to_pylist())
            ]
            columns = {f.name: batch[f.name] for f in schema}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts]).cast(batch["n_chars"].type)
            yield pa.record_batch(columns)

    return once.join(spans, "__row").select(*docs.columns, "__spans").mapInArrow(cut, schema)


def stretches(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans, with the blanks between them; neighbouring spans are one."""
    joined: list[list[int]] = []
    for first, n in spans:
        if joined and joined[-1][1] >= first:
            joined[-1][1] = max(joined[-1][1], first + n)
        else:
            joined.append([first, first + n])
    words = [m.span() for m in WORD.finditer(text)]
    if joined == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)
