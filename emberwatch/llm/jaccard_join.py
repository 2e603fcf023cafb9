"""N-gram Jaccard self-join of whole documents by PartEnum signatures.

Sets of word shingles in one band of sizes differ in at most k elements when they are similar enough. The domain of
shingles is partitioned (by hash) into groups, each group into three parts, and for every two parts of a group the
elements in them make a signature. With (k + 1) / 1.5 groups some group has at most one differing element, which lies
in one part; the signature of the other two parts is then the same in both sets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import components, drop, joined_components, portions, stored

#: Every so many sets one is looked at to find shingles that many sets share, which say little: those found in at least
#: COMMON of the sampled sets, the MOST_COMMON most frequent. Signatures are made of the other shingles. Any choice gives
#: the same links; this one keeps documents apart that share a passage and no more.
SAMPLED, COMMON, MOST_COMMON = 16, 3, 250_000
#: Sets of a signature that are drawn to be compared with its others, before all that are still apart are compared.
CENTRES = 4
#: Sets in a block when whole families are compared.
BLOCK = 400
#: Sets of up to SMALL shingles are joined by their rarest shingles instead: partitions of a small set are mostly empty,
#: and an empty partition is a signature that unlike sets share. Pairs of which the smaller set has more than
#: SMALL * threshold shingles are also found by signatures. The same goes for sets with many common shingles.
SMALL = 128
#: Groups whose signatures are used; large sets have more. Two documents right at the threshold agree in each group
#: with a probability of about 0.65, in none of 24 with 1e-11, so a pair may miss there in principle.
GROUPS = 24

_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: Words that are hashed at a time; a longer text is taken in overlapping stretches.
_STRETCH = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
            for base in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _POWERS[0], _POWERS[1]


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of n words, lowered in A-Z; of all words if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = []
    for at in range(0, max(len(words) - n + 1, 1), _STRETCH):
        some = words[at : at + _STRETCH + n - 1]
        # The hash of a stretch of bytes is a difference of running sums, moved back to place 0.
        data = np.frombuffer(b" ".join(some), np.uint8)
        up, down = _powers(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: len(data)])])
        ends = np.append(np.flatnonzero(data == 32), len(data))
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = min(n, len(some))
        first, last = starts[: len(some) - size + 1], ends[size - 1 :]
        found.append(mixed((total[last] - total[first]) * down[first]))
    return np.unique(np.concatenate(found))


def set_key(elements: np.ndarray) -> int:
    """One number for a set, as a signed 64-bit integer."""
    total = mixed(elements + np.uint64(len(elements))).sum(dtype=np.uint64)
    return int(mixed(np.array([total]))[0].astype(np.int64))


def bands(percent: int, largest: int) -> list[int]:
    """Upper sizes of the bands from SMALL * threshold on; similar sets lie in one band or in neighbouring ones."""
    low, out = SMALL * percent // 100 + 1, []
    while not out or out[-1] < largest:
        low = low * 100 // percent + 1
        out.append(low - 1)
    return out


def rare(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The elements that are not in the sorted array `common`."""
    if not len(common):
        return elements
    at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    return elements[common[at] != elements]


def signatures(elements: np.ndarray, n: int, percent: int, groups: int | None = GROUPS) -> np.ndarray:
    """Signatures of the rare elements of a set of n, in the set's own band and the next one up. Sets below the first
    band have none, nor those that are rare in less than half."""
    if n <= SMALL * percent // 100 or 2 * len(elements) < n:
        return np.zeros(0, np.int64)
    out = []
    ends = bands(percent, n)
    for band in (len(ends) - 1, len(ends)):
        top = ends[band] if band < len(ends) else (ends[-1] + 1) * 100 // percent
        differ = 2 * top * (100 - percent) // (100 + percent)
        count = -(-(differ + 1) * 2 // 3)
        used = count if groups is None else min(count, groups)
        place = mixed(elements ^ np.uint64(band * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        group = ((place >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        mine = group < used
        part = (group[mine] * np.uint64(3) + (place[mine] & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
        total, filled = np.zeros(3 * used, np.uint64), np.bincount(part, minlength=3 * used).reshape(-1, 3)
        np.add.at(total, part, mixed(place[mine] + np.uint64(1)))
        total = total.reshape(-1, 3)
        for left, right in ((0, 1), (0, 2), (1, 2)):
            name = np.arange(used, dtype=np.uint64) * np.uint64(1009) + np.uint64(band * 1_000_003 + left * 3 + right)
            own = mixed(mixed(total[:, left] + name) * np.uint64(3) + total[:, right])
            out.append(own[filled[:, left] + filled[:, right] > 0])
    return np.concatenate(out).astype(np.int64)


def jaccard_components(docs: DataFrame, percent: int = 75, n: int = 5, groups: int | None = GROUPS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * common shingles >= percent * all shingles; component_id is the smallest doc_id reachable.
    Null and empty texts have no shingles and link with nothing. Equal sets are one node from the start, so copies
    meet in no join. Rows that repeat a doc_id are documents with one name. Columns besides doc_id and text are not
    read. Shingles are compared by 64-bit hashes.

    Every signature's sets are linked to its smallest set and these pairs verified: rows in proportion to the sets,
    not to the square of a group. Where sets of one signature are then still in different components, they are compared
    with a few drawn sets of the signature; those that are apart even then are compared whole, in blocks, so that no
    link is lost that could join two components.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = [shingles(text, n) for text in batch["text"].to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    "sample": pa.array(
                        [s.astype(np.int64) if len(s) and set_key(s) % SAMPLED == 0 else None for s in sets],
                        pa.list_(pa.int64()),
                    ),
                }
            )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 200):
                sets = [shingles(text, n) for text in texts[at : at + 200]]
                found = [signatures(rare(s, common), len(s), percent, groups) for s in sets]
                nodes = [set_key(s) if len(s) else 0 for s in sets]
                yield pa.record_batch(
                    {"sig": np.concatenate(found), "node": np.repeat(np.array(nodes, np.int64), [len(f) for f in found])}
                )

    def small_or_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A set that is rare in less than half is similar to none that is rare in more than four fifths.
        for batch in portions(batches):
            sets = (shingles(text, n) for text in batch["text"].to_pylist())
            found = [s for s in sets if 0 < len(s) <= SMALL or 5 * len(rare(s, common)) < 4 * len(s)]
            yield pa.record_batch(
                {
                    "node": pa.array([set_key(s) for s in found], pa.int64()),
                    "elements": pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64())),
                }
            )

    nodes = stored(rows.mapInArrow(keys, "doc_id long, n_shingles long, node long, sample array<long>"), "nodes")
    common = _common(nodes)
    large = stored(rows.mapInArrow(signed, "sig long, node long"), "signatures")
    others = stored(rows.mapInArrow(small_or_common, "node long, elements array<long>"), "others")
    sigs = large.unionByName(_prefixes(others, percent))
    shared = sigs.groupBy("sig").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    shared = stored(shared.select("sig", "first"), "shared")
    members = stored(sigs.join(shared, "sig").distinct(), "members")
    star = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = stored(star, "pairs")
    links = verified(rows, nodes, star, percent, n)
    groups_of = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    apart = _apart(members, groups_of)
    if not apart.isEmpty():
        more = verified(rows, nodes, _drawn_pairs(apart, star), percent, n)
        if not more.isEmpty():
            groups_of = joined_components(groups_of, more.select(F.col("a").alias("u"), F.col("b").alias("v")))
            apart = _apart(members, groups_of)
        if not apart.isEmpty():
            more = _compared(rows, nodes, apart, percent, n)
            groups_of = joined_components(groups_of, more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    drop(large, others, shared, members)
    own = _named(nodes, groups_of)
    least = stored(own.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least")), "least")
    return own.join(least, "part", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )


def _named(nodes: DataFrame, groups_of: DataFrame) -> DataFrame:
    """The documents with the part they belong to: the component of their set, or the set alone."""
    return stored(
        nodes.join(groups_of, "node", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "node").alias("part")
        ),
        "parts",
    )


def _common(nodes: DataFrame) -> np.ndarray:
    """Sorted shingles that many of the sampled sets have; at most MOST_COMMON numbers come to the driver."""
    sets = nodes.where("sample is not null").groupBy("node").agg(F.first("sample").alias("sample"))
    often = sets.select(F.explode("sample").alias("e")).groupBy("e").agg(F.count("*").alias("often"))
    found = often.where(F.col("often") >= COMMON).orderBy(F.desc("often"), "e").limit(MOST_COMMON).select("e").toArrow()
    return np.sort(found["e"].to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node): of each set its rarest shingles, as many as a similar set cannot all lack. The rarest come first so
    that a passage that many share does not bring all its documents together."""
    sets = sets.groupBy("node").agg(F.first("elements").alias("elements"))
    spread = stored(sets.select("node", F.size("elements").alias("n"), F.explode("elements").alias("e")), "elements")
    often = stored(spread.groupBy("e").agg(F.count("*").alias("often")).where("often > 1"), "often")
    # Shingles of a single set can be in no other's prefix and need no rank among themselves.
    ranked = spread.join(often, "e").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("often", "e"))).alias("own")
    )
    # The prefix holds the shingles of this set alone first; what is left of it goes to shared ones, rarest first.
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1 - (n - size(own))")
    chosen = ranked.where(prefix > 0).select("node", F.explode(F.slice("own", 1, prefix.cast("int"))).alias("x"))
    return chosen.select(F.xxhash64("x.e").alias("sig"), "node")


def _bitmap(ids: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A fixed-size filter (1 MB) of the ids: however many there are, at most bits / 64 words come to the driver."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.expr("doc_id"), place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")
    )
    out = np.zeros(bits // 64, np.int64)
    for row in words.toLocalIterator():
        out[row["w"]] = row["b"]
    return out.view(np.uint64)


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id): one document for each wanted node; and (doc_id, node, elements): the sets of these documents,
    with some others' that the joins by doc_id and node drop.

    A fixed-size filter of the ids lets the other texts go before they are cut into shingles.
    """
    chosen = nodes.select("doc_id", "node").join(wanted, "node", "left_semi")
    chosen = stored(chosen.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "chosen")
    bitmap = _bitmap(chosen)
    bits = len(bitmap) * 64

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch["p"].to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bitmap[p // 64] >> (p % 64).astype(np.uint64)) & np.uint64(1)).tolist()
            for at in range(0, len(hit), 200):
                some = pa.array(hit[at : at + 200], pa.int64())
                found = [shingles(text, n) for text in batch["text"].take(some).to_pylist()]
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].take(some),
                        "node": pa.array([set_key(s) if len(s) else None for s in found], pa.int64()),
                        "elements": pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64())),
                    }
                )

    marked = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p"), "text")
    return chosen, marked.mapInArrow(sets, "doc_id long, node long, elements array<long>")


def verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen, found = _sets(rows, nodes, wanted, n)
    left = found.select(F.col("doc_id").alias("p"), F.col("node").alias("a"), F.col("elements").alias("x"))
    right = found.select(F.col("doc_id").alias("q"), F.col("node").alias("b"), F.col("elements").alias("y"))
    of_a = chosen.select(F.col("node").alias("a"), F.col("doc_id").alias("da"))
    of_b = chosen.select(F.col("node").alias("b"), F.col("doc_id").alias("db"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, keep = batch["x"], batch["y"], []
            for i in range(len(batch)):
                one, two = x[i].values.to_numpy(), y[i].values.to_numpy()
                small, big = (one, two) if len(one) <= len(two) else (two, one)
                if 100 * len(small) < percent * len(big):
                    continue
                common = len(np.intersect1d(small, big, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    named = pairs.join(of_a, "a").join(of_b, "b")
    close = named.join(right, (F.col("db").eqNullSafe(F.col("q"))) & (named["b"] == right["b"])).drop(right["b"])
    close = close.join(left, (F.col("da").eqNullSafe(F.col("p"))) & (close["a"] == left["a"])).drop(left["a"])
    close = close.select("a", "b", "x", "y")
    return stored(close.mapInArrow(similar, "a long, b long").distinct(), "links")


def _apart(members: DataFrame, groups_of: DataFrame) -> DataFrame:
    """(sig, node, part) of the signatures whose sets are in different components so far."""
    named = members.join(groups_of, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    named = stored(named, "named")
    split = named.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("sig")
    found = stored(named.join(split, "sig"), "apart")
    drop(named)
    return found


def _drawn_pairs(apart: DataFrame, tested: DataFrame) -> DataFrame:
    """Each set with CENTRES sets drawn for its signature, where they are in different components."""
    draws = [F.xxhash64("node", F.lit(i)) for i in range(CENTRES)]
    drawn = apart.groupBy("sig").agg(
        *[F.min_by("node", d).alias(f"n{i}") for i, d in enumerate(draws)],
        *[F.min_by("part", d).alias(f"p{i}") for i, d in enumerate(draws)],
    )
    each = F.array(*[F.struct(F.col(f"n{i}").alias("b"), F.col(f"p{i}").alias("other")) for i in range(CENTRES)])
    right = stored(drawn.select("sig", F.inline(F.array_distinct(each))), "centres")
    pairs = apart.withColumnRenamed("node", "a").join(right, "sig").where("part <> other")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(pairs.join(tested, ["a", "b"], "left_anti"), "drawn")


def _compared(rows: DataFrame, nodes: DataFrame, apart: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join components, from comparing whole families in blocks.

    A family is what signatures that are still apart hold together. Its sets outside its largest component are
    compared with all its sets: both are cut into blocks, a pair of blocks is one group, and a group gives at most a
    row for each set. The work is that of the few left over times the family, and no pair of sets is a row.
    """
    first = apart.groupBy("sig").agg(F.min("node").alias("u"))
    families = components(apart.join(stored(first, "first"), "sig").select("u", F.col("node").alias("v")))
    parts = apart.select("node", "part").distinct().join(families.withColumnRenamed("component", "family"), "node")
    parts = stored(parts, "families")
    sizes = parts.groupBy("family", "part").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("family").agg(F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by("part", "size").alias("main"))
    sizes = stored(
        sizes.select("family", "main", F.expr(f"`all` div {BLOCK} + 1").alias("n_all"), F.expr(f"(`all` - most) div {BLOCK} + 1").alias("n_left")),
        "sizes",
    )
    chosen, found = _sets(rows, nodes, parts.select("node").distinct(), n)
    own = parts.join(sizes, "family").join(chosen, "node").withColumn("h", F.xxhash64("node"))
    every = own.select(
        "family", "node", "part", "doc_id", F.lit(False).alias("asks"), F.pmod("h", "n_all").alias("y"),
        F.explode(F.expr("sequence(0L, n_left - 1)")).alias("x"),
    )
    asking = own.where("part <> main").select(
        "family", "node", "part", "doc_id", F.lit(True).alias("asks"), F.pmod("h", "n_left").alias("x"),
        F.explode(F.expr("sequence(0L, n_all - 1)")).alias("y"),
    )
    placed = every.unionByName(asking)
    sets = found.select(F.col("doc_id").alias("d"), F.col("node").alias("k"), "elements")
    placed = placed.join(sets, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("k")))
    placed = placed.select("family", "x", "y", "asks", "node", "part", "elements").distinct()

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        node, part = table["node"].to_numpy(), table["part"].to_numpy()
        sets = [x.values.to_numpy() for x in table["elements"]]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(s) for s in sets])
        union = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (part[left][:, None] != part[right][None, :]))
        # One link for each set and component it reaches says as much as all.
        pairs = {(a, p): b for a, b, p in zip(node[left[i]].tolist(), node[right[j]].tolist(), part[right[j]].tolist())}
        a, b = [k[0] for k in pairs], list(pairs.values())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(placed.groupBy("family", "x", "y").applyInArrow(compare, "a long, b long").distinct(), "links")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set has in common with each right set, by products of 0/1 matrices over the
    elements that both sides have, a few thousand at a time."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        out += _incidence(left, some) @ _incidence(right, some).T
    return np.rint(out).astype(np.int64)


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == s]] = 1
    return out
