"""Near-duplicate vectors by randomised-rotation binary codes with confidence bounds.

A vector is rotated at random and each coordinate kept as its sign. The sign vector x of a unit vector o, scaled to
length one, is stored with its correction factor f = <x, o>; <x, q> / f is then an unbiased estimate of <o, q> whose
error for a random rotation stays within bound * sqrt((1 - f * f) / (f * f) / (bits - 1)) with a probability that the
bound sets. Pairs whose estimate plus error is below the threshold are let go; the others are computed again exactly.
Stretches of the same codes are the tables in which candidates meet.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import components, stored

#: Rows of a table's bucket that one task compares at a time; larger buckets are cut into blocks of this size.
BLOCK = 1_000


@dataclass
class Codes:
    """The layout of the codes: `tables` stretches of `width` bits, the first `bits` of all bits for the estimate."""

    dim: int
    width: int
    tables: int
    bits: int
    seed: int = 3

    def rotations(self) -> np.ndarray:
        """(coordinates x code bits): random orthogonal matrices side by side, enough for all tables and `bits`."""
        draw, out = np.random.default_rng([self.seed, self.dim]), []
        while sum(m.shape[1] for m in out) < max(self.width * self.tables, self.bits):
            q, r = np.linalg.qr(draw.standard_normal((self.dim, self.dim)))
            out.append(q * np.sign(np.diag(r)))
        return np.concatenate(out, axis=1)


def layout(n: int, dim: int, threshold: float, recall: float, bits: int) -> Codes:
    """Buckets hold about 64 of n unrelated vectors; there are as many tables as make two vectors right at the
    threshold meet with probability `recall`. Two signs agree with a probability of 1 - angle / pi."""
    width = min(60, max(4, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return Codes(dim, width, math.ceil(math.log(1 - recall) / math.log(1 - same)), bits)


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    raw = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaled first, so that squares of very large or small numbers stay in range.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def encode(vectors: DataFrame, codes: Codes) -> DataFrame:
    """The index of (rep, weight, vector) rows: bands (one bucket number for each table), code (packed signs) and
    factor (the code's correction)."""
    turn = codes.rotations()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signs = []
            factor = []
            own = unit(batch["vector"], codes.dim)
            # Row by row, so that a vector's signs do not depend on the rows that come with it.
            for o in own:
                turned = o @ turn
                signs.append(turned >= 0)
                part = turned[: codes.bits] * math.sqrt(codes.dim / codes.bits)
                factor.append(np.abs(part).sum() / math.sqrt(codes.bits))
            signs = np.array(signs)
            bands = signs[:, : codes.width * codes.tables].reshape(len(own), codes.tables, codes.width)
            numbers = (bands.astype(np.int64) << np.arange(codes.width)).sum(axis=2)
            code = np.packbits(signs[:, : codes.bits], axis=1)
            yield pa.record_batch(
                {
                    "rep": batch["rep"], "weight": batch["weight"], "vector": batch["vector"],
                    "bands": pa.array(list(numbers), pa.list_(pa.int64())),
                    "code": pa.array([c.tobytes() for c in code], pa.binary()),
                    "factor": pa.array(factor, pa.float64()),
                }
            )

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(
        run, f"rep long, weight long, vector {kind}, bands array<long>, code binary, factor double"
    )


class Block:
    """Rows of one bucket, unpacked."""

    def __init__(self, table: pa.Table, codes: Codes):
        self.rep, self.weight = table["rep"].to_numpy(), table["weight"].to_numpy()
        self.unit = unit(table["vector"].combine_chunks(), codes.dim)
        self.turned = (self.unit @ codes.rotations()[:, : codes.bits]) * math.sqrt(codes.dim / codes.bits)
        packed = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(self.rep), -1)
        signs = np.unpackbits(packed, axis=1, count=codes.bits).astype(np.float64) * 2 - 1
        self.code = signs / math.sqrt(codes.bits)
        self.factor = table["factor"].to_numpy()
        self.bands = table["bands"].combine_chunks().values.to_numpy().reshape(len(self.rep), -1)


def close(one: Block, two: Block, threshold: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with a cosine of at least the threshold."""
    estimate = (two.turned @ one.code.T).T / one.factor[:, None]
    bits = one.code.shape[1]
    error = bound * np.sqrt(np.maximum(1 - one.factor**2, 0) / one.factor**2 / (bits - 1))
    i, j = np.nonzero(estimate + error[:, None] >= threshold)
    # Pair by pair and not as a product of blocks, so that a pair's cosine is the same number in every bucket.
    exact = np.einsum("ij,ij->i", one.unit[i], two.unit[j])
    keep = exact >= threshold
    return i[keep], j[keep]


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, bits: int = 128, bound: float = 4.5
) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link with a cosine of at least `threshold`, computed in double precision; labels are not looked at. A
    vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do vectors of
    different lengths with each other; the same holds for a null vec_id. n_links counts other vec_ids with a linked
    vector, component_id is the smallest vec_id reachable. Rows that repeat a vec_id and its vector are one vector.

    Equal vectors are one entry from the start, whatever their number, and count with their weight. A large bucket is
    cut into blocks, and each pair of blocks is one group. A pair is counted in the first table where it meets;
    each block gives its links as one row for a vector and not as pairs. The number of tables grows slowly with the
    number of vectors (by a power of about 0.2), so that buckets do not grow.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    sound = F.coalesce(
        (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    keyed = stored(
        rows.select(
            "vec_id", sound.alias("sound"), F.size("vector").alias("dim"),
            F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"),
        ),
        "vectors",
    )
    entries = keyed.where("sound").groupBy("h1", "h2", "dim").agg(
        F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")
    )
    entries = stored(entries, "entries")
    sizes = {r["dim"]: r["n"] for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(sizes.items()):
        part = _found(rows, entries.where(F.col("dim") == dim), layout(n, dim, threshold, recall, bits), threshold, bound)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    found = stored(found, "links")
    named = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = named.withColumnRenamed("node", "rep")
    entries = entries.join(counts, "rep", "left").join(named, "rep", "left").select(
        "h1", "h2", "dim", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"), F.lit(True).alias("sound"),
    )
    entries = stored(entries, "found")
    return keyed.join(entries, ["h1", "h2", "dim", "sound"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _found(rows: DataFrame, entries: DataFrame, codes: Codes, threshold: float, bound: float) -> DataFrame:
    """(rep, links, root) of the entries of one dimension, a row for each vector with links in a group of blocks."""
    hashed = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    chosen = hashed.join(entries.withColumnRenamed("rep", "vec_id"), ["vec_id", "h1", "h2"])
    chosen = chosen.dropDuplicates(["vec_id", "h1", "h2"])
    index = stored(encode(chosen.select(F.col("vec_id").alias("rep"), "weight", "vector"), codes), "index")
    placed = index.select("rep", F.posexplode("bands").alias("table", "bucket"))
    held = placed.groupBy("table", "bucket").agg(F.count("*").alias("held")).where("held > 1")
    held = stored(held.withColumn("blocks", F.expr(f"(held + {BLOCK - 1}) div {BLOCK}")), "buckets")
    spread = index.select("*", F.posexplode("bands").alias("table", "bucket")).join(held, ["table", "bucket"])
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    groups = spread.select(
        "table", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "rep", "weight", "vector", "bands", "code", "factor",
    )

    def compare(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        at = table["table"][0].as_py()
        one = Block(table.filter(pa.array(own == lo)), codes)
        two = one if lo == hi else Block(table.filter(pa.array(own == hi)), codes)
        if not len(one.rep) or not len(two.rep):
            return _links([], [], [])
        links, roots, reps = [], [], np.concatenate([one.rep, two.rep])
        i, j = close(one, two, threshold, bound)
        if lo == hi:
            upper = i < j
            i, j = i[upper], j[upper]
        new = np.ones(len(i), bool)
        for earlier in range(at):
            new &= one.bands[i, earlier] != two.bands[j, earlier]
        shift = len(one.rep)
        count = np.bincount(i[new], two.weight[j[new]], len(reps)) + np.bincount(j[new] + shift, one.weight[i[new]], len(reps))
        # Places in the order of the ids, so that the least place reached is the least id.
        ids, place = np.unique(reps, return_inverse=True)
        label = least_reachable(len(ids), place[i], place[j + shift])
        total = np.bincount(place, count, len(ids)).astype(np.int64)
        keep = (total > 0) | (label != np.arange(len(ids)))
        return _links(ids[keep], total[keep], ids[label[keep]])

    return groups.groupBy("table", "bucket", "lo", "hi").applyInArrow(compare, "rep long, links long, root long")


def _links(rep, links, root) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int64()) for k, v in (("rep", rep), ("links", links), ("root", root))})
