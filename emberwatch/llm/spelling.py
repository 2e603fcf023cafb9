"""Spelling variants: words one edit apart, found in a trie of letter counts.

A word's frequency vector counts its letters, one after the other of `LETTERS`, then all others together. One inserted,
deleted or replaced character raises at most one count by one (surplus) and lowers at most one by one (deficit). A trie
holds words by the successive counts; a search for a word goes down it depth first and at each level takes the word's
own count, or spends the surplus or the deficit. Words in the leaves that it reaches are verified.

The upper levels of the trie are Spark's partitioning. A bucket is a node with at most `BUCKET` words: the first of the
depths in `DEPTHS` at which no more words share their counts. A word visits the buckets that it can reach with its
budget, and the lower levels are built and searched where the bucket is. Of two words in different buckets only one
visits the other: the one whose bucket is less deep, else the one whose first differing count is smaller. So a bucket
is visited from its neighbours of at most `BUCKET` words each, however many words a region of the trie holds.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import UPPER, stored

#: Letters by how often European languages use them; the levels of the trie.
LETTERS = "etaionsrlhducmpgfwybvkxjqz"
#: Levels of the trie at which buckets are cut; the last is the whole vector.
DEPTHS = (3, 6, 10, len(LETTERS) + 1)
#: Words of a bucket, and words that a node of its trie holds without a further level.
BUCKET, LEAF = 20_000, 6
#: Pairs that leave a task at once.
PAIRS = 20_000


def counted_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters in whole texts, those that occur at least `least_count` times.

    Where `damage` divides the CRC-32 h of `<doc_id>:<run>`, the run's character h % length is left out first. A null
    doc_id reads as empty in that key; a null or empty text has no words.
    """
    lowered = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(lowered, F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"),
    ).where(F.length("run") >= least_length)
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least_count)


# --- the trie of one bucket -----------------------------------------------------------------------------------------


def vector(word: str) -> list[int]:
    own = [word.count(letter) for letter in LETTERS]
    return [*own, len(word) - sum(own)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Leaf:
    """Words of a node without a further level. Many words with equal counts have one length; one edit leaves the
    first or the last half of a word as it is, so they are looked up by either."""

    def __init__(self, words: list[str]):
        self.words, self.halves = words, None
        if len(words) > LEAF:
            self.half, self.halves = (len(words[0]) - 1) // 2, {}
            for word in words:
                for key in (word[: self.half], None), (None, word[-self.half :]):
                    self.halves.setdefault(key, []).append(word)

    def near(self, word: str) -> Iterator[str]:
        found = self.words
        if self.halves is not None:
            front, back = (word[: self.half], None), (None, word[-self.half :])
            found = {*self.halves.get(front, ()), *self.halves.get(back, ())}
        return (other for other in found if one_edit(word, other))


class Trie:
    def __init__(self, words: list[str]):
        self.root = self._node([(vector(word), word) for word in words], 0)

    def _node(self, words: list[tuple[list[int], str]], level: int) -> "_Leaf | dict":
        if len(words) <= LEAF or level > len(LETTERS):
            return _Leaf([word for _, word in words])
        children: dict[int, list] = {}
        for entry in words:
            children.setdefault(entry[0][level], []).append(entry)
        return {count: self._node(own, level + 1) for count, own in children.items()}

    def near(self, word: str) -> Iterator[str]:
        own, todo = vector(word), [(self.root, 0, 1, 1)]
        while todo:
            node, level, surplus, deficit = todo.pop()
            if type(node) is _Leaf:
                yield from node.near(word)
                continue
            count = own[level]
            if count in node:
                todo.append((node[count], level + 1, surplus, deficit))
            if surplus and count + 1 in node:
                todo.append((node[count + 1], level + 1, 0, deficit))
            if deficit and count - 1 in node:
                todo.append((node[count - 1], level + 1, surplus, 0))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words of rows (path, visits, word, n) that are sorted: a bucket's own words, then its visitors."""
    path, homes, trie, out = None, {}, None, []

    def pairs(of: dict[str, int], back: bool) -> Iterator[tuple[str, str, int]]:
        for word, n in of.items():
            for other in trie.near(word):
                yield word, other, homes[other]
                if back:
                    yield other, word, n

    for batch in batches:
        for key, visits, word, n in zip(*(batch[c].to_pylist() for c in ("path", "visits", "word", "n"))):
            if key != path:
                if homes and trie is None:
                    trie = Trie(list(homes))
                    out += pairs(homes, False)
                path, homes, trie = key, {}, None
            if not visits:
                homes[word] = n
            elif homes:
                if trie is None:
                    trie = Trie(list(homes))
                    out += pairs(homes, False)
                out += pairs({word: n}, True)
            while len(out) >= PAIRS:
                yield _batch(out[:PAIRS])
                out = out[PAIRS:]
    if homes and trie is None:
        trie = Trie(list(homes))
        out += pairs(homes, False)
    for at in range(0, len(out), PAIRS):
        yield _batch(out[at : at + PAIRS])


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])


# --- buckets --------------------------------------------------------------------------------------------------------


def _counts(word: Column) -> Column:
    own = [(F.length(word) - F.length(F.translate(word, x, ""))) for x in LETTERS]
    rest = F.length(F.translate(word, LETTERS, ""))
    return F.array(*own, rest)


def _changes(levels: int) -> list[tuple[list[int], int, int, int]]:
    """(change of each count, surplus, deficit, sign of the first change) with a budget of one each."""
    out = [([0] * levels, 0, 0, 0)]
    for up in [None, *range(levels)]:
        for down in [None, *range(levels)]:
            if up != down:
                change = [(i == up) - (i == down) for i in range(levels)]
                out.append((change, int(up is not None), int(down is not None), next(x for x in change if x)))
    return out


def _options(levels: int) -> Column:
    """`_changes` as an array that rows are multiplied by."""
    return F.array(
        *[
            F.struct(
                F.array(*map(F.lit, by)).alias("by"),
                *[F.lit(x).alias(name) for x, name in zip((up, down, first), ("up", "down", "first"))],
            )
            for by, up, down, first in _changes(levels)
        ]
    )


def _visits(words: DataFrame, bucket: int) -> DataFrame:
    """(path, visits, word, n): every word in its own bucket and in those that it visits."""
    nowhere = F.lit(None).cast("int").alias("home")
    rows = stored(words.select("word", "n", _counts(F.col("word")).alias("counts"), nowhere), "words")
    full = []
    for i, depth in enumerate(DEPTHS):
        path = F.concat_ws(",", F.slice("counts", 1, depth))
        over = rows.where("home is null").groupBy(path.alias("path")).agg(F.count("*").alias("n"))
        limit = bucket if i + 1 < len(DEPTHS) else 1 << 62
        full.append(stored(over.where(F.col("n") > limit).select("path", F.lit(True).alias("full")), "full"))
        is_home = F.when(F.col("full").isNull(), F.lit(i))
        rows = rows.withColumn("path", path).join(full[-1], "path", "left")
        rows = rows.withColumn("home", F.coalesce("home", is_home)).drop("path", "full")
        if full[-1].isEmpty():
            break

    found, before = [], 0
    rows = rows.select("*", F.lit("").alias("path"), *[F.lit(0).alias(c) for c in ("surplus", "deficit", "sign")])
    for i, over in enumerate(full):
        levels = DEPTHS[i] - before
        rows = rows.withColumn("change", F.explode(_options(levels)))
        rows = rows.where("surplus + change.up <= 1 and deficit + change.down <= 1")
        own = F.slice("counts", before + 1, levels)
        reached = F.transform(F.arrays_zip(own.alias("a"), F.col("change.by").alias("b")), lambda x: x["a"] + x["b"])
        rows = rows.withColumn("reached", reached).where(F.array_min("reached") >= 0)
        rows = rows.select(
            "word", "n", "counts", "home",
            F.concat_ws(",", F.nullif("path", F.lit("")), F.col("reached").cast("array<string>")).alias("path"),
            (F.col("surplus") + F.col("change.up")).alias("surplus"),
            (F.col("deficit") + F.col("change.down")).alias("deficit"),
            F.when(F.col("sign") != 0, F.col("sign")).otherwise(F.col("change.first")).alias("sign"),
        )
        here = rows.join(over, "path", "left_anti")
        here = here.where((F.col("sign") == 0) | (F.col("home") < i) | ((F.col("home") == i) & (F.col("sign") > 0)))
        found.append(here.select("path", (F.col("sign") != 0).alias("visits"), "word", "n"))
        rows, before = rows.join(over, "path", "left_semi"), DEPTHS[i]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, near, near_n) for every two words that are one edit apart, in both directions. `words` are distinct
    rows (word, n)."""
    rows = _visits(words, bucket).repartition("path").sortWithinPartitions("path", "visits")
    return rows.mapInArrow(_search, "word string, near string, near_n bigint")


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """One row per word: its form (the near word of largest n, then smallest, if that n is `times` the word's), the
    root that following forms leads to, n, n_near and form_n. A word without near words has n_near 0 and is its own
    root. Each step of a chain of forms has `times` the n of the one before, so doubling ends after a few rounds."""
    words = stored(words.select("word", "n"), "counted")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    fits = -F.col("best.less") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "variants")
    steps = stored(found.where("form is not null").select("word", F.col("form").alias("to")), "forms")
    while True:
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("onward"))
        further = stored(steps.join(on, "to", "left").select("word", "to", "onward"), "forms")
        if further.where("onward is not null").isEmpty():
            break
        steps = stored(further.select("word", F.coalesce("onward", "to").alias("to")), "forms")
    roots = steps.select("word", F.col("to").alias("root"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
