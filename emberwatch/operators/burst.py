"""N events within W seconds per key, starting over after each hit.

Sequential definition, per key in (time, line) order: keep the events no older than W seconds,
add the next one, and when N are held report them and start empty again.

A held set has exactly N events when it reports, so this is a selection over row ranks:

* a row is a *candidate* when it and the N-1 rows before it span at most W;
* candidates are taken greedily, each at least N ranks after the one taken before.

Neither a key nor a moment has to fit into a task. Rows are sorted by key, time and line over all
partitions and cut into chunks of a fixed number of rows. To find its candidates a chunk needs the
last N-1 rows before it. To know which of them are taken it needs one number, its *entry*: how many
of its leading rows cannot be hits, because the last hit before them is too near (0 to N-1). Greedy
selection makes a chunk a map from its entry to the entry of the next chunk, an array of N numbers.
Such maps compose, and composing is associative, so the entries come from a scan: neighbouring maps
are combined `FAN` at a time up a tree, and entries are handed down it. What meets in one row is a
chunk or `FAN` maps, whatever the data.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import stored

#: Rows of a chunk, and maps of neighbouring chunks that are combined at once.
CHUNK_ROWS, FAN = 4096, 64


def burst_windows(
    events: DataFrame,
    keys: list[str],
    threshold: int,
    window_seconds: int,
    last: list[str] = (),
    members: list[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per hit: the keys, `count`, `first_seen`, `last_seen`, `seq` of the last row,
    the `last` columns from the last row and the `members` columns as arrays over the N rows.

    `events` needs `ts` and `seq`; rows without a time or with a null key belong to no key. The
    columns in use are written once, in order; nothing else is read of `events`.
    """
    n, window = int(threshold), int(window_seconds) * 1_000_000
    rows = in_order(events, keys, [*last, *members])
    chunks = _chunks(rows, keys, n, window, chunk_rows)
    hits = _hits(chunks, entries(chunks.select(*keys, "nth", "exits"), keys), keys, n)
    return _described(rows, hits, keys, n, list(last), list(members))


def in_order(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows in the order of key, time and line, with `place`: the partition, and below it
    the row in the partition. Sorted by ranges, so a key with most rows is many partitions."""
    wanted = list(dict.fromkeys([*keys, "seq", *columns]))
    known = F.col("ts").isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    rows = events.filter(known).select(F.unix_micros("ts").alias("t"), *wanted)
    order = [*keys, "t", "seq"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("place", F.monotonically_increasing_id()), "burst-rows")


def _chunks(rows: DataFrame, keys: list[str], n: int, window: int, chunk_rows: int) -> DataFrame:
    """Stored chunks of up to `chunk_rows` rows of a key:

    nth: number of the chunk in its key; base: place of its first row; halo: places of the up to
    N-1 rows before it; times: of these and its own rows; runs: its candidates as [first, stop]
    ranks, the first row having rank 1; exits: the entry of the next chunk for each own entry.
    """
    chunk = F.floor(F.col("place") / F.lit(chunk_rows)).cast("bigint")
    own = F.array_sort(F.collect_list(F.struct("place", "t")))
    chunks = rows.select(*keys, "place", "t", chunk.alias("chunk")).groupBy(*keys, "chunk").agg(own.alias("own"))
    # Tails only: a key with most rows has them spread over its chunks, but its tails meet here.
    in_key = Window.partitionBy(*keys).orderBy("chunk")
    tail = F.slice("own", F.greatest(F.size("own") - (n - 2), F.lit(1)), n - 1)
    before = F.flatten(F.collect_list("tail").over(in_key.rowsBetween(-(n - 1), -1)))
    tails = chunks.select(*keys, "chunk", tail.alias("tail")).select(
        *keys,
        "chunk",
        (F.row_number().over(in_key) - 1).cast("bigint").alias("nth"),
        before.alias("before") if n > 1 else F.slice("tail", 1, 0).alias("before"),
    )
    halo = F.slice("before", F.greatest(F.size("before") - (n - 2), F.lit(1)), max(n - 1, 0))
    whole = chunks.join(tails, [*keys, "chunk"]).select(
        *keys, "nth", F.col("own")[0]["place"].alias("base"), halo.alias("halo"), "own"
    )
    timed = whole.select(
        *keys,
        "nth",
        "base",
        F.col("halo.place").alias("halo"),
        F.concat("halo.t", "own.t").alias("times"),
    )
    marked = timed.withColumn(
        "hot", F.expr(f"transform(times, (t, i) -> coalesce(t - get(times, i - {n - 1}) <= {window}L, false))")
    )
    edges = "filter(sequence({k}, size(times) - 1), i -> hot[i] and ({edge} or not hot[{beside}]))"
    ranks = "transform({edges}, i -> cast(i - size(halo) + 1 as bigint))"
    first = edges.format(k="size(halo)", edge="i = size(halo)", beside="i - 1")
    stop = edges.format(k="size(halo)", edge="i = size(times) - 1", beside="i + 1")
    runs = F.transform(
        F.arrays_zip(
            F.expr(ranks.format(edges=first)).alias("first"), F.expr(ranks.format(edges=stop)).alias("stop")
        ),
        lambda r: F.struct(r["first"].alias("first"), r["stop"].alias("stop")),
    )
    own_rows = F.size("times") - F.size("halo")
    exits = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda b: F.greatest(
            F.lit(0).cast("bigint"),
            F.aggregate(
                F.col("runs"), (b + 1).cast("bigint"), lambda nxt, run: _step(nxt, run, n).cast("bigint")
            )
            - 1
            - own_rows,
        ).cast("int"),
    )
    found = marked.withColumn("runs", runs).drop("hot")
    return stored(found, "burst-runs").withColumn("exits", exits)


def _step(next_rank: Column, run: Column, n: int) -> Column:
    """First rank free again after taking what a run offers."""
    first = F.greatest(run["first"], next_rank)
    taken = F.floor((run["stop"] - first) / F.lit(n)) + 1
    return F.when(first <= run["stop"], first + taken * n).otherwise(next_rank)


def entries(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth, entry) of stored (keys, nth, exits): each map applied after those before it in its key,
    the first one with entry 0. An up-sweep composes FAN neighbours at a time, the down-sweep hands
    each of them the entry that those before it lead to."""
    if not nodes.agg(F.max("nth")).first()[0]:
        return nodes.select(*keys, "nth", F.lit(0).alias("entry"))
    groups = stored(
        nodes.groupBy(*keys, F.floor(F.col("nth") / FAN).cast("bigint").alias("group")).agg(
            F.array_sort(F.collect_list(F.struct("nth", "exits"))).alias("links")
        ),
        "scan",
    )
    composed = F.transform(
        F.col("links")[0]["exits"],
        lambda e: F.aggregate(F.slice("links", 2, FAN), e, lambda entry, link: link["exits"][entry]),
    )
    above = entries(groups.select(*keys, F.col("group").alias("nth"), composed.alias("exits")), keys)
    start = F.struct(F.col("entry").alias("next"), F.expr("cast(array() as array<int>)").alias("had"))
    had = F.aggregate(
        "links",
        start,
        lambda state, link: F.struct(
            link["exits"][state["next"]].alias("next"), F.array_append(state["had"], state["next"]).alias("had")
        ),
        lambda state: state["had"],
    )
    handed = groups.join(above.withColumnRenamed("nth", "group"), [*keys, "group"]).select(
        *keys, F.explode(F.arrays_zip(F.col("links.nth").alias("nth"), had.alias("entry"))).alias("link")
    )
    return handed.select(*keys, "link.nth", "link.entry")


def _greedy(runs: Column, entry: Column, n: int) -> Column:
    """Ranks of the hits: from each run those from its first free rank on, n apart."""
    start = F.struct(
        (entry + 1).cast("bigint").alias("next"), F.expr("cast(array() as array<bigint>)").alias("ranks")
    )

    def take(state, run):
        first = F.greatest(run["first"], state["next"])
        ranks = F.sequence(first, run["stop"], F.lit(n).cast("bigint"))
        return F.struct(
            _step(state["next"], run, n).cast("bigint").alias("next"),
            F.when(first <= run["stop"], F.concat(state["ranks"], ranks)).otherwise(state["ranks"]).alias("ranks"),
        )

    return F.aggregate(runs, start, take, lambda s: s["ranks"])


def _hits(chunks: DataFrame, entered: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Stored (place, first_t, member_places) of every hit."""
    hot = chunks.drop("exits").filter(F.size("runs") > 0)
    ranked = hot.join(entered, [*keys, "nth"]).select(
        "base", "halo", "times", F.explode(_greedy(F.col("runs"), F.col("entry"), n)).alias("rank")
    )
    # Places in `times`, counted from 0: the hit's own row and the N-1 before it.
    at = F.col("rank").cast("int") - 1 + F.size("halo")
    place = f"transform(sequence(at - {n - 1}, at), i -> if(i < size(halo), get(halo, i), base + i - size(halo)))"
    found = ranked.withColumn("at", at).select(
        (F.col("base") + F.col("rank") - 1).alias("place"),
        F.get("times", F.col("at") - (n - 1)).alias("first_t"),
        F.expr(place).alias("member_places"),
    )
    return stored(found, "burst-hits")


def _described(rows, hits, keys, n, last, members) -> DataFrame:
    """The hits with the columns of their last rows and the members of their n rows."""
    wanted = list(dict.fromkeys([*keys, "place", "t", "seq", *last]))
    out = hits.select("place", "first_t").join(rows.select(*wanted), "place")
    if members:
        member = hits.select("place", F.posexplode("member_places").alias("nth", "its_place"))
        its = rows.select(F.col("place").alias("its_place"), F.struct(*members).alias("its"))
        lists = member.join(its, "its_place").groupBy("place").agg(
            F.array_sort(F.collect_list(F.struct("nth", "its"))).alias("its")
        )
        # A null of a member is left out, as in any list that is collected.
        lists = lists.select("place", *[F.array_compact(f"its.its.{m}").alias(f"{m}_members") for m in members])
        out = out.join(lists, "place")
    return out.select(
        *keys,
        F.lit(n).cast("bigint").alias("count"),
        F.timestamp_micros("first_t").alias("first_seen"),
        F.timestamp_micros("t").alias("last_seen"),
        "seq",
        *[c for c in last if c not in [*keys, "seq"]],
        *[f"{m}_members" for m in members],
    )
