import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from emberwatch.llm import bpe
from emberwatch.llm.common import components, joined_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def found(table):
    rows = table.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(5)
    sparse = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    cases = [
        [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 60)], [(99, i) for i in range(40)],
        [e for e in sparse if e[0] != e[1]],
    ]
    for edges in cases:
        assert found(components(spark.createDataFrame(edges, "u long, v long"))) == brute(edges)


def test_later_edges_join_components(spark):
    rng = random.Random(7)
    pairs = lambda n: [e for e in ((rng.randrange(200), rng.randrange(200)) for _ in range(n)) if e[0] != e[1]]
    first, later = pairs(90), pairs(60)
    schema = "u long, v long"
    before = components(spark.createDataFrame(first, schema))
    assert found(joined_components(before, spark.createDataFrame(later, schema))) == brute(first + later)
    assert found(joined_components(before, spark.createDataFrame([], schema))) == brute(first)
    none = components(spark.createDataFrame([], schema))
    assert found(joined_components(none, spark.createDataFrame(later, schema))) == brute(later)


def test_ids_beside_their_digests(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = docs("one two  three", "", None, "one two  three\n", "naïve \U0001f600 " * 50)
    rows = {r.doc_id: r for r in bpe.digest(table, path, public_tokenizers.PATTERN, with_ids=True).collect()}
    library = tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(path), special_tokens={}
    )
    for r in table.collect():
        assert rows[r.doc_id].ids == library.encode_ordinary(r.text or "")
        assert rows[r.doc_id].n_tokens == len(rows[r.doc_id].ids)
    empty = bpe.digest(table.where(F.lit(False)), path, public_tokenizers.PATTERN, with_ids=True)
    assert empty.collect() == [] and empty.columns[-1] == "ids"
