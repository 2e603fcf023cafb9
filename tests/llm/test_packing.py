"""Packing: the plan against what any plan must satisfy, tokens against the tokenizer's own library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest

from emberwatch.llm import packing, queries

PATH = files.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: np.array(found.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def filled(plan):
    """The pieces (length, rank) of each sequence with their offsets."""
    out = defaultdict(list)
    for length, first, stop, each, base, at in plan.lines:
        for i in range(stop - first):
            out[base + i // each].append((at + i % each * length, length, first + i))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_document_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([50, 300])
    counts = Counter(draw.randint(1, capacity - 1) for _ in range(draw.choice([1, 40, 3000])))
    if seed % 2:
        counts[capacity // 2 + 1] += 2000  # a third of all documents are copies of one
    plan = packing.plan(dict(counts), capacity)
    found = filled(plan)
    assert sorted((x, r) for own in found.values() for _, x, r in own) == sorted(
        (x, r) for x, n in counts.items() for r in range(n)
    )
    for own in found.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(found) == set(range(plan.sequences))
    halves = sum(n for x, n in counts.items() if 2 * x > capacity)
    bound = max(-(-sum(x * n for x, n in counts.items()) // capacity), halves)
    assert plan.sequences <= 1.02 * bound + 2


def test_patterns_cover_the_demand():
    sizes, demand = np.array([70, 45, 34, 21]), np.array([10.0, 44.0, 31.0, 80.0])
    patterns, used = packing.configurations(sizes, demand, 100)
    assert (patterns.T @ sizes <= 100).all() and np.allclose(patterns @ used, demand)
    # Between the bound by volume and one size a sequence; no pattern is worth more than one sequence at its prices.
    assert demand @ sizes / 100 <= used.sum() < (demand / (100 // sizes)).sum()
    prices = np.linalg.inv(patterns.astype(float)).sum(axis=0)
    assert packing.best_pattern(sizes, prices, 100)[0] <= 1 + 1e-6


def test_op13_whole_answer(spark, folder, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op13_best_fit_packing(spark, folder).collect()
    by, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids, at = library(text), 0
        total += len(ids)
        for i, r in enumerate(sorted(by[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and (r["length"] == 2048 or i == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * total / 2048 + 1


def test_edge_cases(spark, library):
    """Null and empty texts are one end id; repeated rows, null doc_ids and texts without blanks are packed like
    others; further columns are not looked at."""
    texts = [None, "", " ", "\n\n \t x", "a" * 5000, "word " * 3000, "Größe \U0001f600 <|endoftext|>'s", "same", "same"]
    rows = [(i if i != 3 else None, t, i, b"") for i, t in enumerate(texts)] + [(7, "same", 9, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, ids binary")
    found = packing.pieces(docs, PATH, files.PATTERN, capacity=100)
    placed = packing.place(found, capacity=100, groups=5)
    assert placed.count() == found.count() == sum(-(-len(library(t)) // 100) for _, t, *_ in rows)
    whole = defaultdict(list)
    for r in found.collect():
        whole[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4")))
    for doc_id, text, *_ in rows[:7]:
        assert np.concatenate([x for _, x in sorted(whole[doc_id], key=lambda p: p[0])]).tolist() == library(text).tolist()
    packed = packing.sequences(found, placed).collect()
    assert sorted(x for r in packed for x in np.frombuffer(r["ids"], "<u4").tolist()) == sorted(
        x for _, t, *_ in rows for x in library(t).tolist()
    )
    assert all(len(r["ids"]) == 4 * sum(r["lengths"]) <= 400 for r in packed)
    none = packing.pieces(docs.limit(0), PATH, files.PATTERN)
    assert packing.place(none).count() == 0


def test_blocks_of_a_long_text(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 7)
    text = "It's  a\n\n long   text, 12345 x" * 40 + "   "
    encoder = packing._encoder(PATH, files.PATTERN)
    assert packing._ids(text, encoder).tolist() == library(text).tolist()
