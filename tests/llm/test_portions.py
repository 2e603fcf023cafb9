"""Texts become Python objects some at a time, and what is made of them goes before the next ones are taken."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from emberwatch.llm import bpe, common, language_id


def rows(texts: list[str | None]) -> pa.RecordBatch:
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["ab", None, "é" * 9, "x", "", "yz"]])
def test_portions_are_all_rows_in_order(texts):
    found = list(common.portions(iter([rows(texts), rows(texts)]), limit=3))
    assert sum((b["text"].to_pylist() for b in found), []) == texts * 2
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b["text"].to_pylist()) <= 3 for b in found)
    assert all(b.num_rows for b in found)


class Docs:
    """Gives the function that an operator hands to Spark."""

    def __init__(self, schema=None):
        self.schema = schema

    def mapInArrow(self, run, schema):
        return run


def test_language_of_many_texts_is_told_some_at_a_time(monkeypatch):
    """Of eight texts of a portion each, no more than one is a Python object at once."""
    seen = []

    class Model(language_id.Model):
        def margins(self, texts):
            seen.append(len(texts))
            return super().margins(texts)

    code = language_id.codewords(2)
    rng = np.random.default_rng(1)
    model = Model(["a", "b"], code, rng.normal(size=(language_id.BUCKETS, code.shape[1])), np.ones(code.shape))
    texts = [f"{i} ab " * (common.PORTION // 5) for i in range(8)]
    out = list(language_id.accepted(Docs(), model)(iter([rows(texts)])))
    assert seen == [1] * 8 and max(b.nbytes for b in out) < 2 * common.PORTION
    monkeypatch.setattr(common, "PORTION", 1 << 40)
    monkeypatch.setattr(common.portions, "__defaults__", ("text", 1 << 40))
    whole = list(language_id.accepted(Docs(), model)(iter([rows(texts)])))
    assert sum((b["doc_id"].to_pylist() for b in out), []) == sum((b["doc_id"].to_pylist() for b in whole), [])


def test_counts_are_those_of_the_whole_batch(monkeypatch):
    texts = ["abc def", "the cat", "", "der hund", "xyz"]
    batch = rows(texts).append_column("lang", pa.array(["en", "en", "de", "de", "en"]))
    whole = list(language_id._counts(iter([batch])))
    monkeypatch.setattr(common.portions, "__defaults__", ("text", 1))
    assert [b.to_pylist() for b in language_id._counts(iter([batch]))] == [b.to_pylist() for b in whole]


def test_a_block_goes_before_the_next_one_is_made():
    """Blocks of other words each need no more memory than one of them."""

    def peak(texts):
        batch = rows(texts)
        tracemalloc.start()
        for _, found, part, own, numbers in bpe.blocks(batch, 10, 7):
            del found, part, own, numbers
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    texts = [" ".join(f"{k}w{i}" for i in range(20_000)) for k in range(4)]
    one = max(peak([t]) for t in texts)
    assert peak(texts) < 1.2 * one


def test_ids_of_a_block_are_given_out_some_at_a_time(spark, monkeypatch):
    """With little at a time, a block's documents are finished in several calls, with the ids of the whole block."""
    path, texts = public_tokenizers.path("byte_bpe_50k.tiktoken"), ["the cat sat", None, "", "a cat\n\nsat on 12 mats", "the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bpe, "PLACES", 1)
    calls = "doc_id long, calls long"

    def finish(doc_ids, ids):
        sizes = [len(x) for x in ids]
        return pa.table({"doc_id": doc_ids, "calls": pa.array([len(sizes)] * len(sizes), pa.int64())})

    rows_of = bpe.encode_by(docs, path, public_tokenizers.PATTERN, finish, calls).collect()
    assert sorted(r["doc_id"] for r in rows_of) == [0, 1, 2, 3, 4] and max(r["calls"] for r in rows_of) < 5
    library = bpe._encoder(path, public_tokenizers.PATTERN)
    found = {r["doc_id"]: r["ids"] for r in bpe.digest(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert found == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
