"""Queries that SQL can't express, held against plain Python over the same tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers_files
import pytest

from emberwatch.llm import queries
from emberwatch.llm.common import BLANKS

BLANK = re.compile(f"[^{BLANKS}]+")


@pytest.fixture(scope="module")
def texts(spark):
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def test_op1_is_right_on_held_out_documents(spark, folder, texts):
    found = {r["doc_id"]: r for r in queries.op1_language_id(spark, folder).collect()}
    assert found.keys() == texts.keys()
    held = [d for d in found if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(found[d]["held_out"] == (d in held) for d in found)
    right = sum(found[d]["lang_pred"] == texts[d]["lang"] for d in held) / len(held)
    assert right >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_op2_base_columns(spark, folder, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    found = {r["doc_id"]: r for r in queries.op2_license_scan(spark, folder).collect()}
    for doc_id, row in texts.items():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), row["text"] or "")
        words = word.findall(lowered)
        places = sorted(
            (i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p
        )
        got, base = found[doc_id], sorted({x for _, x in places})
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got["base_labels"] == ",".join(base)
        labels = [x for x in got["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(base) <= set(labels)


def test_op4_meets_its_targets(spark, folder, texts):
    rows = queries.op4_source_mix(spark, folder).collect()
    again = queries.op4_source_mix(spark, folder).collect()
    assert sorted(rows) == sorted(again)
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(BLANK.findall(r["text"] or "")) for d, r in texts.items()}
    size, took, target = Counter(), Counter(), {}
    for r in rows:
        source = texts[r["doc_id"]]["source"]
        size[source] += r["size"]
        took[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for source in size:
        assert target[source] <= 2 * size[source] + 1e-9
        assert abs(took[source] - target[source]) <= 1


def test_op6_round_trip(spark, folder):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    want = {
        page: (
            len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "response" if first[data] == page else "revisit", None if first[data] == page else first[data],
        )
        for page, data in pages.items()
    }
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op6_warc(spark, folder).collect()}
    assert got == want


def test_op7_equals_the_tokenizer(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers_files.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id in sorted(texts):
        ids = tokenizer.encode(texts[doc_id]["text"] or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op7_token_files(spark, folder).collect()) == want


def test_op10_equals_the_library(spark, folder, texts):
    import tiktoken

    path = tokenizers_files.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("x", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id in sorted(texts):
        text = texts[doc_id]["text"] or ""
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op10_bpe(spark, folder).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, folder, name):
    import duckdb

    from check import rows

    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame, result = queries.QUERIES[name](spark, folder), duck.sql(queries.SQL[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows(frame.columns, frame.collect()) == rows(result.columns, result.fetchall())


def test_pipeline_keeps_clean_documents(spark, folder, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language ID"](spark, docs, folder)
    assert told.columns == columns
    lost = texts.keys() - {r["doc_id"] for r in told.select("doc_id").collect()}
    assert len(lost) <= 0.02 * len(texts)
    alone = stages["exact dedup"](spark, told, folder)
    kept = {r["doc_id"]: r["text"] for r in alone.collect()}
    bare = lambda t: re.sub(f"[{BLANKS}]", "", t or "")
    groups = {}
    for d in texts.keys() - lost:
        text = texts[d]["text"]
        best = groups.setdefault(bare(text), (-len(text or ""), d))
        groups[bare(text)] = min(best, (-len(text or ""), d))
    assert kept.keys() == {d for _, d in groups.values()}
    near = stages["n-gram Jaccard join"](spark, alone, folder)
    left = {r["doc_id"]: r for r in near.collect()}
    assert near.columns == columns and left.keys() <= kept.keys()
    mixed = stages["source mix"](spark, near, folder)
    assert mixed.columns == columns
    words, before = Counter(), Counter()
    for r in mixed.collect():
        words[r["source"]] += len(BLANK.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in left.values():
        before[r["source"]] += len(BLANK.findall(r["text"] or ""))
    assert abs(sum(words.values()) - 1.5 * sum(before.values())) <= len(before)
    assert stages["byte-level BPE"](spark, mixed, folder).count() == mixed.count()
    assert corpus_pipeline.run(spark, folder).count() == mixed.count()
