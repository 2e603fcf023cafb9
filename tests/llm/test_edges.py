"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import gzip
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import (
    bpe, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, token_store, warc, warc_pages,
)
from emberwatch.llm.common import components
from emberwatch.llm.embedding_dedup import near_duplicates
from emberwatch.session import shared_folder

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


@pytest.fixture
def odd(docs):
    """Null text, empty text, a very long one, repeated rows, a null doc_id, and columns named as the operators'."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "the same text here and there", "en", "b"),
        (4, "the same text here and there", "en", "b"), (5, " the  same text\there and there\n", "en", None),
        (None, "a text without a number at all", "en", "a"),
    ]
    found = docs(*rows)
    for name in ("h", "sha", "norm", "row", "size", "sig", "node", "shard", "ids", "block", "kept", "h1"):
        found = found.withColumn(name, F.lit("x"))
    return found


@pytest.fixture
def none(odd):
    return odd.where("false")


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (6, 6)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7)}


def test_language_id(odd, none):
    assert language_id.train(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}
    model = language_id.train(odd)
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert (1, "und") in found and (2, "und") in found and (3, "en") in found and (None, "en") in found
    assert language_id.identify(none, model).count() == 0
    assert language_id.accepted(odd, model).columns == odd.columns


def test_codewords_are_apart():
    for n in (1, 2, 4, 5, 12):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code}) == n


def test_license_overlaps(docs, odd, none):
    text = "GNU General Public License version 3 or any later version. CC BY-NC 4.0; cc by cc by"
    row = license_scan.scan_licenses(docs(text)).first()
    assert row["n_base"] == 4 and row["base_labels"] == "cc-by,gpl"
    assert row["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0-or-later"  # shorter matches inside are suppressed
    assert (row["first_word"], row["last_word"]) == (1, 17)
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(odd).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["first_word"] is None and rows[3]["n_words"] == 120_000
    assert license_scan.scan_licenses(none).count() == 0
    assert len(license_scan.RULES) >= 200


def _matches(pattern):
    """Texts that a signature's pattern matches: every choice of what may be there, one of what repeats."""
    from re import _constants as C, _parser

    def expand(tokens):
        found = [""]
        for op, arg in tokens:
            if op is C.LITERAL:
                more = [chr(arg)]
            elif op is C.IN:
                more = [chr(a) if o is C.LITERAL else {C.CATEGORY_DIGIT: "7"}.get(a, "q") for o, a in arg]
            elif op is C.SUBPATTERN:
                more = expand(arg[-1])
            elif op is C.BRANCH:
                more = [x for branch in arg[1] for x in expand(branch)]
            else:
                assert op is C.MAX_REPEAT, op
                more = [x * n for x in expand(arg[2]) for n in {arg[0], min(arg[1], max(arg[0], 1))}]
            found = [a + b for a in found for b in more]
        return found

    return {" ".join(x.split()) for x in expand(_parser.parse(pattern)) if "(" not in x and ")" not in x}


def test_license_gates_let_every_match_through():
    shut, wrong = set(), set()
    for rule in license_scan.RULES:
        texts = sorted(_matches(rule.pattern.pattern[len(rb"(?<!\S)") : -len(rb"(?!\S)")].decode()))
        assert texts and all(rule.pattern.fullmatch(t.encode()) for t in texts)
        shut |= {t for t in texts if rule.gate.isdisjoint(t.encode().split())}
        for text in texts[:: max(1, len(texts) // 8)]:
            found = license_scan.detections(text.encode(), set(text.encode().split()))
            if found != license_scan.detections(text.encode(), license_scan.GATES):
                wrong.add(text)
    assert not shut and not wrong, (len(shut), sorted(shut)[:20], sorted(wrong)[:20])


def test_licenses_in_one_word(docs):
    texts = {
        "LGPLv3": "lgpl-3.0", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3.0", "MPLv2": "mpl-2.0", "MPL2": "mpl-2.0",
        "GPL2": "gpl-2.0", "GPL3": "gpl-3.0", "EPL1": "epl-1.0", "OSL3": "osl-3.0",
        "No part of this book may be reproduced": "proprietary",
    }
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(*texts)).collect()}
    for i, label in enumerate(texts.values()):
        assert (rows[i]["labels"], len(rows[i]["spans"])) == (label, 1) and rows[i]["score"] > 0


def test_exact_copies(docs, odd, none):
    rows = sorted(tuple(r) for r in exact_dedup.exact_duplicates(docs("a b", "ab ", "", None, "\t"), 1).drop("text_sha256").collect())
    assert rows == [(0, 0, 2, True), (1, 0, 2, False), (2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True)]
    found = exact_dedup.exact_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in found) == [
        (0, 0, 1), (1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 5, 3), (4, 5, 3), (5, 5, 3),
    ]
    assert exact_dedup.keep_first(odd).count() == 4
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    cells, _ = exact_dedup.directory(keys, 100)
    held = build = exact_dedup.build_index(keys, 100).groupBy("bucket").count()
    assert held.count() >= 30 and build.agg(F.max("count")).first()[0] <= 130
    assert cells.select("cell").distinct().count() == cells.count()


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    # A third of the hashes share their first 40 bits, more than the cells of the start can tell apart.
    near = F.lit(0x1234567890 << 24).cast("long") + F.col("id") * 4096
    keys = spark.range(3000).select(F.when(F.col("id") < 1000, near).otherwise(F.xxhash64("id")).alias("h"))
    index = exact_dedup.build_index(keys, 100)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 100
    assert sorted(r["h"] for r in index.collect()) == sorted(r["h"] for r in keys.collect())
    ranges = sorted(tuple(r) for r in index.selectExpr("bucket", "h & 9223372036854775807 as low", "h < 0 as high")
                    .groupBy("bucket").agg(F.min(F.struct("high", "low")), F.max(F.struct("high", "low"))).collect())
    assert all(one[2] < two[1] for one, two in zip(ranges, ranges[1:]))  # buckets own ranges of hashes


def test_water_fill():
    assert mixing.water_fill([3, 1, 2], [20, 20, 20], 45) == pytest.approx([20, 25 / 3, 50 / 3])


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 100, 1000):
        there = mixing.permuted(np.arange(n), n, 5)
        assert sorted(there.tolist()) == list(range(n))
        assert mixing.permuted(there, n, 5, back=True).tolist() == list(range(n))


def test_shards_use_up_their_quotas():
    quota = np.array([13, 0, 57, 10], np.int64)
    parts = [mixing.draw_shard(quota, i, 8, 10, 1) for i in range(8)]
    assert all(int(count.sum()) == 10 for _, count in parts)
    total = np.zeros(4, np.int64)
    for first, count in parts:
        assert (first == total).all()
        total += count
    assert (total == quota).all()


def test_mix(odd, none):
    mixed = mixing.mix(odd, block_words=64, shard_slots=100)
    rows = mixing.taken(mixed).collect()
    assert len(rows) == 7 and all(r["taken"] <= 2 * r["size"] for r in rows)
    for plan in mixed.plans:
        own = [r for r in rows if r["target"] == plan.target and r["source_size"] == plan.words]
        assert sum(r["taken"] for r in own) == min(round(plan.target), 2 * plan.words)
    out = mixing.mixed_documents(odd, mixed)
    assert out.columns == odd.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_jaccard(docs, odd, none):
    words = [f"w{i}" for i in range(300)]
    near = list(words)
    near[150] = "x"
    far = [w + "y" for w in words[:250]] + words[250:]
    rows = jaccard_join.jaccard_components(docs(" ".join(words), " ".join(near), " ".join(far), " ".join(words).upper())).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 0}
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.jaccard_components(odd).collect())
    assert found == [(0, 3, 0), (1, 0, 1), (2, 0, 2), (3, 6, 3), (4, 2, 4), (4, 2, 4), (5, 2, 4)]
    assert jaccard_join.jaccard_components(none).count() == 0


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(1)
    for n in (97, 130, 400, 2000):
        one = np.unique(draw.integers(1, 2**62, n, dtype=np.uint64))
        change = n // 8  # so that Jaccard stays above 0.75
        two = np.unique(np.concatenate([one[change:], draw.integers(1, 2**62, change, dtype=np.uint64)]))
        common = len(np.intersect1d(one, two))
        assert 100 * common >= 75 * (len(one) + len(two) - common)
        assert np.intersect1d(jaccard_join.signatures(one, len(one), 75), jaccard_join.signatures(two, len(two), 75)).size


def test_common_counts():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, 30)) for _ in range(9)]
    found = jaccard_join.common_counts(sets[:4], sets[4:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_warc(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "a\r\nb", None), (4, "v", ""), (None, "w", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = shared_folder(spark, "warc")
    warc_pages.register(spark)
    warc_pages.archive(pages, folder)
    found = {r["page_id"]: tuple(r)[1:] for r in warc_pages.read_back(spark, folder).collect()}
    assert {k: (v[0], v[2], v[3]) for k, v in found.items()} == {
        1: (9, "response", None), 2: (9, "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3),
        None: (3_000_000, "response", None),
    }
    only = spark.read.format("warc").load(folder).where("target_uri = 'v'")
    assert [r["record_type"] for r in only.collect()] == ["revisit"]
    empty = shared_folder(spark, "warc")
    warc_pages.archive(pages.where("false"), empty)
    assert warc_pages.read_back(spark, empty).count() == 0


def test_warc_of_other_writers(tmp_path):
    import pyarrow as pa

    plain = [warc.record("response", f"<urn:x:{i}>", "u", hashlib.sha1(b"ab").hexdigest(), b"ab", None, 2) for i in range(3)]
    for name, data in (("a", b"".join(plain)), ("b", b"".join(gzip.compress(r) for r in plain)), ("c", b"".join(map(warc.member, plain)))):
        (tmp_path / name).write_bytes(data)
        with pa.OSFile(str(tmp_path / name)) as source:
            found = list(warc.records(source, lambda f: f["warc-record-id"] != "<urn:x:1>", True))
        assert [(f["warc-record-id"], n, p) for f, n, p in found] == [("<urn:x:0>", 2, b"ab"), ("<urn:x:2>", 2, b"ab")]


def test_token_files(odd, none):
    manifest, keys = token_store.tokenise_to_files(odd, WORDS, shard_bytes=100_000)
    rows = token_store.lookup(keys, manifest).collect()
    assert len(rows) == 7 and sorted(r["start"] for r in rows)[0] == 0
    assert sum(r["n_tokens"] for r in rows) == manifest.agg(F.sum("n_ids")).first()[0]
    shard = token_store.Shard(manifest.orderBy("shard").first()["file"])
    assert shard.get(123456789) is None
    manifest, keys = token_store.tokenise_to_files(none, WORDS)
    assert token_store.lookup(keys, manifest).count() == 0


def test_words_are_cut_where_the_tokenizer_cuts():
    from tokenizers import Tokenizer

    text = "Don't STOP... é***  'S x'll 12ab ß!?ß áb  c Ǆ İx 東京。日本 <|endoftext|> é'quoted'  z İ"
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    got = np.frombuffer(token_store._Words(WORDS, 2).ids([text])[0], "<u2").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_line_dedup(docs, odd, none):
    rows = line_dedup.dedup_lines(
        docs("a line to keep\nshort\nshort\n A LINE to keep", "short\na line to keep \nown line here", "A line to keep", None, ""), batches=2
    ).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in rows} == {
        0: (4, 0, "a line to keep\nshort\nshort\n A LINE to keep"), 1: (3, 1, "short\nown line here"), 2: (1, 1, ""),
        3: (1, 0, ""), 4: (1, 0, ""),
    }
    assert line_dedup.dedup_lines(odd).count() == 7
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for i in range(5):
        runs.add(spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("h1"), F.col("id").alias("h2")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    asked = spark.range(45, 55).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
    assert runs.seen(asked).where("old").count() == 5


def test_embeddings(spark):
    big = [1.0, 0.0, 0.0]
    rows = [
        (1, big, 0), (2, [2.0, 0.0, 0.0], 0), (3, [0.9, 0.1, 0.0], 1), (4, [0.0, 1.0, 0.0], 0), (5, None, 0), (6, [], 0),
        (7, [0.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [None, 1.0, 0.0], 0), (10, [1.0, 0.0], 0),
        (11, big, 0), (11, big, 0), (None, big, 0), (12, [-1.0, 0.0, 0.0], 0), (13, [float("inf"), 0.0, 0.0], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(table).collect()}
    assert {(1, 3, 1), (2, 3, 1), (3, 3, 1), (11, 3, 1), (4, 0, 4), (5, 0, 5), (10, 0, 10), (12, 0, 12)} <= found
    assert near_duplicates(table).count() == len(rows)
    assert near_duplicates(table.where("false")).count() == 0


def test_bpe(odd, none):
    encoded = bpe.encode(odd, BPE, public_tokenizers.PATTERN)
    texts = sorted((r["text"] or "").encode() for r in odd.collect())
    assert sorted(bytes(r["data"]) for r in bpe.decode(encoded, BPE).collect()) == texts
    assert bpe.encode(none, BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_cuts_words_like_the_library():
    text = "a  b\n\n c\t\t'll don't    x\x1cy !!'s 12 ab12   "
    library = bpe._encoder(BPE, public_tokenizers.PATTERN)
    assert sum((library.encode_ordinary(w) for w in bpe.WORD.findall(text)), []) == library.encode_ordinary(text)
