"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from emberwatch.llm import queries, spelling


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    longer, shorter = sorted((a, b), key=len, reverse=True)
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def by_brute_force(words):
    """(form, root, n, n_near, form_n) of each word, every two words compared."""
    near = {w: [] for w in words}
    listed = sorted(words)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and apart_by_one(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def got(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_one_edit():
    draw = random.Random(1)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 5))) for _ in range(200)]
    for a in words:
        for b in words:
            assert spelling.one_edit(a, b) == (abs(len(a) - len(b)) < 2 and apart_by_one(a, b))


@pytest.mark.parametrize("letters", ["abcd", "etaionsüÀ", "zzé×qx"])
def test_trie_finds_what_brute_force_finds(letters):
    draw = random.Random(len(letters))
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(6, 8))) for _ in range(600)})
    trie = spelling.Trie(words)
    for w in words:
        found = list(trie.near(w))
        assert sorted(found) == [x for x in words if spelling.one_edit(w, x)]


@pytest.mark.parametrize("bucket", [2, 30, 20_000])
def test_buckets_of_any_depth(spark, bucket, monkeypatch):
    """Each pair comes out once in each direction, however deep the buckets of its words are."""
    draw = random.Random(bucket)
    base = ["".join(draw.choice("etaionz") for _ in range(draw.randint(6, 9))) for _ in range(40)]
    words = Counter()
    for w in base:
        for _ in range(6):
            i = draw.randrange(len(w))
            words[w[:i] + draw.choice(["", "e", "z", "ß"]) + w[i + draw.randint(0, 1) :]] += draw.choice([5, 30, 200])
    words = {w: n for w, n in words.items() if len(w) >= 6}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    pairs = spelling.near_words(table, bucket).collect()
    wanted = sorted((a, b, words[b]) for a in words for b in words if spelling.one_edit(a, b))
    assert sorted(map(tuple, pairs)) == wanted
    assert got(spelling.spelling_variants(table)) == by_brute_force(words)


def test_op12_whole_answer(spark, folder):
    words = Counter()
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert words and got(queries.op12_spelling_variants(spark, folder)) == by_brute_force(words)


def test_edge_cases(spark):
    """Null and empty texts have no words; a very long run is a word; a null doc_id reads as empty in the key of the
    damage; further columns, of whatever name, are not looked at; an empty table gives an empty one."""
    long = "ab" * 5000
    texts = [None, "", "12 \n", "Straße " * 30, "strase " * 5, "STRAßE", "chainchain" * 3, f"{long} " * 6, f"{long}c " * 5]
    rows = [(i or None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    found = got(spelling.spelling_variants(spelling.counted_words(docs, damage=10**9)))
    assert found == {
        "straße": (None, "straße", 31, 1, None),
        "strase": ("straße", "straße", 5, 1, 31),
        long: (None, long, 6, 1, None),
        long + "c": (None, long + "c", 5, 1, None),
    }
    assert got(spelling.spelling_variants(spelling.counted_words(docs.limit(0)))) == {}


def test_chains_end_at_the_last_word(spark):
    """A chain of forms of any length is followed to its end; of two best words the smaller one is the form."""
    chain = {"aaaaaa" + "b" * i: 5 * 5**i for i in range(9)}
    words = chain | {"zzzzzzz": 5, "yzzzzzz": 30, "xzzzzzz": 30}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = got(spelling.spelling_variants(table))
    assert found == by_brute_force(words)
    assert found["aaaaaa"][1] == "aaaaaabbbbbbbb" and found["zzzzzzz"][0] == "xzzzzzz"
