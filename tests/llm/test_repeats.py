"""Rows that differ in their source only, and word tables that are smaller than a batch."""

import random

import numpy as np
import public_tokenizers as files
import pyarrow as pa

from emberwatch.llm import mixing, token_store


def test_mix_of_rows_that_differ_in_source_only(docs):
    """Each is a document of its own source: none is taken beyond twice its size, and both come out."""
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "y"), (1, "a b c", "en", None), (2, "d e f g", "en", "x")]
    table = docs(*rows, (2, "d e f g", "en", "x"))
    mixed = mixing.mix(table, block_words=2)
    found = mixing.taken(mixed).collect()
    assert len(found) == 5 and all(r["taken"] <= 2 * r["size"] for r in found)
    by_source = {}
    for r in mixed.docs.join(mixed.spans(), ["row", "start"]).collect():
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["n"]
    targets = {p.source: p.target for p in mixed.plans}
    assert by_source.keys() == targets.keys() and all(abs(by_source[s] - t) <= 1 for s, t in targets.items())
    out = mixing.mixed_documents(table, mixed).collect()
    assert {r["source"] for r in out} == {"x", "y", None}
    assert sum(len(r["text"].split()) for r in out) == sum(by_source.values())


def test_taken_against_a_loop_over_slots(docs):
    """What the joins count for each document, counted slot by slot."""
    texts = [(i, " ".join(f"w{j}" for j in range(i * 7 % 23)), "en", "abc"[i % 3]) for i in range(60)]
    mixed = mixing.mix(docs(*texts), block_words=5, shard_slots=16, group_rows=7)
    laid = mixed.docs.collect()
    wanted = {r["doc_id"]: 0 for r in laid}
    for slot in mixed.slots.collect():
        for word in range(slot["block"] * 5, slot["block"] * 5 + slot["words"]):
            # A source's last block may reach beyond its end.
            for r in laid:
                if r["place"] == slot["place"] and r["start"] <= word < r["start"] + r["size"]:
                    wanted[r["doc_id"]] += 1
    assert {r["doc_id"]: r["taken"] for r in mixing.taken(mixed).collect()} == wanted and sum(wanted.values()) > 300


def test_slots_are_not_broadcast(docs):
    mixed = mixing.mix(docs(*[(i, "a b c", "en", "x") for i in range(9)]))
    plan = mixed.spans()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_more_words_than_are_remembered(monkeypatch):
    """Ids do not depend on how many words are remembered, also where one batch has more."""
    path = files.path("word_bpe_49k.json")
    texts = [f"alpha beta Gamma {i} word{i % 5} it's naïve, x{i}y!" for i in range(40)]
    wanted = token_store._Words(path, 2).ids(texts)
    monkeypatch.setattr(token_store, "REMEMBERED", 3)
    monkeypatch.setattr(token_store, "_REMEMBERED", {})
    words = token_store._Words(path, 2)
    assert [x for i in range(0, 40, 4) for x in words.ids(texts[i : i + 4])] == wanted
    assert words.ids(texts) == wanted and words.ids(texts[:1]) == wanted[:1]


def test_new_words_of_letters_are_encoded_together(monkeypatch):
    """Also letters that the tokenizer takes apart, which are then encoded one by one."""
    path, asked = files.path("word_bpe_49k.json"), []
    plain = token_store._tokenizer(path)

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    def ids(texts):
        monkeypatch.setattr(token_store, "_REMEMBERED", {})
        words = token_store._Words(path, 2)
        monkeypatch.setattr(words, "tokenizer", Counted())
        return [np.frombuffer(x, "<u2").tolist() for x in words.ids(texts)]

    simple = [" ".join(f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"), "größe naïve слово 漢字"]
    assert ids(simple) == [plain.encode(t, add_special_tokens=False).ids for t in simple]
    assert len(asked) <= 2
    odd = ["ab क़ cd İstanbul ﬁn ǅ ªb ǰͅ é x"] + ["word " * 3, ""]
    assert ids(odd) == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_words_are_learned_once_whatever_marks_are_beside_them(monkeypatch):
    """Also in other texts, with other blanks and with large letters."""
    path, learned = files.path("word_bpe_49k.json"), []
    monkeypatch.setattr(token_store, "_REMEMBERED", {})
    words = token_store._Words(path, 2)
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: learned.extend(new) or learn(new))
    texts = ["word, word. (word)\tword's", "WORD  word!", "", " \n"]
    plain = token_store._tokenizer(path)
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in words.ids(texts)] == wanted
    assert sorted(learned) == [b"!", b"'s", b"(", b")", b",", b".", b"word"]


def test_columns_of_texts_equal_the_tokenizer(monkeypatch):
    """Parts of columns with long offsets, with an id at the end, and with words that are forgotten at once."""
    path, chance = files.path("word_bpe_49k.json"), random.Random(5)
    signs = [*"abstver\u00e9\u00c9\u00df\u03a3\u0130\u5b57\u0338\u0301\u0345\u00a0\u0085\u200b\u0663\u00bd\U0001f600"]
    signs += [*"\x00\x1c\x7f\t\n\r    7<=''''.,(*$%|", "'ll", "'re", "  "]
    texts = ["".join(chance.choices(signs, k=chance.randrange(60))) for _ in range(400)]
    texts += ["", " ", "<|endoftext|>", "\u0130, \u0958."]
    plain = token_store._tokenizer(path)
    wanted = [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for remembered in (3, 1_000_000):
            monkeypatch.setattr(token_store, "_REMEMBERED", {})
            monkeypatch.setattr(token_store, "REMEMBERED", remembered)
            words, column, got = token_store._Words(path, 4), pa.array(texts, kind), []
            for at in range(0, len(texts), 50):
                got += words.encoded(column.slice(at, 50), np.array([1], "<u4").tobytes()).to_pylist()
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == wanted


def test_portions_of_a_batch_hold_all_rows(monkeypatch):
    monkeypatch.setattr(token_store, "LOOKED_UP", 10)
    for texts in ([], [""], ["x" * 30, "", "y" * 9, "z", "x" * 11, ""], ["é" * 4] * 7):
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        parts = token_store._portions(batch)
        assert [x for part in parts for x in part["text"].to_pylist()] == texts
        assert all(len("".join(part["text"].to_pylist()[1:]).encode()) < 10 for part in parts)


def test_long_words_are_not_remembered(monkeypatch):
    """Texts without blanks would fill a worker's memory; their ids are whole all the same."""
    path = files.path("word_bpe_49k.json")
    monkeypatch.setattr(token_store, "_REMEMBERED", {})
    words, plain = token_store._Words(path, 2), token_store._tokenizer(path)
    texts = ["字" * 500, "a b " + "x" * 65 + " " + "y" * 64, "字" * 500 + " b"]
    for _ in range(2):
        wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u2").tolist() for x in words.ids(texts)] == wanted
        assert sorted(words.known.words.to_pylist()) == [b"a", b"b", b"y" * 64]
