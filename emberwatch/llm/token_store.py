"""Token ids as raw binary shards, each with a minimal perfect hash index from document keys to places.

A shard is two files: `<name>.bin`, the ids of its documents one after the other (unsigned little-endian, two bytes
where the vocabulary fits, else four), and `<name>.idx`, the index. See `write_index` for its layout.
"""

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored
from emberwatch.session import shared_folder

MAGIC = b"MPHIDX01"
#: Bits for each key in a level of the hash; more bits place more keys at once.
SPREAD = 1.5
#: Words whose ids a worker remembers, and the most bytes of such a word: a text without blanks is one word.
REMEMBERED, LONGEST = 500_000, 64
#: Bytes of text whose words are looked up together, or one text if it is longer.
LOOKED_UP = 8_000_000
#: New words that go through the tokenizer as one text.
TOGETHER = 500


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_keys(doc_ids: list, nth: list[int]) -> np.ndarray:
    """64-bit keys of (doc_id, how many rows before had the same doc_id); a null doc_id is a key as well."""
    own = np.array([0 if d is None else d for d in doc_ids], np.int64).astype(np.uint64)
    null = np.array([d is None for d in doc_ids], np.uint64)
    return _mixed(own, 1) ^ _mixed(np.array(nth, np.uint64) * np.uint64(2) + null, 2)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct keys: in each level the keys that are alone on their bit are
    placed, the others go on to the next."""
    levels = []
    while len(keys):
        size = max(64, int(len(keys) * SPREAD) + 63 & ~63)
        at = (_mixed(keys, 10 + len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
        if len(levels) > 200:
            raise ValueError("two documents have the same key")
    return levels


def ranked(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each level with the slot that each of its bits stands for."""
    base, out = 0, []
    for level in levels:
        rank = np.cumsum(level) + (base - 1)
        base += int(level.sum())
        out.append((level, rank))
    return out


def slots(levels: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, from 0 to the number of keys less one; -1 for a key that no level places."""
    found = np.full(len(keys), -1, np.int64)
    for k, (level, rank) in enumerate(levels):
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            break
        at = (_mixed(keys[rest], 10 + k) % np.uint64(len(level))).astype(np.int64)
        hit = level[at]
        found[rest[hit]] = rank[at[hit]]
    return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 5) >> np.uint64(32)).astype(np.uint32)


def write_index(out, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, width: int) -> None:
    """Magic, length of the header, header (JSON), packed bits of each level, then by slot: fingerprint (4 bytes),
    start and number of ids in the payload, and the document's row in the shard (8 bytes each)."""
    levels = build_levels(keys)
    order = np.empty(len(keys), np.int64)
    order[slots(ranked(levels), keys)] = np.arange(len(keys))
    head = json.dumps({"n": len(keys), "width": width, "levels": [len(x) for x in levels]}).encode()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for level in levels:
        out.write(np.packbits(level).tobytes())
    out.write(fingerprints(keys)[order].astype("<u4").tobytes())
    for column in (starts, sizes, rows):
        out.write(np.asarray(column)[order].astype("<u8").tobytes())


class Shard:
    """An opened shard: constant-time access to a document's ids by its key."""

    def __init__(self, place: str):
        files, path = fs.FileSystem.from_uri(place)
        with files.open_input_file(path + ".idx") as source:
            data = source.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{place}.idx is no index")
        size = struct.unpack("<I", data[8:12])[0]
        head, at = json.loads(data[12 : 12 + size]), 12 + size
        self.n, self.width, levels = head["n"], head["width"], []
        for bits in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, bits // 8, at)).astype(bool))
            at += bits // 8
        self.levels = ranked(levels)
        self.prints = np.frombuffer(data, "<u4", self.n, at)
        at += 4 * self.n
        self.starts, self.sizes, self.rows = (np.frombuffer(data, "<u8", self.n, at + 8 * self.n * i) for i in range(3))
        self.files, self.payload = files, path + ".bin"

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 where the fingerprint says that the shard does not hold the key."""
        at = slots(self.levels, keys)
        hit = at >= 0
        hit[hit] = self.prints[at[hit]] == fingerprints(keys)[hit]
        return np.where(hit, at, -1)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        at = int(self.find(document_keys([doc_id], [nth]))[0])
        if at < 0:
            return None
        with self.files.open_input_file(self.payload) as source:
            data = source.read_at(int(self.sizes[at]) * self.width, int(self.starts[at]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype(np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a word; None where a word may go without an end, as not every byte has one."""
    from tokenizers.pre_tokenizers import ByteLevel

    vocabulary, suffix = _tokenizer(path).get_vocab(), _tokenizer(path).model.end_of_word_suffix
    if not suffix or not all(byte + suffix in vocabulary for byte in ByteLevel.alphabet()):
        return None
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


class _Remembered:
    """Ids of words of up to `LONGEST` bytes, as bytes, and the batch that asked for each word last. Of more than
    `REMEMBERED`, half that number stays, those that were asked for last, so frequent words stay."""

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        self.last, self.batch = np.zeros(0, np.int64), 0

    def look_up(self, words: pa.Array, learn: Callable[[list[bytes]], list[bytes]]) -> pa.Array:
        """The ids of distinct words; `learn` gives those of words that are unknown."""
        places = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        if len(unknown := np.flatnonzero(places < 0)):
            places[unknown] = len(self.words) + np.arange(len(unknown))
            new = words.take(pa.array(unknown))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = pa.concat_arrays([self.ids, pa.array(learn(new.to_pylist()), pa.large_binary())])
            self.last = np.append(self.last, np.zeros(len(unknown), np.int64))
        self.batch += 1
        self.last[places] = self.batch
        found = self.ids.take(pa.array(places))
        stay = np.flatnonzero(pc.binary_length(self.words).to_numpy() <= LONGEST)
        if len(stay) > REMEMBERED:
            stay = np.sort(stay[np.argsort(self.last[stay], kind="stable")[len(stay) - REMEMBERED // 2 :]])
        if len(stay) < len(self.words):
            self.words, self.ids = self.words.take(pa.array(stay)), self.ids.take(pa.array(stay))
            self.last = self.last[stay]
        return found


_REMEMBERED: dict[tuple[str, int], _Remembered] = {}
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL = re.compile(rb"(.*[^\x00-\x7f])([!-/:-@\[-`{-~]+)", re.S)
#: ASCII letters become small and each ASCII blank a space.
_EVEN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
_ENDS_BEFORE_LETTER = _IS_MARK & (np.arange(256) != ord("'"))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many words are before each text and before the end. A word ends at a blank,
    between an ASCII letter and an ASCII mark, and between such a mark and a letter unless the mark is an apostrophe,
    which may belong to the letters after it. The tokenizer's own pattern cuts at each of these places."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    text, offsets = np.frombuffer(raw.tobytes().translate(_EVEN), np.uint8), offsets - offsets[0]
    solid, letter = text != ord(" "), _IS_LETTER[text]
    first = np.zeros(len(text), bool)
    first[1:] = ~solid[:-1] | letter[:-1] & _IS_MARK[text[1:]] | _ENDS_BEFORE_LETTER[text[:-1]] & letter[1:]
    first[offsets[:-1][offsets[:-1] < len(text)]] = True
    first &= solid
    counts = np.searchsorted(np.flatnonzero(first), offsets)
    text, first = text[solid], first[solid]
    bounds = np.append(np.flatnonzero(first), len(text))
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    return words, counts


class _Words:
    """Ids of words, as bytes: a word's ids do not depend on its neighbours where the tokenizer drops blanks, so each
    distinct word that a worker remembers goes through the tokenizer once. Words that are not letters only are first
    cut where the tokenizer's own pattern cuts them, and those beyond ASCII where marks at their end follow a letter."""

    def __init__(self, path: str, width: int):
        self.tokenizer, self.kind, self.ends = _tokenizer(path), np.dtype(f"<u{width}"), _word_ends(path)
        self.known = _REMEMBERED.setdefault((path, width), _Remembered())

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words by the tokenizer."""
        cut = {word: self._cut(word) for word in words if not word.isalpha()}
        parts = dict.fromkeys(word for word in words if word not in cut)
        parts.update(dict.fromkeys(part for own in cut.values() for part in own))
        parts, ids = list(parts), {}
        for at in range(0, len(parts), 20_000):
            self._learn_parts(parts[at : at + 20_000], ids)
        return [b"".join([ids[part] for part in cut[word]]) if word in cut else ids[word] for word in words]

    def _learn_parts(self, parts: list[bytes], ids: dict[bytes, bytes]) -> None:
        """Parts of letters go through the tokenizer together and are told apart by the ids that end a word. Each
        has at least one, so as many ends as parts are one for each; else the parts are encoded one by one."""
        letters, alone = [], list(parts) if self.ends is None else []
        if self.ends is not None:
            for part in parts:
                (letters if part.isalpha() or part.decode().isalpha() else alone).append(part)
        groups = [letters[at : at + TOGETHER] for at in range(0, len(letters), TOGETHER)]
        texts = [b" ".join(own).decode() for own in groups]
        width = self.kind.itemsize
        for own, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            numbers = np.array(encoded.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[numbers]) + 1) * width).tolist()
            if len(stops) == len(own):
                raw = numbers.tobytes()
                ids.update(zip(own, [raw[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                alone += own
        found = self.tokenizer.encode_batch_fast([part.decode() for part in alone], add_special_tokens=False)
        ids.update((part, np.array(e.ids, self.kind).tobytes()) for part, e in zip(alone, found))

    @staticmethod
    def _cut(word: bytes) -> list[bytes]:
        if word.isascii():
            return _PARTS.findall(word)
        tail = _TAIL.fullmatch(word)
        # As the tokenizer's pattern sees it: a dot above, say, that comes off a letter belongs to the marks.
        if tail and unicodedata.normalize("NFC", tail[1].decode()).lower()[-1].isalpha():
            return [tail[1], tail[2]]
        return [word]

    def encoded(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text and `end`, as bytes. Texts are split and their words looked up as columns; only words
        that are unknown are taken one by one."""
        if not len(texts):
            return pa.array([], pa.binary())
        words, counts = _split(texts)
        coded = words.dictionary_encode()
        ids = self.known.look_up(coded.dictionary, self.learn)
        ids = pa.concat_arrays([ids, pa.array([end], pa.large_binary())])
        places = np.insert(coded.indices.to_numpy(), counts[1:], len(ids) - 1)
        taken = ids.take(pa.array(places))
        bounds = np.frombuffer(taken.buffers()[1], np.int64)[counts + np.arange(len(counts))]
        data = taken.buffers()[2]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), data]).cast(pa.binary())

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.encoded(pa.array(texts, pa.string())).to_pylist()


def shard_bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """Quantiles of doc_id between shards of about `shard_bytes` of text: what comes to the driver is one number for
    each shard. A shard holds the doc_ids above its lower bound up to its upper one; null comes first."""
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length("text").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = total // shard_bytes + 1
    share = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx("doc_id", share, 20 * wanted)).first()[0] if share else None
    return sorted(set(cuts or []))


def _shards(doc_ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    found = np.searchsorted(bounds, doc_ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "left")
    return pa.array(found.astype(np.int32), pa.int32())


def _portions(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows in turn, in portions of about `LOOKED_UP` bytes of text."""
    nth = np.cumsum(pc.binary_length(batch["text"]).to_numpy(), dtype=np.int64) // LOOKED_UP
    at = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(nth)]
    return [batch.slice(a, b - a) for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, bounds: list[int], path: str, end_id: int, width: int) -> DataFrame:
    """(doc_id, shard, ids): ids of every whole text and the end id, as raw bytes. A null text is empty."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one core; threads of the tokenizer would wait for work beside those of the other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words, end = _Words(path, width), np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for some in _portions(batch):
                own, ids = some["doc_id"], words.encoded(some["text"], end)
                yield pa.record_batch({"doc_id": own, "shard": _shards(own, cuts), "ids": ids})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, shard int, ids binary")


def document_places(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """(shard, doc_id, nth) of every row; `nth` tells rows that repeat a doc_id apart."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "shard": _shards(batch["doc_id"], cuts)})

    placed = docs.select(F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, shard int").repartition("shard")
    same = Window.partitionBy("shard", "doc_id").orderBy("doc_id")
    return placed.withColumn("nth", F.row_number().over(same) - 1)


def write_shards(encoded: DataFrame, shards: int, folder: str, width: int) -> DataFrame:
    """Write the shards; returns the manifest (shard, file, n_docs, n_ids), which names the files of tasks that were
    committed. Files of tasks that were lost are in the folder as well, but in no manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard and doc_id; ids are written as they come, only the index is held.
        writer = None
        for batch in batches:
            for doc_id, shard, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "shard", "ids"))):
                if writer is None or writer.shard != shard:
                    if writer:
                        yield writer.close()
                    writer = _Writer(folder, shard, width)
                writer.add(doc_id, ids)
        if writer:
            yield writer.close()

    return (
        encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
        .mapInArrow(run, "shard int, file string, n_docs long, n_ids long")
    )


class _Writer:
    def __init__(self, folder: str, shard: int, width: int):
        self.shard, self.width, self.place = shard, width, f"{folder}/{shard:08d}-{uuid.uuid4().hex}"
        self.files, self.path = fs.FileSystem.from_uri(self.place)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path + ".bin")
        self.docs, self.nth, self.sizes = [], [], []

    def add(self, doc_id, ids: bytes) -> None:
        again = self.docs and self.docs[-1] == doc_id
        self.nth.append(self.nth[-1] + 1 if again else 0)
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // self.width)
        self.out.write(ids)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        sizes = np.array(self.sizes, np.int64)
        with self.files.open_output_stream(self.path + ".idx") as out:
            rows = np.arange(len(sizes))
            write_index(out, document_keys(self.docs, self.nth), np.cumsum(sizes) - sizes, sizes, rows, self.width)
        return pa.record_batch(
            {
                "shard": pa.array([self.shard], pa.int32()), "file": [self.place],
                "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([int(sizes.sum())], pa.int64()),
            }
        )


def lookup(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids_crc32) of keys (shard, doc_id, nth), each found by the shard's index.

    `start` counts the ids of all documents before it. `manifest` has one row per shard, so its running total is
    small. Keys that the index does not hold give no row.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shard = source = None
        for batch in batches:
            out = []
            rows = list(zip(*(batch[c].to_pylist() for c in ("doc_id", "nth", "file", "base"))))
            for at in range(0, len(rows), 2_000):
                some = rows[at : at + 2_000]
                for file in dict.fromkeys(r[2] for r in some):
                    if file != place:
                        place, shard = file, Shard(file)
                        source = shard.files.open_input_file(shard.payload)
                    own = [r for r in some if r[2] == file]
                    found = shard.find(document_keys([r[0] for r in own], [r[1] for r in own]))
                    for (doc_id, nth, _, base), slot in zip(own, found.tolist()):
                        if slot < 0:
                            continue
                        start, size = int(shard.starts[slot]), int(shard.sizes[slot])
                        raw = source.read_at(size * shard.width, start * shard.width)
                        ids = np.frombuffer(raw, f"<u{shard.width}").astype("<u4")
                        out.append((doc_id, nth, base + start, size, zlib.crc32(ids.tobytes())))
            columns = list(zip(*out)) or [()] * 5
            names = ("doc_id", "nth", "start", "n_tokens", "ids_crc32")
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(names, columns)})

    found = keys.join(placed.select("shard", "file", "base"), "shard").sortWithinPartitions("shard")
    return found.select("doc_id", "nth", "file", "base").mapInArrow(
        run, "doc_id long, nth long, start long, n_tokens long, ids_crc32 long"
    )


def tokenise_to_files(
    docs: DataFrame, path: str, end_id: int = 1, width: int = 2, shard_bytes: int = 32_000_000
) -> tuple[DataFrame, DataFrame]:
    """Write token ids of whole texts to shards in ascending doc_id order; (manifest, keys to look them up).

    Null texts are empty and have the end id only; a null doc_id comes first; rows that repeat a doc_id are ordered by
    their ids. `width` is 2 where all ids are under 65,536, else 4. An empty table has no shards.
    """
    bounds = shard_bounds(docs, shard_bytes)
    folder = shared_folder(docs.sparkSession, "token-ids")
    encoded = encode(docs, bounds, path, end_id, width)
    manifest = stored(write_shards(encoded, len(bounds) + 1, folder, width), "manifest")
    return manifest, document_places(docs, bounds)
