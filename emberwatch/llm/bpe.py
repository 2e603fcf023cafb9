"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table."""

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import portions

# The white space of the tokenizer's pattern, spelled out because Python's own class has more characters.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words with the space before them, or runs of blanks: places where the tokenizer's own pattern cuts as well, so
#: that a word's ids do not depend on its neighbours. The pattern's finer cuts are made once per distinct word.
WORD = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Words that a task remembers the ids of; beyond them it starts afresh.
REMEMBERED = 1_000_000
#: Bytes of packed numbers whose documents are put together at a time.
PLACES = 1 << 20


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def blocks(batch: pa.RecordBatch, limit: int, parts: int) -> Iterator[tuple[int, list[str], np.ndarray, list, list]]:
    """(block, words, part of each word, doc_ids, packed numbers): documents of about `limit` characters, their
    distinct words, and for each document its id and the numbers of its words in order.

    A block's name is a hash of its content, so that a repeated task names it alike.
    """
    at = 0
    while at < len(batch):
        name, words, own, numbers, size = hashlib.blake2b(digest_size=8), {}, [], [], 0
        while at < len(batch):
            text = batch["text"][at].as_py()
            if own and size + len(text) > limit:
                break
            own.append(batch["doc_id"][at].as_py())
            name.update(f"{own[-1]}\0{len(text)}\0".encode())
            name.update(text.encode())
            numbers.append(_packed(np.array([words.setdefault(w, len(words)) for w in WORD.findall(text)], np.uint32)))
            size += len(text)
            at += 1
        found = list(words)
        part = np.array([xxhash.xxh3_64_intdigest(w) % parts for w in found], np.uint32)
        yield int.from_bytes(name.digest(), "little", signed=True), found, part, own, numbers
        # A block goes before the next one is made, here and where blocks are read.
        del words, own, numbers, found, part


def _joined(pieces: list[bytes]) -> bytes:
    """Pieces as one packed blob: their number, their lengths, and the bytes one after the other."""
    lengths = np.array([len(pieces), *map(len, pieces)], "<u4").tobytes()
    return zlib.compress(lengths + b"".join(pieces), 1)


def _split(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The lengths of the pieces of a blob, and their bytes."""
    data = zlib.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<u4", n, 4).astype(np.int64), data[4 + 4 * n :]


def _packed(places: np.ndarray) -> bytes:
    """Places as 7-bit groups, low first: frequent words come early in a block and take one or two bytes."""
    if not len(places):
        return b""
    groups = np.stack([(places >> (7 * i)) & 127 for i in range(5)], axis=1).astype(np.uint8)
    size = 1 + (places >= 1 << 7) + (places >= 1 << 14) + (places >= 1 << 21) + (places >= 1 << 28)
    order = np.arange(5)
    groups |= np.where(order < size[:, None] - 1, 128, 0).astype(np.uint8)
    return groups[order < size[:, None]].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], raw[:-1] < 128])
    start = np.flatnonzero(first)
    shift = 7 * (np.arange(len(raw)) - start[np.cumsum(first) - 1])
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, start)


def _lists(doc_ids: pa.Array | pa.ChunkedArray, ids: Iterator[np.ndarray]) -> pa.Table:
    out = list(ids)
    ends = np.cumsum([0, *map(len, out)], dtype=np.int64)
    values = np.concatenate([*out, np.zeros(0, np.int32)])
    lists = pa.LargeListArray.from_arrays(ends, values).cast(pa.list_(pa.int32()))
    return pa.table({"doc_id": doc_ids, "ids": lists})


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, one row per document row. See `encode_by`."""
    return encode_by(docs, path, pattern, _lists, "doc_id long, ids array<int>", block_chars)


def encode_by(
    docs: DataFrame, path: str, pattern: str,
    finish: Callable[[pa.Array | pa.ChunkedArray, Iterator[np.ndarray]], pa.Table], schema: str,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """Rows that `finish` makes of the doc_ids and token ids of some of a block's documents, in the task that puts them
    together: what follows from a document's ids needs no second pass of the ids through Spark.

    Documents are cut into blocks. Each block gives its distinct words, packed by the part that a word's hash names,
    and its documents as packed numbers. The words of a part meet in one task, which encodes each distinct word once
    for the whole corpus; the ids go back to their blocks, where texts are put together by position. What is shuffled
    is each distinct word of a block once, its ids, and one or two bytes for each occurrence.

    `docs` must give the same rows on a second reading (a stored table does): both sides of the last join read it.
    A null text is empty and has no ids; repeated rows are encoded alike; columns besides doc_id and text are not
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found, part, own, numbers in blocks(batch, block_chars, parts):
                order = np.argsort(part, kind="stable")
                ends = np.flatnonzero(np.diff(part[order], append=parts)) + 1
                used = part[order][ends - 1]
                blobs = [
                    _joined([found[i].encode() for i in order[first:last].tolist()])
                    for first, last in zip([0, *ends[:-1].tolist()], ends.tolist())
                ]
                yield pa.record_batch(
                    {
                        "part": pa.array(used.astype(np.int32), pa.int32()),
                        "block": np.full(len(used), block, np.int64), "words": pa.array(blobs, pa.binary()),
                    }
                )
                del found, part, own, numbers, order, blobs

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found, part, own, numbers in blocks(batch, block_chars, parts):
                # The parts of the block's words come with its first document.
                owners = [zlib.compress(part.tobytes(), 1)] + [None] * (len(own) - 1)
                yield pa.record_batch(
                    {
                        "block": np.full(len(own), block, np.int64), "doc_id": pa.array(own, pa.int64()),
                        "places": pa.array(numbers, pa.binary()), "parts": pa.array(owners, pa.binary()),
                    }
                )
                del found, part, own, numbers, owners

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _encoder(path, pattern), {}
        for batch in batches:
            for i in range(len(batch)):
                lengths, data = _split(batch["words"][i].as_py())
                ends, ids = np.cumsum(lengths).tolist(), []
                for first, last in zip([0, *ends[:-1]], ends):
                    word = data[first:last]
                    own = known.get(word)
                    if own is None:
                        own = np.array(tokenizer.encode_ordinary(word.decode()), "<u4").tobytes()
                        known[word] = own
                    ids.append(own)
                if len(known) > REMEMBERED:
                    known.clear()
                yield pa.record_batch(
                    {"part": batch["part"].slice(i, 1), "block": batch["block"].slice(i, 1), "ids": [_joined(ids)]}
                )

    def together(own: pa.Table, encoded: pa.Table) -> pa.Table:
        parts_of = [p.as_py() for p in own["parts"] if p.is_valid]
        # Two equal blocks have one name; what the first says of its words holds for both.
        part = np.frombuffer(zlib.decompress(parts_of[0]), np.uint32) if parts_of else np.zeros(0, np.uint32)
        found = dict(zip(encoded["part"].to_pylist(), range(encoded.num_rows)))
        lengths, ids = [], []
        for p in np.unique(part).tolist():
            if p not in found:
                raise RuntimeError("the documents changed between two readings; store them first")
            size, data = _split(encoded["ids"][found[p]].as_py())
            lengths.append(size // 4)
            ids.append(np.frombuffer(data, "<u4"))
        size, flat = np.concatenate([*lengths, np.zeros(0, np.int64)]), np.concatenate([*ids, np.zeros(0, np.uint32)])
        # From the order by part back to the order of the numbers.
        order = np.argsort(part, kind="stable")
        start, length = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        start[order], length[order] = np.cumsum(size) - size, size

        def ids_of(packed: bytes) -> np.ndarray:
            at = _unpacked(packed)
            n = length[at]
            total = int(n.sum())
            return flat[np.arange(total) + np.repeat(start[at] - (np.cumsum(n) - n), n)].astype(np.int32)

        # A block's rows are made and given out some at a time; the first call, for none, gives the columns.
        made = [finish(own["doc_id"].slice(0, 0), iter(()))]
        for some in portions(iter(own.select(["doc_id", "places"]).to_batches()), "places", PLACES):
            made.append(finish(some["doc_id"], (ids_of(packed.as_py()) for packed in some["places"])))
        return pa.concat_tables(made)

    encoded = (
        rows.mapInArrow(words, "part int, block long, words binary").repartition("part")
        .mapInArrow(once, "part int, block long, ids binary")
    )
    own = rows.mapInArrow(places, "block long, doc_id long, places binary, parts binary")
    return own.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(together, schema)


#: Ids that are turned into text or bytes at a time.
AT_ONCE = 100_000


def digest(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, with its token ids as `ids` if asked for:
    the ids are decoded by the token-byte table, which is as large as the vocabulary file. No documents, no rows."""

    def digests(doc_ids: pa.Array | pa.ChunkedArray, ids: Iterator[np.ndarray]) -> pa.Table:
        table = _token_bytes(path)
        sizes, joined, decoded, kept = [], [], [], []
        for own in ids:
            names, data = hashlib.sha256(), hashlib.sha256()
            for at in range(0, len(own), AT_ONCE):
                some = own[at : at + AT_ONCE].tolist()
                names.update((" " * (at > 0) + " ".join(map(str, some))).encode())
                data.update(b"".join(map(table.__getitem__, some)))
            sizes.append(len(own))
            joined.append(names.hexdigest())
            decoded.append(data.hexdigest())
            if with_ids:
                kept.append(own)
        out = pa.table(
            {
                "doc_id": doc_ids, "n_tokens": pa.array(sizes, pa.int64()),
                "ids_sha256": pa.array(joined, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
            }
        )
        return out.append_column("ids", _lists(doc_ids, kept)["ids"]) if with_ids else out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_by(docs, path, pattern, digests, schema + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            data = [b"".join(map(table.__getitem__, ids or [])) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "data": pa.array(data, pa.binary())})

    return encoded.mapInArrow(run, "doc_id long, data binary")
