"""Language identification by error-correcting output codes over binary n-gram classifiers."""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import chunks, portions

#: Hash buckets of character pairs and triples: what a model is as large as, times the number of bits.
BUCKETS = 1 << 15
#: Documents per language, in expectation, that a model is fitted on.
SAMPLE = 2_000
#: Characters that are turned into n-grams at a time; a longer text is taken in pieces.
PIECE = 200_000
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, one row each. Up to five languages get every split into two groups; more get splits
    drawn from a fixed seed, of several draws the one whose nearest two codewords are furthest apart."""
    if n <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and (min(s) < 0 or n == 1)]
        return np.array(splits, np.int8).T.reshape(n, -1)
    draw, best, most = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = draw.choice(np.array([-1, 1], np.int8), (n, max(15, int(np.ceil(10 * np.log2(n))))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * 10**6
        if apart.min() > most:
            best, most = code, apart.min()
    return best


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of all character pairs and triples of lower-cased pieces. Runs of other characters than letters
    count as one blank; n-grams lie within a piece."""
    lowered = [text.lower() for _, text in pieces]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(pieces)), [len(text) for text in lowered])
    letter = letters()[points]
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    points, owner = np.where(letter, points, 32)[stay].astype(np.uint64), owner[stay]
    places = np.array([place for place, _ in pieces], np.int64)
    out = []
    for n, factor in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F)):
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3) ^ points[i : len(points) - n + 1 + i]) * np.uint64(factor)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        out.append((places[owner[: len(h)]][inside], (h & np.uint64(BUCKETS - 1)).astype(np.int32)[inside]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


@dataclass
class Model:
    """Languages, their codewords (languages x bits), the classifiers' weights (buckets x bits) and how much each bit
    counts for each language (languages x bits, rows add up to 1)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    scale: float = 1.0

    def margins(self, texts: list[str]) -> np.ndarray:
        """The mean weight of each text's n-grams for each bit; zero without letters."""
        total, count = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for pieces in chunks(texts, PIECE):
            place, bucket = grams(pieces)
            size = max(p for p, _ in pieces) + 1
            count[:size] += np.bincount(place, minlength=size)
            for bit in range(self.weights.shape[1]):
                total[:size, bit] += np.bincount(place, self.weights[:, bit][bucket], size)
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the nearest codeword, its probability, whether the second is about as near). The distance of a
        codeword is the sum over its bits of trust times the logistic loss of the margin."""
        z = self.code[None, :, :] * (margins * self.scale)[:, None, :]
        loss = (self.trust[None, :, :] * np.logaddexp(0, -z)).sum(axis=2)
        # As many independent votes as bits that tell two codewords apart would be too sure; losses are compared as
        # they are, in units of the loss of an undecided bit.
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)) / np.log(2) * 4)
        near /= near.sum(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        score = near[np.arange(len(near)), best]
        rest = near.copy()
        rest[np.arange(len(near)), best] = 0
        return best, score, (score - rest.max(axis=1)) < 0.05


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].to_pylist()
        names = sorted(set(langs))
        own = np.array([names.index(x) for x in langs], np.int64)
        total, before = np.zeros((len(names), BUCKETS), np.int64), 0
        for some in portions(iter([batch])):
            for pieces in chunks(some["text"].to_pylist(), PIECE):
                place, bucket = grams(pieces)
                of = own[before + place] * BUCKETS + bucket
                total += np.bincount(of, minlength=total.size).reshape(total.shape)
            before += len(some)
        lang, bucket = total.nonzero()
        yield pa.record_batch(
            {
                "lang": pa.array([names[i] for i in lang], pa.string()),
                "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[lang, bucket], pa.int64()),
            }
        )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on (doc_id, text, lang) rows with a language; None where there are none.

    About `sample` documents of each language are taken by a hash of doc_id, whole texts. Their n-grams are counted on
    the executors; what comes to the driver is at most BUCKETS counts for each language. Each bit's classifier weighs
    an n-gram by the logarithm of how much more frequent it is in the languages of one side than in the others', each
    language counting alike. How often a bit is right for a language on the sample is what it counts when decoding.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(draw < share[F.col("lang")])
    found = chosen.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table, place = np.zeros((len(languages), BUCKETS)), {k: i for i, k in enumerate(languages)}
    for row in found.toLocalIterator():
        table[place[row["lang"]], row["bucket"]] = row["n"]
    rate = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        yes, no = rate[code[:, bit] > 0], rate[code[:, bit] < 0]
        weights[:, bit] = np.log(yes.mean(axis=0)) - (np.log(no.mean(axis=0)) if len(no) else np.log(1 / BUCKETS))
    trust = np.full(code.shape, 1 / code.shape[1])
    model = Model(languages, code, weights, trust)

    def rightness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            margins, langs = model.margins(batch["text"].to_pylist()), batch["lang"].to_pylist()
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "margins": pa.array(list(margins), pa.list_(pa.float64()))})

    judged = chosen.mapInArrow(rightness, "lang string, margins array<double>")
    bits = [F.avg((F.col("margins")[i] > 0).cast("double")).alias(f"right{i}") for i in range(code.shape[1])]
    size = [F.avg(F.abs(F.col("margins")[i])).alias(f"size{i}") for i in range(code.shape[1])]
    sizes = np.ones(code.shape)
    for row in judged.groupBy("lang").agg(*bits, *size).collect():
        k = place[row["lang"]]
        for i in range(code.shape[1]):
            up = row[f"right{i}"]
            trust[k, i] = max(up if code[k, i] > 0 else 1 - up, 1e-3)
            sizes[k, i] = row[f"size{i}"] or 0.0
    trust /= trust.sum(axis=1, keepdims=True)
    # Margins are means over n-grams; the usual margin of the sample is taken as a clear one.
    scale = 3.0 / max(float(np.median(sizes)), 1e-6)
    return Model(languages, code, weights.astype(np.float32), trust, scale)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text.

    lang_pred is `und` with score 0 where the text is null, empty or without a letter, or where nothing was learned.
    Equal texts get equal answers; a tie between languages goes to the first by name. Only the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = batch["text"].to_pylist()
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if model is not None and len(texts):
                best, near, tie = model.decode(model.margins(texts))
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                score, unsure = np.where(known, near, 0.0), np.where(known, tie, True)
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"], "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure, pa.bool_()),
                }
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, whole rows, whose language is known and not ambiguous. Without a model none can be told from
    another, and all that have a letter stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            keep = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if model is not None and len(texts):
                keep &= ~model.decode(model.margins(texts))[2]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
