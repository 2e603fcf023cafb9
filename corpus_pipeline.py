"""From raw documents to token ids: each stage is one operator, its result a Parquet table that the next one reads."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import bpe, exact_dedup, language_id, mixing
from emberwatch.llm.common import read, stored
from emberwatch.llm.jaccard_join import jaccard_components
from emberwatch.llm.queries import held_out


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or right between two languages go."""
    model = language_id.train(docs.where(~held_out(docs)))
    return language_id.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar texts."""
    found = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; one that is taken twice comes twice."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and digests of the ids and of what they decode to. A null or empty text has no
    ids; a document that the mix takes twice comes twice."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The classifier, the signatures and the draw of blocks are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
