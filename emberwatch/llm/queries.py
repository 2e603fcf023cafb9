"""The queries over the thirteen operators, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import (
    bpe, exact_dedup, language_id, license_scan, line_dedup, mixing, packing, spelling, token_store,
    turn_repair, warc_pages,
)
from emberwatch.llm.common import read
from emberwatch.llm.embedding_dedup import near_duplicates
from emberwatch.llm.jaccard_join import jaccard_components
from emberwatch.session import shared_folder

#: Of four folds of documents by crc32(doc_id), the one that nothing is learned from.
HELD_OUT = 2


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == HELD_OUT, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(docs)))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc_pages.register(spark)
    folder = shared_folder(spark, "warc")
    warc_pages.archive(read(spark, sf_dir, "pages"), folder)
    return warc_pages.read_back(spark, folder)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest, keys = token_store.tokenise_to_files(read(spark, sf_dir, "documents"), path)
    return token_store.lookup(keys, manifest).drop("nth")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(read(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(spelling.counted_words(read(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pieces(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return packing.place(found).withColumn("length", F.col("length").cast("long")).drop("row")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_license_scan, op3_exact_dedup, op4_source_mix, op5_jaccard_join, op6_warc,
        op7_token_files, op8_line_dedup, op9_embedding_dedup, op10_bpe,
        op11_turn_repair, op12_spelling_variants, op13_best_fit_packing,
    )
}

SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                   length(coalesce(text, '')) AS points
            FROM documents
        ), k AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM k
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS grams
            FROM w
        ), g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        n AS (SELECT doc_id, len(grams) AS n FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
            WHERE 100 * common >= 75 * (x.n + y.n - common)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n
            UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        )
        SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id
        FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, pos, line, translate(
                regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (
            SELECT k.doc_id, pos, line, coalesce(k.doc_id <> o.owner, FALSE) AS gone FROM k LEFT JOIN o USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op9_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        ), u AS (
            SELECT vec_id, e FROM v
            WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        d AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT c.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN d USING (vec_id)
    """,
}
