"""The queries of this package: one for each operator, on its whole table, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, chosen_path_join, fuzzy_lines, piece_lattice, pu_toxicity, quality_repetition, substring_dedup, vector_approximation, warc_derivatives, wrapper_inference
from .common import Scratch, table

PACKING_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path_join.near_dedup(spark, table(spark, sf_dir, "documents"), shingle_words=2)


def op2_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_repetition.score_repetition(table(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page; texts and headers as digests."""
    responses = warc_derivatives.responses_from_pages(table(spark, sf_dir, "pages"))
    made = warc_derivatives.build_derivatives(responses, keep="source_id")
    return made.select(
        F.col("source_id").cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest",
        F.length("block").cast("long").alias("content_length"), F.sha2(F.to_json("headers"), 256).alias("headers_sha256"),
    )


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_approximation.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return out.select("query_id", "rank", "vec_id", "score")


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of ``documents``, and the text decoded from them."""
    model = piece_lattice.load_model(public_tokenizers.path(PIECE_MODEL))
    return piece_lattice.encode_and_decode(spark, table(spark, sf_dir, "documents"), model, Scratch(spark, "pieces"), outputs=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(spark, table(spark, sf_dir, "documents"), layout=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_inference.extract_main_text(spark, table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PACKING_TOKENIZER)
    return best_fit_packing.pack_documents(spark, table(spark, sf_dir, "documents"), path)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_repetition, op3_warc_derivatives, op4_exact_top_k, op5_fuzzy_line_dedup,
        op6_sentencepiece, op7_substring_dedup, op8_html_main_text, op9_toxicity, op10_best_fit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
WITH fine AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
}
