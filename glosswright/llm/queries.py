"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codec, embedding_dedup, exact_dedup, jaccard_join, licenses, packing, repeat_removal, token_counts, token_files, toxicity
from .common import work_path


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op2_pack_sequences(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op3_near_duplicate_vectors(spark, sf_dir):
    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_repeat_removal(spark, sf_dir):
    return repeat_removal.removal_digests(_read(spark, sf_dir, "documents"), length=50)


def op5_token_files(spark, sf_dir):
    path = work_path(spark, "tokens")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path, _path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, path)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op8_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")), cut=0.3)


def op9_bpe_round_trip(spark, sf_dir):
    return codec.round_trip_digests(_read(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"), containment=0.8)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER g AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM d WINDOW g AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL}
