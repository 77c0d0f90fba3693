"""Whole texts to BPE ids and back (see bpe.py for the method)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import small_batches, text_bytes


def encode_texts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, ids BINARY, decoded BINARY): ids as little-endian unsigned 32-bit integers, and their text.

    One row for each input row, in narrow tasks without a shuffle.  Null and empty texts give no ids and an
    empty text; null and repeated identifiers are carried as they are; other columns are not read.
    """

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = list(enc.encode(texts))
            back = [enc.decode(x) for x in ids] if decode else [None] * len(ids)
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.large_binary()).cast(pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, hashed where the ids are made."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            counts, a, b = [], [], []
            for ids in enc.encode(batch.column("text").to_pylist()):
                counts.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
