"""Token files: blocks of frequency-ranked ids in byte-aligned codes, control bytes kept apart.

A block holds the ids of consecutive documents.  Its header is the list of its distinct ids, the most
frequent first; an id is stored as its place there in one to four bytes, and a separate stream holds two
bits for each value, four values to the byte, that say how many.  A table with a row for each of the 256
control bytes gives the widths of four values at a time when reading.  Blocks are rows of Parquet files,
so Spark's commit protocol keeps them whole when tasks are repeated.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import partitions, small_batches, text_bytes

BLOCK_SCHEMA = "shard int, block int, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, ids_by_rank binary, control binary, data binary"
WIDTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by rank, control bytes, data bytes) of an array of unsigned 32-bit ids."""
    n = np.bincount(ids)  # as long as the vocabulary
    known = np.flatnonzero(n)
    known = known[np.argsort(-n[known], kind="stable")]
    rank = np.zeros(len(n), np.uint32)
    rank[known] = np.arange(len(known), dtype=np.uint32)
    values = rank[ids].astype("<u4")
    width = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(width)] = width - 1
    control = four.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return known.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ids(n: int, ids_by_rank: bytes, control: bytes, data: bytes) -> np.ndarray:
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(width) - width
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    values = raw[at].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        values[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ids_by_rank, "<u4")[values]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", block_ids: int = 1 << 20) -> None:
    """Write the ids of all texts, each followed by end_id, in ascending order of the identifier.

    Null and empty texts give the end id alone; null identifiers come first; rows with equal identifiers
    follow each other in the order of their texts.  A task holds one block at a time.
    """

    def run(batches):
        enc, end, shard = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes(), TaskContext.get().partitionId()
        docs_, parts, size, block = [], [], 0, 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            known, control, data = pack_ids(ids)
            lengths = np.array([len(p) // 4 for p in parts], "<i8")
            names = np.array([d or 0 for d in docs_], "<i8")
            nulls = np.array([d is None for d in docs_], np.uint8)
            row = [shard, block, len(ids), names.tobytes(), nulls.tobytes(), lengths.tobytes(), known, control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                docs_.append(doc)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= block_ids:
                    yield flush()
                    docs_, parts, size, block = [], [], 0, block + 1
        if parts:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded from them."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["n_ids"], row["ids_by_rank"], row["control"], row["data"]).astype("<u4")
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                names, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
                end = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(end.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                yield pa.record_batch([pa.array(names, mask=nulls), pa.array(end - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])

    rows = blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int")
    heads = blocks.select("shard", "block", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = heads.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start")).join(shards, "shard")
    return rows.join(base, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("block_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
