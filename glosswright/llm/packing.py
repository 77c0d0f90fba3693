"""Packing of token pieces into fixed-size sequences by minimum bin slack.

Each sequence starts with the longest piece left; a bitset subset-sum over the lengths left finds the
fullest combination for the rest.  A combination stays the fullest one while its pieces last, so it is
taken as often as they do: the plan depends on the number of pieces of each length alone (one count for
each length up to the capacity, whatever the input) and holds a few combinations for each length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import partitions, small_batches, text_bytes, written


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and end_id, cut at the capacity.

    Null and empty texts give the end id alone; repeated rows are packed each for itself.
    """

    def run(batches):
        enc, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of the given lengths (descending) with the largest sum up to room; long ones first."""
    bits, layers, mask = 1, [], (2 << room) - 1
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        k = 1
        while left > 0:
            k = min(k, left)
            layers.append((length, k, bits))
            bits |= bits << length * k & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    best, used = bits.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> best & 1:
            best -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(how often, {length: pieces})], covering all counts."""
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}
    plan = []
    while left:
        seed = next(iter(left))
        left[seed] -= 1
        used = fullest(left, [k for k, v in left.items() if v], capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The rows of pieces (doc_id, piece, length, ...) with sequence_id and offset; an empty table stays empty.

    Pieces of one length are numbered within salted groups, so that a very common length is no hot key; the
    sizes of the groups, not their rows, are summed up to a start for each.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int"))
    sizes = written(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")
    rows, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for times, used in plan_bins(counts, capacity):
        offset = 0
        for length, n in used.items():
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # a few rows for each length: bounded by the capacity
    columns = [c for c in ranked.columns if c != "rank"]
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def run(batches):
        table = shared.value
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        low = table[:, 1]
        # ranks are counted from the start of a length's rows: one ascending key for both
        width = int(low.max(initial=0)) + 1
        key = table[:, 0] * width + low
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * width + np.minimum(rank, width - 1), side="right") - 1
            assert not len(at) or (at >= first[length]).all()
            rel, n = rank - low[at], table[at, 2]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(table[at, 3] + rel // n), pa.array(table[at, 4] + rel % n * length)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    Null and empty texts are a piece with the end id alone; repeated rows and rows with one or no identifier are
    packed each for itself; pieces of equal length are interchangeable and are dealt by identifier and piece; an
    empty table has no pieces.  Other columns, whatever their names, take no part.
    """
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity, id_column, text_column), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
