"""Exact duplicates by content sort.

Texts are normalised to bytes; tasks first merge the equal texts they see themselves, so a text that a
third of all rows share leaves each task a few times and no more.  What is left is range-partitioned by
sampled splitters and sorted within partitions by Spark's external sorter; equal texts are then adjacent,
and neighbours are compared in full.  The order is that of the first bytes, then of a digest, then of the
whole text: splitters stay small however long the texts are, and texts with a common beginning spread out.
Digests order and name texts; texts count as equal only after a comparison of all their bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, small_batches, text_bytes, written

SPACE = b" \t\n\v\f\r"
PREFIX = 16
#: Bytes of texts that a task holds back to merge equal ones.
HELD = 32 << 20
#: Groups with more than a HOT_GROUPS-th of all rows, and more than LEAST_HOT, meet their members by broadcast.
HOT_GROUPS, LEAST_HOT = 4096, 100


def _better(a, b):
    """The (code points, id) that stays: more code points, then the smaller id, null last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _content_sort(docs: DataFrame, id_column: str, text_column: str, members: bool):
    """(staged, groups): groups hold one row of each distinct text, with `rest`, the row that stays.

    staged also holds (doc_id, sha) of every row when members is set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    rest = F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("none")]))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"), F.col(text_column).isNull().alias("blank"), (F.lit(None).cast("int") if members else rest).alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()

    def stage(batches):
        lean()
        held, size, arrow = {}, 0, None

        def flush():
            return _batch([(None, sha, norm_prefix, text, blank, rest, n, *best) for sha, (norm_prefix, text, blank, rest, n, best) in held.items()], arrow)

        for batch in batches:
            arrow = batch.schema.field("rest").type
            seen = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "blank", "rest"))
            for doc, text, blank, rest in zip(*columns, strict=True):
                norm = text.translate(None, SPACE)
                sha = hashlib.sha256(norm).digest()
                mine = (len(text.decode("utf-8", "replace")), doc)
                got = held.get(sha)
                if got is None:
                    held[sha] = (norm[:PREFIX], text, blank, rest, 1, mine)
                    size += len(text) + 300
                elif got[1].translate(None, SPACE) != norm:
                    raise ValueError("two texts with one SHA-256 digest")
                elif _better(got[5], mine) is mine:
                    held[sha] = (got[0], text, blank, rest, got[4] + 1, mine)
                else:
                    held[sha] = (*got[:4], got[4] + 1, got[5])
                if members:
                    seen.append((doc, sha, None, None, None, None, None, None, None))
                if size > HELD:
                    yield flush()
                    held, size = {}, 0
            if members:
                yield _batch(seen, arrow)
        if held:
            yield flush()

    staged = written(rows.mapInArrow(stage, f"doc_id long, sha binary, prefix binary, text binary, blank boolean, rest {kind}, n long, points long, best long"), "contents")
    parts = staged.where("text is not null").drop("doc_id")
    ordered = parts.repartitionByRange(partitions(spark), "prefix", "sha").sortWithinPartitions("prefix", "sha")

    def neighbours(batches):
        lean()
        now, arrow = None, None
        for batch in batches:
            arrow = batch.schema.field("rest").type
            out = []
            for sha, text, blank, rest, n, points, best in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "blank", "rest", "n", "points", "best")), strict=True):
                if now and now[0] == sha:
                    if now[1].translate(None, SPACE) != text.translate(None, SPACE):
                        raise ValueError("two texts with one SHA-256 digest")
                    n += now[4]
                    if _better(now[5], (points, best)) is now[5]:
                        now = (*now[:4], n, now[5])
                        continue
                elif now:
                    out.append(now)
                now = (sha, text, blank, rest, n, (points, best))
            yield _groups(out, arrow)
        if now:
            yield _groups([now], arrow)

    return staged, ordered.mapInArrow(neighbours, f"sha binary, text binary, blank boolean, rest {kind}, group_size long, keep_id long")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when identical without ASCII white space; null counts as empty.  Of equal texts the row
    with the most code points stays, then the smallest identifier (null last).  Every row of a repeated
    identifier counts in the group's size and is marked as the one that stays is.
    """
    staged, groups = _content_sort(docs.select(id_column, text_column), id_column, text_column, members=True)
    members = staged.where("text is null").select("doc_id", "sha")
    found = written(groups.select("sha", "keep_id", "group_size"), "groups")
    # fewer than HOT_GROUPS groups can hold that share of all rows: they are sent to all tasks, so no key of the join is hot
    share = (found.agg(F.sum("group_size")).first()[0] or 0) // HOT_GROUPS
    hot = F.broadcast(found.where(F.col("group_size") > share).where(F.col("group_size") > LEAST_HOT))
    cold = members.join(hot.select("sha"), "sha", "left_anti").join(found, "sha")
    return members.join(hot, "sha").unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One whole row of each group of equal texts, the one that stays; of repeated rows, one."""
    _, groups = _content_sort(docs, id_column, text_column, members=False)
    kind = docs.schema[id_column].dataType
    text = F.when(F.col("blank"), F.lit(None)).otherwise(F.col("text").cast("string"))
    made = {id_column: F.col("keep_id").cast(kind), text_column: text}
    return groups.select(*(made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def _batch(rows, rest):
    kinds = {"doc_id": pa.int64(), "sha": pa.binary(), "prefix": pa.binary(), "text": pa.binary(), "blank": pa.bool_(), "rest": rest, "n": pa.int64(), "points": pa.int64(), "best": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _groups(rows, rest):
    flat = [(*r[:5], r[5][1]) for r in rows]
    columns = list(zip(*flat, strict=True)) or [[]] * 6
    kinds = (pa.binary(), pa.binary(), pa.bool_(), rest, pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["sha", "text", "blank", "rest", "group_size", "keep_id"])
