"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected to eight random dimensions and decoded to the nearest point of the scaled E8
lattice, in several tables.  A vector is at home in its cell and also visits the nearest neighbouring cells;
pairs that meet are verified by cosine in double precision.  With the defaults a pair at cosine 0.93 meets
in one table with probability 0.936 and in one of three with 0.9997 (simulated on random unit vectors).

Pairs are never rows: a cell yields a number of links for each vector and a spanning forest of the links.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, written
from .shingles import mix

SCALE, PROBES, TABLES, SEED = 0.55, 12, 3, 20240607
#: Vectors at home in a cell that one task compares with the cell's visitors at a time.
BLOCK = 1024


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) and half-integers with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.round(x)
    off = x - near
    worst, row = np.abs(off).argmax(1), np.arange(len(x))
    other = near.copy()
    other[row, worst] += np.where(off[row, worst] >= 0, 1, -1)
    return np.where((near.sum(1) % 2 != 0)[:, None], other, near)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def projections(dims: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(SEED))
    wide = max(dims, 8)
    return np.stack([np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dims] for _ in range(TABLES)]) * np.sqrt(dims / 8)


def _cell(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    doubled = np.round(points * 2).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = mix(label.astype(np.int64).view(np.uint64) * np.uint64(31) + np.uint64(table + 1))
        for k in range(8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + doubled[:, k])
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(n, TABLES, 1 + PROBES) cell keys; the first of a table is the home cell."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    if not len(unit):
        return out
    short = shortest_vectors()
    for t, p in enumerate(projections(unit.shape[1])):
        y = unit @ p / SCALE
        home = nearest_e8(y)
        near = np.argsort(-((y - home) @ short.T), axis=1, kind="stable")[:, :PROBES]
        out[:, t, 0] = _cell(home, t, label)
        for k in range(PROBES):
            out[:, t, 1 + k] = _cell(home + short[near[:, k]], t, label)
    return out


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # no overflow in the squares
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _links(a, b, threshold, table, same):
    """Index pairs (i, j) of linked vectors that this meeting of a (at home) and b has to count."""
    i, j = np.nonzero(a["unit"] @ b["unit"].T >= threshold)
    keep = a["id"][i] < b["id"][j] if same else a["id"][i] != b["id"][j]
    i, j = i[keep], j[keep]
    out = np.ones(len(i), bool)
    for lo in range(0, len(i), 4096):  # the cells of many pairs at a time are large
        x, y = a["cells"][i[lo : lo + 4096]], b["cells"][j[lo : lo + 4096]]
        visits_y = (y[:, :, :1] == x).any(2)  # x is at home in or visits the home of y, by table
        visits_x = (x[:, :, :1] == y).any(2)
        earlier = (visits_x | visits_y)[:, :table].any(1)
        twice = visits_y[:, table] & (b["id"][j[lo : lo + 4096]] < a["id"][i[lo : lo + 4096]]) & (not same)
        out[lo : lo + 4096] = ~(earlier | twice)
    return i[out], j[out]


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x):
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            return (max(x, y), min(x, y))
        return None


def vector_classes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, DataFrame]:
    """(members, classes): equal vectors of a label are one class, named by its smallest identifier."""
    v = F.col(vector_column).cast("array<double>")
    usable = F.col(label_column).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    members = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable")).withColumn("usable", F.col("usable") & F.col("vec_id").isNotNull())
    classes = members.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))
    return members, classes


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared within equal, non-null labels and equal lengths.  Null vectors, zero vectors and
    those that hold null or non-finite components, and rows without an identifier, have no links and are
    their own component.  Equal vectors are linked with each other.  Identifiers are expected to be unique;
    rows with a repeated one count each as a vector.
    """
    spark = vectors.sparkSession
    members, classes = vector_classes(vectors, id_column, vector_column, label_column)
    classes = written(classes, "vector-classes")

    def meet(batches):
        for batch in batches:
            for part in _by_length(batch):
                unit, label = _unit(part.column("v")), part.column("label").to_numpy()
                keys = cells(unit, label * 1024 + unit.shape[1])
                n, per = len(part), TABLES * (1 + PROBES)
                yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)), pa.array(np.tile(np.arange(1 + PROBES) > 0, n * TABLES)), pa.array(np.repeat(part.column("cid").to_numpy(), per))], ["cell", "t", "visit", "cid"])

    keys = written(classes.mapInArrow(meet, "cell long, t int, visit boolean, cid long"), "cells")
    busy = keys.groupBy("cell").agg(F.sum(F.expr("if(visit, 0, 1)")).alias("homes"), F.count("*").alias("total")).where("homes > 0 and total > 1").select("cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("parts"))
    rows = keys.join(busy, "cell")
    # a large cell's homes are dealt over parts; everything in the cell passes by each part
    homes = rows.where("not visit").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
    passing = rows.where("visit or parts > 1").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("side", F.lit(1))
    both = homes.unionByName(passing).join(classes.select("cid", "v", "n", "label"), "cid")
    dealt = both.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "side", "cid")

    def verify(batches):
        now, a, forest = None, None, _Forest()

        def count(x, i, y, j):
            np.add.at(x["links"], i, y["n"][j])
            np.add.at(y["links"], j, x["n"][i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                edge = forest.link(int(x["id"][p]), int(y["id"][q]))
                if edge:
                    edges.append(edge)

        for batch in batches:
            cell, part, side = (batch.column(c).to_numpy() for c in ("cell", "part", "side"))
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            out, edges = {}, []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
                if lo == hi:
                    continue
                b = batch.slice(lo, hi - lo)
                unit = _unit(b.column("v"))
                x = {"id": b.column("cid").to_numpy(), "n": b.column("n").to_numpy(), "unit": unit, "cells": cells(unit, b.column("label").to_numpy() * 1024 + unit.shape[1]), "visit": b.column("visit").to_numpy(zero_copy_only=False), "links": np.zeros(hi - lo, np.int64)}
                table, key = int(b.column("t")[0].as_py()), (int(cell[lo]), int(part[lo]))
                if key != now:
                    now, a, forest = key, None, _Forest()
                if side[lo] == 0:
                    if a is not None:  # the homes came in two batches
                        i, j = _across(a, x, threshold, table)
                        count(a, i, x, j)
                    i, j = _links(x, x, threshold, table, True)
                    count(x, i, x, j)
                    _add(out, x)
                    if a is not None:
                        _add(out, a)
                        a["links"][:] = 0
                        x = {k: np.concatenate([a[k], x[k]]) for k in x}
                    x["links"] = np.zeros(len(x["id"]), np.int64)
                    a = x
                    continue
                if a is None:
                    continue
                for home in (True, False):  # other parts' homes pass by as well as visitors
                    pick = np.flatnonzero(x["visit"] != home)
                    y = {k: v[pick] for k, v in x.items()}
                    if not len(pick):
                        continue
                    if home:
                        mine = np.isin(y["id"], a["id"])
                        y = {k: v[~mine] for k, v in y.items()}
                        i, j = _across(a, y, threshold, table)
                        once = a["id"][i] < y["id"][j]
                        i, j = i[once], j[once]
                    else:
                        i, j = _links(a, y, threshold, table, False)
                    count(a, i, y, j)
                    _add(out, y)
                _add(out, a)
                a["links"][:] = 0
            if out or edges:
                ids = [*out, *(e[0] for e in edges)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([*out.values(), *[0] * len(edges)], pa.int64()), pa.array([*[None] * len(out), *(e[1] for e in edges)], pa.int64())], ["cid", "links", "other"])

    found = written(dealt.mapInArrow(verify, "cid long, links long, other long"), "vector-links")
    stars = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "cid", "left").join(stars.withColumnRenamed("id", "cid"), "cid", "left")
    of_class = of_class.select("label", "v", F.col("n").alias("size"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    good = members.where("usable").join(of_class, ["label", "v"]).select("vec_id", (F.col("size") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    rest = members.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _across(a, b, threshold, table):
    """As _links for two sets that are at home in the same cell, where only an earlier table can also count."""
    i, j = np.nonzero(a["unit"] @ b["unit"].T >= threshold)
    x, y = a["cells"][i], b["cells"][j]
    new = ~((y[:, :, :1] == x).any(2) | (x[:, :, :1] == y).any(2))[:, :table].any(1)
    return i[new], j[new]


def _add(out, x):
    hit = np.flatnonzero(x["links"])
    for k, v in zip(x["id"][hit].tolist(), x["links"][hit].tolist(), strict=True):
        out[k] = out.get(k, 0) + v


def _by_length(batch):
    lengths = batch.column("v").value_lengths().to_numpy()
    for n in np.unique(lengths).tolist():
        yield batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))
