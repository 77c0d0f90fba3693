"""N-gram Jaccard join with a prefix tree.

A document's set is its distinct word shingles, as 64-bit hashes in ascending order: one global order.  Two
sets with |a & b| / |a | b| >= t share at least ceil(t * max(|a|, |b|)) members, hence at least l of the first
|a| - ceil(t |a|) + l members of a lie among the first ones of b.  So

1. each distinct set posts its first members, and members that only one set posts go;
2. sets with fewer than l posts left link with nothing; the others are read again.  Members that many of
   them hold move to the end of the global order, which again posts, drops and counts: a set now shows a
   common passage only if little else is left of it.  What remains falls into candidate components, joined
   by the posts that they share;
3. the sets of a component are stored in a prefix tree.  Each is matched against the candidates in the order
   of the tree: what two neighbouring candidates have in common is counted once, and a branch is left when
   its overlap so far and its remaining length cannot reach the bound.  Sets that are in one component of
   links already are not compared again, so a group of many near copies costs little more than a star.

Equal sets are one class, found before any pairing, by 128 bits of a digest.  A candidate component of more than BLOCK sets is cut
into blocks, and each pair of blocks is joined by a task of its own: memory is bounded and nothing is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, partitions, small_batches, text_bytes, written
from .shingles import blocks, shingle_hashes, word_hashes

#: Bytes of a set's digest that name it among the posts.
NAME = 8
#: Sets that a task joins at a time: about 140 MB of texts and hashes at 550 shingles a set.
BLOCK = 20_000
#: Members held by so many candidate sets come last in the order; at most FREQUENT of them, the commonest.
COMMON, FREQUENT = 32, 1 << 20


def needed(n: int, percent: int) -> int:
    """ceil(percent * n / 100): members that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """How many common members the prefixes must show."""
    return 1 + n // 10


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + extra(n) if n else 0


def distinct_sets(texts: list[bytes | None], k: int):
    """The ascending distinct shingle hashes of each text."""
    for block in blocks(texts):
        flat, n = shingle_hashes(*word_hashes(block), k)
        end = np.cumsum(n)
        for hi, count in zip(end.tolist(), n.tolist(), strict=True):
            s = np.sort(flat[hi - count : hi])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if count > 1 else s


class PrefixTree:
    """The sets in the order of a depth-first walk of their prefix tree, with shared depths on demand."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in order]
        self.names = order
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.percent = percent
        self.up = np.arange(len(sets))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def matches(self, x: int, leaves: np.ndarray):
        """Those of the leaves (ascending) that link with set x."""
        own, p = self.sets[x], self.percent
        last, shared, depth = None, None, 0  # shared[d]: members of x among the first d of the last leaf
        for leaf in leaves.tolist():
            s = self.sets[leaf]
            if last is not None:
                m = min(depth, len(s), len(last))
                differ = np.flatnonzero(last[:m] != s[:m])
                m = int(differ[0]) if len(differ) else m
            else:
                m = 0
            bound = -(-p * (len(own) + len(s)) // (100 + p))
            counts = [np.zeros(1, np.int64)] if shared is None else [shared[: m + 1]]
            have = int(counts[0][-1])
            at = int(np.searchsorted(own, s[m - 1], side="right")) if m else 0
            step = 48
            while have + min(len(s) - m, len(own) - at) >= bound and m < len(s):
                part = s[m : m + step]
                place = np.searchsorted(own, part)
                hit = own[np.minimum(place, len(own) - 1)] == part
                counts.append(have + np.cumsum(hit))
                have = int(counts[-1][-1])
                m += len(part)
                at = int(np.searchsorted(own, part[-1], side="right"))
                step *= 2
            shared, last, depth = np.concatenate(counts), s, m
            if m == len(s) and have >= bound:
                yield leaf

    def links(self, sides: np.ndarray | None = None):
        """A spanning forest [(i, j)] of the links; with sides, of those that matter between the two."""
        take = [prefix_length(n, self.percent) for n in self.size.tolist()]
        member = np.concatenate([s[:k] for s, k in zip(self.sets, take, strict=True)])
        leaf = np.repeat(np.arange(len(take)), take)
        order = np.argsort(member, kind="stable")
        member, leaf = member[order], leaf[order]
        start = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
        end = np.append(start[1:], len(member))
        posts = [leaf[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True) if b - a > 1]
        out = []

        def try_(x, leaves):
            for y in self.matches(x, leaves):
                a, b = self.find(x), self.find(y)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
                    out.append((self.names[x], self.names[y]))

        # neighbours in a list of posts first: near copies fall together at once
        if posts:
            pairs = np.unique(np.concatenate([np.stack([p[:-1], p[1:]], 1) for p in posts]), axis=0)
            for x in np.unique(pairs[:, 0]).tolist():
                other = pairs[pairs[:, 0].searchsorted(x) : pairs[:, 0].searchsorted(x, "right"), 1]
                root = self.find(x)
                try_(x, np.array([y for y in other.tolist() if self.find(y) != root], np.int64))
        # then what lists still hold of different components
        by: dict[int, list[np.ndarray]] = {}
        roots = np.array([self.find(x) for x in range(len(self.sets))])
        for p in posts:
            if (roots[p] != roots[p[0]]).any():
                for x in p.tolist():
                    by.setdefault(x, []).append(p)
        low = np.array([extra(n) for n in self.size.tolist()])
        for x, lists in by.items():
            common = np.bincount(np.concatenate(lists), minlength=len(self.sets))
            other = np.flatnonzero(common >= np.minimum(low, low[x]))
            other = other[other > x]
            n = self.size[other]
            other = other[(100 * np.minimum(n, self.size[x]) >= self.percent * np.maximum(n, self.size[x]))]
            if sides is not None:
                other = other[sides[self.names[x]] != sides[[self.names[y] for y in other.tolist()]]] if len(other) else other
            root = self.find(x)
            other = np.array([y for y in other.tolist() if self.find(y) != root], np.int64)
            if len(other):
                try_(x, other)
        return out


def shingle_sets(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, digest, name, posts): posts once for each distinct set that a task meets."""

    def run(batches):
        lean()
        seen = set()
        for batch in batches:
            n, digests, names, posts = [], [], [], []
            for s in distinct_sets(batch.column("text").to_pylist(), k):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                digests.append(digest)
                names.append(int.from_bytes(digest[:NAME], "little", signed=True))
                posts.append(s[: prefix_length(len(s), percent)].view(np.int64) if len(s) and digest not in seen else None)
                seen.add(digest)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.int64()), pa.array(posts, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "name", "posts"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, name long, posts array<long>")


def shared_posts(posts: DataFrame) -> DataFrame:
    """The rows (member, name) whose member other names post as well; one neighbour is all that is held."""

    def run(batches):
        lean()
        m, x, more = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:  # the last row waits for the next batch; `more`: its member was seen before it
            m = np.concatenate([m, batch.column("member").to_numpy()])
            x = np.concatenate([x, batch.column("name").to_numpy()])
            if not len(m):
                continue
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (x[1:] != x[:-1])])
            m, x = m[new], x[new]
            like = m[1:] == m[:-1]
            keep = np.concatenate([[more], like]) | np.concatenate([like, [False]])
            out = keep[:-1]
            yield pa.record_batch([pa.array(m[:-1][out]), pa.array(x[:-1][out])], ["member", "name"])
            m, x, more = m[-1:], x[-1:], bool(keep[-1])
        if more and len(m):
            yield pa.record_batch([pa.array(m), pa.array(x)], ["member", "name"])

    dealt = posts.repartition(partitions(posts.sparkSession), "member").sortWithinPartitions("member", "name")
    return dealt.mapInArrow(run, "member long, name long")


def _hopeful(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The shared posts of sets that share enough of them."""
    low = F.floor(F.ceil(F.col("n") * percent / 100) / 10) + 1
    enough = shared.groupBy("name").agg(F.count("*").alias("c")).join(classes.select("name", "n"), "name").where(F.col("c") >= low)
    return shared.join(enough.select("name").distinct(), "name")


def common_members(texts: DataFrame, k: int) -> np.ndarray:
    """Members that many sets hold, ascending.  Tasks send what they see more than once: the sums are lower
    bounds, which only decide an order."""

    def run(batches):
        lean()
        parts = []
        for batch in batches:
            parts += distinct_sets(batch.column("text").to_pylist(), k)
            if sum(map(len, parts)) > 8_000_000:
                yield count(parts)
                parts = []
        if parts:
            yield count(parts)

    def count(parts):
        member, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.record_batch([pa.array(member[n > 1].view(np.int64)), pa.array(n[n > 1])], ["member", "n"])

    sums = texts.mapInArrow(run, "member long, n long").groupBy("member").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = sums.orderBy(F.desc("n"), "member").limit(FREQUENT).select("member").toPandas()  # bounded by FREQUENT
    return np.sort(rows["member"].to_numpy(np.int64).view(np.uint64))


def reordered_posts(texts: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """(member, name) of the first members of each set when the common ones come last."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        lean()
        late = shared.value
        for batch in batches:
            members, names = [], []
            for name, s in zip(batch.column("name").to_pylist(), distinct_sets(batch.column("text").to_pylist(), k), strict=True):
                at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
                is_late = late[at] == s if len(late) else np.zeros(len(s), bool)
                first = np.concatenate([s[~is_late], s[is_late]])[: prefix_length(len(s), percent)]
                members.append(first)
                names.append(np.full(len(first), name, np.int64))
            if members:
                yield pa.record_batch([pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(names))], ["member", "name"])

    return texts.mapInArrow(run, "member long, name long")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: link when 100 |a & b| >= percent |a | b|.

    Words are runs between ASCII white space with A-Z in lower case; a text of fewer than k words has one
    shingle, all its words.  Texts without words (null, empty, blank) have none and are their own component.
    Null identifiers take no part and get a null component; rows with equal identifiers are one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets = written(shingle_sets(docs, k, percent, id_column, text_column), "sets")
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("digest", "name", "n").agg(F.min("doc_id").alias("rep")), "classes")
    posts = sets.where("posts is not null").select(F.explode("posts").alias("member"), "name")
    # different sets that 64 bits give one name meet each other in any case: what only they share looks like one set's
    alike = written(classes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "alike")
    names = _hopeful(written(shared_posts(posts), "shared"), classes, percent).select("name").union(alike).distinct()
    reps = classes.join(names, "name")
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), text_bytes(text_column).alias("text")).join(reps, "rep")
    texts = written(texts.select("rep", "name", "digest", "n", "text"), "candidates")
    again = shared_posts(reordered_posts(texts, k, percent, common_members(texts, k)))
    left = written(_hopeful(written(again, "shared"), classes, percent), "hopeful")
    first = left.groupBy("member").agg(F.min("name").alias("first"))
    edges = left.join(first, "member").select(F.col("name").alias("a"), F.col("first").alias("b"))
    groups = components(edges).withColumnRenamed("id", "name")
    groups = groups.unionByName(alike.join(groups, "name", "left_anti").select("name", F.col("name").alias("component")))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = texts.join(groups, "name").join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    # a set goes to every pair of parts that its own belongs to: (0, 0) alone when there is one part
    other = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cast = other.select("component", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep", "text")
    dealt = cast.repartition(partitions(spark), "component", "p", "q").sortWithinPartitions("component", "p", "q", "rep")

    def join(batches):
        lean()
        now, reps, texts, sides = None, [], [], []

        def flush():
            if len(reps) < 2:
                return []
            tree = PrefixTree(list(distinct_sets(texts, k)), percent)
            side = np.array(sides) if len(set(sides)) > 1 else None
            return [(reps[i], reps[j]) for i, j in tree.links(side) if reps[i] != reps[j]]

        for batch in batches:
            out = []
            for *key, mine, rep, text in zip(*(batch.column(c).to_pylist() for c in ("component", "p", "q", "mine", "rep", "text")), strict=True):
                if key != now:
                    out += flush()
                    now, reps, texts, sides = key, [], [], []
                reps.append(rep)
                texts.append(text)
                sides.append(mine)
            yield _edges(out)
        yield _edges(flush())

    found = dealt.mapInArrow(join, "a long, b long")
    linked = components(found).withColumnRenamed("id", "rep")
    named = classes.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    whole = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that are the smallest identifier of their component; rows with a null one stay."""
    found = written(jaccard_components(docs, k, percent, id_column, text_column).where("component_id <> doc_id").select(F.col("doc_id").alias(id_column)).distinct(), "dropped")
    return docs.join(found, id_column, "left_anti")


def _edges(rows):
    return pa.record_batch([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])
