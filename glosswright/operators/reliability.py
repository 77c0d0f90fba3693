"""Reliability of matching rules, estimated from unlabelled texts: hits against hits by chance."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder

#: (anchor, placement, skip, plural) in order of strictness; a free anchor with initials alone is left out.
STRATEGIES = [
    (f"{a}_{p}_{s}" + ("_plural" if plural else ""), a, p, s, plural)
    for p, a, s, plural in product(("initial", "contiguous", "within"), ("start", "anywhere"), ("none", "stop", "any"), (False, True))
    if not (a == "anywhere" and p == "initial")
]
#: Words that the 'stop' strategies may pass over.
STOPS = frozenset(["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with"])


def matches(short: str, words: list[str], strategy: tuple) -> bool:
    """Whether the words from their first to their last spell the short form under a strategy."""
    _, anchor, placement, skip, plural = strategy
    s = short.lower()
    if plural and len(s) > 1 and s.endswith("s"):
        s = s[:-1]
    w = [x.lower() for x in words]
    seen = set()

    def skippable(i):
        return skip == "any" or (skip == "stop" and w[i] in STOPS)

    def go(k, i, o):  # next character k may stand in word i from offset o on, or begin a later word
        if (k, i, o) in seen:
            return False
        seen.add((k, i, o))
        if k == len(s):
            return all(skippable(j) for j in range(i + 1, len(w)))
        if o > 0 and placement != "initial":
            places = [o] if placement == "contiguous" else range(o, len(w[i]))
            for x in places:
                if x < len(w[i]) and w[i][x] == s[k] and go(k + 1, i, x + 1):
                    return True
        j = i + 1 if k or o else i
        while j < len(w):
            places = range(len(w[j])) if (k == 0 and anchor == "anywhere") or (k and placement != "initial") else [0]
            for x in places:
                if x < len(w[j]) and w[j][x] == s[k] and go(k + 1, j, x + 1):
                    return True
            if not skippable(j):
                return False
            j += 1
        return False

    return bool(s) and bool(w) and go(0, 0, 0)


def best_start(short: str, words: list[str], strategy: tuple) -> int | None:
    """The latest start whose words match."""
    return next((k for k in reversed(range(len(words))) if matches(short, words[k:], strategy)), None)


def latest_starts(short: str, words: list[str]) -> dict[str, int]:
    """best_start() of every strategy that has one, all at once.

    A start is the latest that matches when the first character stands in its word, so it is enough to know where
    first characters can stand.  Sets of places are integers, the first word in the highest bits, a free bit above
    each word: adding `full` carries into the free bit of each word that holds a place, and what is left of the
    addition tells which places of that word stand before it.
    """
    low_words = [w.lower() for w in words]
    if not all(low_words):
        return {s[0]: k for s in STRATEGIES if (k := best_start(short, words, s)) is not None}
    text = "".join(["\0" + w for w in low_words])
    full = free = first = last = stops = skipped = 0  # all places, free bits, words' first and last places, stop words
    for w in low_words:
        n = len(w)
        full, free, first, last = full << n + 1 | (1 << n) - 1, free << n + 1 | 1 << n, first << n + 1 | 1 << n - 1, last << n + 1 | 1
        stops = stops << n + 1 | ((2 << n) - 1 if w in STOPS else 0)
    size, out, places = len(text), {}, {}

    def flooded(x):  # and over the stop words before them
        return ((x & stops) + stops ^ stops | x) & last

    def ending(skip):  # places of words that only words to pass over follow
        at = last if skip == "any" else flooded(1) if skip == "stop" else 1
        return full & ~(full + at)

    def before(held, skip):  # places of the words that can stand before the next word, by its free bit
        if skip == "any":
            return full & -(held & -held)
        at = held << 1 & last
        return full & ~(full + (flooded(at) if skip == "stop" else at))

    def firsts(s, placement, skip):  # places of the first character from which all of them can follow
        r = 0
        for k in range(len(s) - 1, -1, -1):
            c = places.get(s[k])
            if c is None:
                c, at = 0, text.find(s[k]) if s[k] != "\0" else -1
                while at >= 0:
                    c, at = c | 1 << size - 1 - at, text.find(s[k], at + 1)
                places[s[k]] = c
            if k == len(s) - 1:
                r = c & ending(skip)
            else:
                total = r + full
                near = before(total & free, skip)
                if placement == "contiguous":
                    near |= r << 1 & full
                elif placement == "within":
                    near |= full & ~(r ^ total)
                r = c & near
            if placement == "initial":
                r &= first
            if not r:
                return 0
        return r

    def word(r):  # of the latest place
        return len(words) - 1 - (free & (r & -r) - 1).bit_count()

    spelled = short.lower()
    for plural in (False, True):
        s = spelled[:-1] if plural and len(spelled) > 1 and spelled.endswith("s") else spelled
        if plural and s == spelled:
            found = list(out.items())
            out |= {name + "_plural": k for name, k in found}
            break
        if not s or not firsts(s, "within", "any"):  # the most lenient rule: no other can match
            continue
        for placement in ("initial", "contiguous", "within"):
            for skip in ("none", "stop", "any"):
                r = firsts(s, placement, skip)
                for anchor, at in (("start", r & first), ("anywhere", r if placement != "initial" else 0)):
                    if at:
                        out[f"{anchor}_{placement}_{skip}" + ("_plural" if plural else "")] = word(at)
    return out


def group_of(short: Column) -> Column:
    kind = F.when(short.rlike(r"^\p{L}+$"), "al").when(short.rlike(r"^[\p{L}\p{N}]+$"), "num").otherwise("spec")
    return F.concat(kind, F.lit(":"), F.least(F.length(short), F.lit(5)).cast("string"))


def bracketed(text: Column, most: int = 30) -> Column:
    """array<struct(short, before)>: what stands in each pair of round brackets without others in it, up to `most`
    characters, and the text before it back to another bracket.  Linear in the text: it is cut at the brackets."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\(")

    def one(part: Column, i: Column) -> Column:
        short = F.regexp_extract(part, rf"^([^()]{{1,{most}}})\)", 1)
        return F.when((i > 0) & (short != ""), F.struct(F.trim(short).alias("short"), F.substring_index(F.get(parts, i - 1), ")", -1).alias("before")))

    return F.filter(F.transform(parts, one), lambda x: x.isNotNull())


def harvest(docs: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, ord, short, words): bracketed short texts and the words before them."""
    hits = docs.select("doc_id", F.posexplode(bracketed(F.col("text"))).alias("ord", "h"))
    words = F.regexp_extract_all("h.before", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    last = F.slice(words, F.greatest(F.size(words) - most + 1, F.lit(1)), most)
    return hits.select("doc_id", "ord", F.col("h.short").alias("short"), last.alias("words")).where(F.size("words") > 0)


def strategy_starts(rows: DataFrame) -> DataFrame:
    """rows (…, short, words) with `hit`, the strategies that match and their latest starts, in order of strictness; a
    kernel over one row at a time."""
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    by = [s[0] for s in STRATEGIES]

    def run(batches):
        for batch in batches:
            hits = []
            for a, b in zip(batch.column("short").to_pylist(), batch.column("words").to_pylist(), strict=True):
                found = latest_starts(a, b)
                hits.append([{"strategy": s, "start": found[s]} for s in by if s in found] if found else [])
            kind = pa.list_(pa.struct([("strategy", pa.string()), ("start", pa.int32())]))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(hits, kind)], [*names, "hit"])

    return rows.mapInArrow(run, schema + ", hit array<struct<strategy:string,start:int>>")


def strategy_hits(rows: DataFrame) -> DataFrame:
    """rows (…, short, words) with `hit`, the strategies that match."""
    return strategy_starts(rows).withColumn("hit", F.col("hit.strategy"))


def counted_hits(rows: DataFrame, n: str, hits: str) -> tuple[DataFrame, DataFrame]:
    """(grp, rows) and (grp, strategy, hits) of rows (grp, short, words), by one pass over them."""
    each = strategy_hits(rows.select("grp", "short", "words")).select("grp", F.explode(F.concat(F.array(F.lit("")), "hit")).alias("strategy"))
    counts = kept(each.groupBy("grp", "strategy").agg(F.count("*").alias("n")), "hits")  # thirty strategies, fifteen groups
    return counts.where("strategy = ''").select("grp", F.col("n").alias(n)), counts.where("strategy <> ''").select("grp", "strategy", F.col("n").alias(hits))


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder, worked out once."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def estimate(rows: DataFrame, trials: int = 3) -> DataFrame:
    """(grp, strategy, precision, support): (hits - chance) / hits, clamped to 0..1.

    Chance pairs each short form with the words of other candidates, picked by hash: the candidates meet
    those at hashed positions of a numbering by hash, an equi-join.  rows are read three times: keep them.
    """
    rows = rows.withColumn("grp", group_of(F.col("short")))
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "grp string, strategy string, precision double, support long")
    buckets = max(1, n // 4)
    windows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "short"), F.lit(buckets))).groupBy("b").agg(F.min_by("words", F.struct("doc_id", "short")).alias("other"))
    sizes, own = counted_hits(rows, "n", "support")
    tries = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("b", F.pmod(F.xxhash64("short", "doc_id", "trial"), F.lit(buckets)))
    paired = tries.join(windows, "b").where(F.col("words") != F.col("other")).select("grp", "short", F.col("other").alias("words"))
    total, lucky = counted_hits(paired, "tries", "lucky")
    out = own.join(lucky, ["grp", "strategy"], "left").join(total, "grp", "left").join(sizes, "grp")
    rate = F.coalesce(F.col("lucky") / F.col("tries"), F.lit(0.0))
    value = (F.col("support") - rate * F.col("n")) / F.col("support")
    return out.select("grp", "strategy", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("precision"), "support")


def best_alignments(rows: DataFrame, table: DataFrame, minimum: float = 0.0, support: int = 5) -> DataFrame:
    """(doc_id, short, strategy, precision): the first matching strategy by precision, strictness and name."""
    order = rows.sparkSession.createDataFrame([(s[0], k) for k, s in enumerate(STRATEGIES)], "strategy string, strictness int")
    hits = strategy_hits(rows).withColumn("grp", group_of(F.col("short"))).select("doc_id", "short", "grp", F.explode("hit").alias("strategy"))
    known = table.where((F.col("support") >= support) & (F.col("precision") >= minimum)).join(F.broadcast(order), "strategy")  # thirty strategies, fifteen groups
    first = Window.partitionBy("doc_id", "short").orderBy(F.desc("precision"), "strictness", "strategy")
    return hits.join(F.broadcast(known), ["grp", "strategy"]).withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "short", "strategy", "precision")


def long_forms(rows: DataFrame, table: DataFrame, minimum: float = 0.0) -> DataFrame:
    """(doc_id, ord, short, long): the cascade.  For each bracketed short form the first strategy by precision that
    matches says where its long form begins; none below the minimum."""
    hits = strategy_hits(rows).withColumn("grp", group_of(F.col("short")))
    order = F.array(*[F.struct(F.lit(s[0]).alias("strategy"), F.lit(k).alias("strictness")) for k, s in enumerate(STRATEGIES)])
    ranks = rows.sparkSession.range(1).select(F.explode(order).alias("o")).select("o.*")
    known = table.where((F.col("support") >= 5) & (F.col("precision") >= minimum)).join(F.broadcast(ranks), "strategy")  # thirty strategies, fifteen groups
    each = hits.select("doc_id", "ord", "short", "words", "grp", F.explode("hit").alias("strategy")).join(F.broadcast(known), ["grp", "strategy"])
    best = each.groupBy("doc_id", "ord").agg(F.min_by(F.struct("short", "words", "strategy", "precision"), F.struct(-F.col("precision"), "strictness", "strategy")).alias("b")).select("doc_id", "ord", "b.*")
    by = {s[0]: s for s in STRATEGIES}

    @F.pandas_udf("int")
    def start(short, words, strategy):
        return short.combine(words, lambda a, b: (a, b)).combine(strategy, lambda ab, s: best_start(ab[0], list(ab[1]), by[s]))

    n = F.size("words")
    return best.withColumn("at", start("short", "words", "strategy")).select("doc_id", "ord", "short", F.array_join(F.slice("words", F.col("at") + 1, n), " ").alias("long"), "strategy", "precision")


def reranked(rows: DataFrame, table: DataFrame, minimum: float = 0.0) -> DataFrame:
    """(doc_id, ord, short, long, score): of all spans before a bracket the one with the most reliable strategy that
    explains it, the shortest of equals; none whose best is below the minimum.

    The shortest span that a strategy explains begins at its latest start, so no other spans need to be tried."""
    hits = strategy_starts(rows).withColumn("grp", group_of(F.col("short"))).select("doc_id", "ord", "short", "words", "grp", F.explode("hit").alias("h"))
    spans = hits.select("doc_id", "ord", "short", "grp", F.col("h.strategy").alias("strategy"), F.slice("words", F.col("h.start") + 1, F.size("words")).alias("words"))
    scored = spans.join(F.broadcast(table.select("grp", "strategy", "precision")), ["grp", "strategy"]).where("precision > 0")  # thirty strategies, fifteen groups
    best = scored.groupBy("doc_id", "ord", "short").agg(F.min_by(F.struct("words", "precision"), F.struct(-F.col("precision"), F.size("words"))).alias("b"))
    return best.select("doc_id", "ord", "short", F.array_join("b.words", " ").alias("long"), F.col("b.precision").alias("score")).where(F.col("score") >= minimum)
