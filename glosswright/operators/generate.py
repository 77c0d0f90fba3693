"""Forward generation of acronyms from phrases, and their scores.

A phrase is an array of structs (text, letters, critical).  States grow by one fold over the tokens inside
the JVM; everything after it - filters, the best alignment of each acronym, scores, ranks - is relational.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phonetics import BigramModel, has_vowel, phi, pronounceability

INITIAL, INTERNAL, CONTIGUOUS, UNMAPPED = 10.0, 3.0, 2.0, 4.0


@dataclass(frozen=True)
class Weights:
    alpha: float
    beta: float
    gamma: float
    delta: float
    length_penalty: float
    preferred_length: int


#: The published presets.
PRESETS = {
    "strict_initialism": Weights(1, 0.25, 2, 25, 8, 2),
    "balanced_pronounceable": Weights(1, 1, 12, 15, 6, 2),
    "max_pronounceable": Weights(1, 4, 18, 6, 2, 3),
    "dictionary_backronym": Weights(1, 1, 60, 22, 3, 3),
}
#: States a phrase may have before it is left to a beam of that width.
NODES, BEAM = 50_000, 250


def lendable(t: Column, cap: int) -> Column:
    """How many letters a token may lend: 1..cap of them, an atomic one all or none."""
    n = F.length(t["letters"])
    return F.when(t["atomic"] & (n > 0), F.array(n)).otherwise(F.filter(F.sequence(F.lit(1), F.lit(cap)), lambda k: k <= n))


def states(tokens: Column, cap: int, longest: int, beam: int | None = None, weights: Weights | None = None, skipping: bool = True) -> Column:
    """array<struct(chars, takes)>: each token is skipped or lends some of its first letters."""
    empty = F.array(F.struct(F.lit("").alias("chars"), F.array().cast("array<int>").alias("takes")))

    def grow(sofar: Column, t: Column) -> Column:
        def each(s: Column) -> Column:
            skip = F.array(F.struct(s["chars"].alias("chars"), F.concat(s["takes"], F.array(F.lit(0))).alias("takes")))
            add = F.transform(lendable(t, cap), lambda k: F.struct(F.concat(s["chars"], F.substr(t["letters"], F.lit(1), k)).alias("chars"), F.concat(s["takes"], F.array(k)).alias("takes")))
            every = F.concat(skip, add) if skipping else F.when(F.size(lendable(t, cap)) > 0, add).otherwise(skip)
            return F.filter(every, lambda x: F.length(x["chars"]) <= longest)

        out = F.flatten(F.transform(sofar, each))
        return best_states(out, tokens, longest, beam, weights) if beam else out

    return F.aggregate(tokens, empty, grow)


def completions(longest: int, weights: Weights) -> Column:
    """By tokens left (at most longest) and characters so far: the most that the rest can add to a score."""
    table = []
    for left in range(longest + 1):
        row = []
        for length in range(longest + 1):
            gains = [0.0]
            for added in range(1, longest - length + 1) if left else ():
                over = max(0, length + added - weights.preferred_length) - max(0, length - weights.preferred_length)
                initials = min(added, left)
                gain = max(INITIAL + (added - 1) * CONTIGUOUS, initials * INITIAL + (added - initials) * CONTIGUOUS)
                gains.append(weights.alpha * gain - weights.length_penalty * over)
            row.append(max(gains))
        table.append(F.array(*(F.lit(float(x)) for x in row)))
    return F.array(*table)


def best_states(found: Column, tokens: Column, longest: int, beam: int, weights: Weights) -> Column:
    """The best alignment of each chars value, then the `beam` states with the highest bound on their score.

    The bound charges what is settled exactly and adds the most that the tokens left can give, so no state is cut
    for one that cannot beat it.
    """
    table = completions(longest, weights)

    def measured(x: Column) -> Column:
        taken = F.size(F.filter(x["takes"], lambda k: k > 0))
        loss = F.size(F.filter(x["takes"], lambda k, i: (k == 0) & F.get(tokens, i)["critical"]))
        positional = taken * INITIAL + (F.length(x["chars"]) - taken) * CONTIGUOUS
        return F.struct(x["chars"].alias("chars"), (weights.delta * loss - weights.alpha * positional).alias("v"), (-taken).alias("t"), loss.alias("l"), F.transform(x["takes"], lambda k: -k).alias("k"))

    def first(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (x["chars"] != F.coalesce(F.get(a, i - 1)["chars"], F.lit(""))))

    def bounded(x: Column) -> Column:
        length = F.length(x["chars"])
        left = F.least(F.size(tokens) - F.size(x["k"]), F.lit(longest))
        bound = F.get(F.get(table, left), length) - x["v"] - weights.length_penalty * F.greatest(length - weights.preferred_length, F.lit(0))
        takes = F.transform(x["k"], lambda k: -k)
        return F.struct((-bound).alias("a"), length.alias("b"), x["chars"].alias("chars"), takes.alias("takes"))

    ordered = F.array_sort(F.transform(found, measured))
    distinct = F.flatten(F.transform(F.array(ordered), first))  # a lambda's variable is worked out once
    kept = F.slice(F.array_sort(F.transform(distinct, bounded)), 1, beam)
    return F.transform(kept, lambda x: F.struct(x["chars"].alias("chars"), x["takes"].alias("takes")))


def _atomic(phrases: DataFrame) -> DataFrame:
    """phrases whose tokens all say whether they are atomic."""
    if "atomic" in phrases.schema["tokens"].dataType.elementType.fieldNames():
        return phrases
    return phrases.withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), t["letters"].alias("letters"), t["critical"].alias("critical"), F.lit(False).alias("atomic"))))


def search_size(tokens: Column, cap: int, skipping: bool = True) -> Column:
    """Partial states of a full search, round by round: an upper bound of what it evaluates."""
    start = F.struct(F.lit(1.0).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, t: Column) -> Column:
        now = a["last"] * (F.size(lendable(t, cap)) + int(skipping))
        return F.struct(now.alias("last"), (a["sum"] + now).alias("sum"))

    return F.aggregate(tokens, start, step)["sum"]


def candidates(phrases: DataFrame, weights: Weights, cap: int = 2, shortest: int = 2, longest: int = 6, skipping: bool = True) -> DataFrame:
    """(id, acronym, positional, loss, taken, takes, evaluated, truncated): the best alignment of each acronym of each (id, tokens).

    Phrases whose states could exceed NODES are searched with a beam and are marked as truncated; `evaluated`
    is the size of the search, NODES at most.  The plain initialism is a candidate in any case.
    """
    phrases = _atomic(phrases).withColumn("size", search_size(F.col("tokens"), cap, skipping))
    plain = F.array(plain_state(F.col("tokens"), longest))
    full = phrases.where(F.col("size") <= NODES).withColumn("s", F.explode(F.concat(states(F.col("tokens"), cap, longest, skipping=skipping), plain)))
    beam = phrases.where(F.col("size") > NODES).withColumn("s", F.explode(F.concat(states(F.col("tokens"), cap, longest, BEAM, weights, skipping), plain)))
    rows = full.unionByName(beam).select("id", "tokens", "size", F.col("s.chars").alias("acronym"), F.col("s.takes").alias("takes")).where(F.length("acronym").between(shortest, longest))
    taken = F.size(F.filter("takes", lambda k: k > 0))
    loss = F.size(F.filter(F.zip_with("tokens", "takes", lambda t, k: t["critical"] & (k == 0)), lambda x: x))
    rows = rows.withColumn("taken", taken).withColumn("loss", loss).withColumn("positional", F.col("taken") * INITIAL + (F.length("acronym") - F.col("taken")) * CONTIGUOUS)
    value = weights.delta * F.col("loss") - weights.alpha * F.col("positional")
    key = F.struct(value.alias("v"), (-F.col("taken")).alias("t"), F.col("loss"), F.transform("takes", lambda k: -k).alias("k"))
    best = rows.groupBy("id", "acronym").agg(F.min_by(F.struct("positional", "loss", "taken", "takes", "size"), key).alias("b"))
    return best.select("id", "acronym", "b.positional", "b.loss", "b.taken", "b.takes", F.least("b.size", F.lit(float(NODES))).cast("long").alias("evaluated"), (F.col("b.size") > NODES).alias("truncated"))


def with_scores(rows: DataFrame, weights: Weights, model: BigramModel, lexicon: DataFrame) -> DataFrame:
    """rows (id, acronym, positional, loss, ...) with phi, lexical and score.  Sounds are worked out once for each acronym."""
    words = lexicon.select(F.col("word").alias("_w"), F.lit(1.0).alias("_hit"))
    known = rows.select("acronym").distinct().withColumn("phi", phi(F.col("acronym"), model))
    known = known.join(words, F.lower("acronym") == F.col("_w"), "left").select("acronym", "phi", F.coalesce("_hit", F.lit(0.0)).alias("lexical"))
    over = F.greatest(F.length("acronym") - weights.preferred_length, F.lit(0))
    return rows.join(known, "acronym").withColumn("score", weights.alpha * F.col("positional") + weights.beta * F.col("phi") + weights.gamma * F.col("lexical") - weights.delta * F.col("loss") - weights.length_penalty * over)


def filtered(rows: DataFrame, vowel: bool = False, word: bool = False) -> DataFrame:
    """Scored rows that have a vowel, and that are words of the lexicon."""
    if vowel:
        rows = rows.where(has_vowel(F.col("acronym")))
    return rows.where("lexical >= 1") if word else rows


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rank within a phrase: score (to 9 places) down, length up, text up; with a limit, the best ones.

    Ranks are per phrase: no window spans phrases, and the limit reaches the sort as a group limit.
    """
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), F.length("acronym"), "acronym")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= limit) if limit else rows


def limited(rows: DataFrame, plain: DataFrame, limit: int) -> DataFrame:
    """Ranked rows up to a limit; with a limit over one, the last place goes to the plain initialism (id, acronym) if it ranks below."""
    kept = rows.where(F.col("rank") <= limit)
    if limit < 2:
        return kept
    late = rows.join(plain.select("id", "acronym"), ["id", "acronym"], "left_semi").where(F.col("rank") > limit).select("id", F.struct(*rows.columns).alias("late"))
    both = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*rows.columns).alias("row")))).alias("rows")).join(late, "id", "left")  # at most `limit` a phrase
    rows_ = F.transform("rows", lambda x: x["row"])
    chosen = F.when(F.col("late").isNull(), rows_).otherwise(F.concat(F.slice(rows_, 1, limit - 1), F.array("late")))
    return both.select(F.posexplode(chosen).alias("place", "r")).select("r.*", "place").withColumn("rank", F.col("place") + 1).drop("place").select(*rows.columns)


def plain_state(tokens: Column, longest: int = 6) -> Column:
    """struct(chars, takes): the first letter of each token, an atomic one whole, while they fit; what does not is skipped."""
    start = F.struct(F.lit("").alias("chars"), F.array().cast("array<int>").alias("takes"))

    def step(a: Column, t: Column) -> Column:
        piece = F.when(t["atomic"], t["letters"]).otherwise(F.substring(t["letters"], 1, 1))
        fits = F.length(a["chars"]) + F.length(piece) <= longest
        return F.struct(F.when(fits, F.concat(a["chars"], piece)).otherwise(a["chars"]).alias("chars"), F.concat(a["takes"], F.array(F.when(fits, F.length(piece)).otherwise(F.lit(0)))).alias("takes"))

    return F.aggregate(tokens, start, step)


def plain_initialism(phrases: DataFrame, longest: int = 6) -> DataFrame:
    """(id, acronym) of (id, tokens)."""
    return _atomic(phrases).select("id", plain_state(F.col("tokens"), longest)["chars"].alias("acronym"))


def assignments(takes: Column) -> Column:
    """array<struct(token_index, char_offset)> of the letters that tokens lend."""
    return F.flatten(F.transform(takes, lambda k, i: F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(i.alias("token_index"), o.alias("char_offset")))).otherwise(F.array().cast("array<struct<token_index:int,char_offset:int>>"))))


def mappings(acronym: Column, assigned: Column) -> Column:
    """array<struct(character, position, token_index, char_offset, kind, weight)> of one assignment a letter.

    Without a token: unmapped; at offset 0: initial; right after the letter before on the same token:
    contiguous; else internal.  An unmapped letter breaks a contiguous run.
    """

    def one(x: Column, i: Column) -> Column:
        last = F.when(i > 0, F.get(assigned, i - 1))
        runs = (last["token_index"] == x["token_index"]) & (x["char_offset"] == last["char_offset"] + 1)
        kind = F.when(x["token_index"].isNull(), "unmapped").when(x["char_offset"] == 0, "initial").when(runs, "contiguous").otherwise("internal")
        weight = F.when(kind == "initial", INITIAL).when(kind == "contiguous", CONTIGUOUS).when(kind == "internal", INTERNAL).otherwise(0.0)
        return F.struct(F.substr(acronym, i + 1, F.lit(1)).alias("character"), i.alias("position"), x["token_index"].alias("token_index"), x["char_offset"].alias("char_offset"), kind.alias("kind"), weight.alias("weight"))

    return F.transform(assigned, one)


def positional(mapped: Column) -> Column:
    """The weights of the mappings, less a penalty for each unmapped letter."""
    return F.aggregate(mapped, F.lit(0.0), lambda a, m: a + m["weight"] - F.when(m["kind"] == "unmapped", UNMAPPED).otherwise(0.0))


def phrases_of(tokenized: DataFrame) -> DataFrame:
    """(id, tokens) for candidates() of tokenize()'s rows: eligible tokens, acronyms atomic, in order.

    `index` is the token's place in the text.  Phrases without eligible tokens have an empty array.
    """
    kept = F.filter("tokens", lambda t: t["eligible"] & (t["letters"] != ""))
    return tokenized.select("id", "text", F.size("tokens").alias("n_tokens"), F.transform(kept, lambda t: F.struct(t["text"].alias("text"), t["letters"].alias("letters"), t["critical"].alias("critical"), (t["role"] == "acronym").alias("atomic"), t["index"].alias("index"))).alias("tokens"))


@dataclass(frozen=True)
class Search:
    """The shape of a search; each phrase returns `limit` candidates."""

    cap: int = 2
    shortest: int = 2
    longest: int = 6
    limit: int = 25
    skipping: bool = True
    vowel: bool = False
    word: bool = False


def generate(tokenized: DataFrame, weights: Weights, model: BigramModel, lexicon: DataFrame, search: Search = Search()) -> DataFrame:
    """(id, ok, error_type, error, evaluated, truncated, candidates): one row for each row of tokenize(), none lost.

    A candidate has acronym, score, rank, is_word, pronounceability, phi, mappings, covered and skipped token
    indexes.  error_type is empty_phrase (no token), no_candidate (no eligible token, or all were filtered).
    """
    phrases = phrases_of(tokenized)
    some = phrases.where(F.size("tokens") > 0).select("id", "tokens")
    found = candidates(some, weights, search.cap, search.shortest, search.longest, search.skipping)
    rows = ranked(filtered(with_scores(found, weights, model, lexicon), search.vowel, search.word))
    rows = limited(rows, plain_initialism(some, search.longest), search.limit).join(some, "id")
    place = F.transform(assignments(F.col("takes")), lambda x: F.struct(F.get(F.col("tokens"), x["token_index"])["index"].alias("token_index"), x["char_offset"].alias("char_offset")))
    covered = F.transform(F.filter(F.zip_with("tokens", "takes", lambda t, k: F.struct(t["index"].alias("i"), k.alias("k"))), lambda x: x["k"] > 0), lambda x: x["i"])
    rows = rows.withColumn("covered", covered).withColumn("skipped", F.array_except(F.transform("tokens", lambda t: t["index"]), "covered"))
    one = F.struct("rank", "acronym", "score", (F.col("lexical") >= 1).alias("is_word"), pronounceability(F.col("acronym"), model).alias("pronounceability"), "phi", mappings(F.col("acronym"), place).alias("mappings"), "covered", "skipped")
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("candidates"), F.max("evaluated").alias("evaluated"), F.bool_or("truncated").alias("truncated"))
    out = phrases.join(per, "id", "left")
    failed = F.col("candidates").isNull()
    kind = F.when(F.col("n_tokens") == 0, "empty_phrase").when(failed, "no_candidate")
    reasons = [f"no acronym of length {search.shortest}-{search.longest}"]
    reasons += ["a dictionary word is required"] * search.word + ["a vowel is required"] * search.vowel + ["no token may be skipped"] * (not search.skipping)
    why = F.when(F.col("n_tokens") == 0, "the phrase has no tokens").when(F.size("tokens") == 0, "no eligible tokens").when(failed, "; ".join(reasons))
    return out.select("id", (~failed).alias("ok"), kind.alias("error_type"), why.alias("error"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "candidates")


def explain(w: Weights) -> Column:
    return F.format_string(f"%.1f*{w.alpha:g} + %.3f*{w.beta:g} + %.0f*{w.gamma:g} - %d*{w.delta:g} - {w.length_penalty:g}*%d = %.3f", "positional", "phi", "lexical", "loss", F.greatest(F.length("acronym") - w.preferred_length, F.lit(0)), "score")


def synthesize(targets: DataFrame, lexicon: DataFrame, turns: int) -> DataFrame:
    """(id, turn, pos, word): for each letter of a target, word number `turn` of its bucket, round robin.

    Buckets are the words by first letter: 3-12 characters first, then shorter, then by text.  Targets meet
    the ranked words by letter and number, an equi-join.
    """
    odd = ~F.length("word").between(3, 12)
    order = Window.partitionBy("letter").orderBy(odd.cast("int"), F.length("word"), "word")
    words = lexicon.select("word", F.upper(F.substring("word", 1, 1)).alias("letter"))
    sizes = words.groupBy("letter").agg(F.count("*").alias("size"))
    top = words.withColumn("number", F.row_number().over(order) - 1).where(F.col("number") < turns)
    letters = targets.select("id", F.posexplode(F.split(F.upper(F.regexp_replace("target", r"[^\p{L}\p{N}]", "")), "")).alias("pos", "letter")).where("letter <> ''")
    want = letters.join(F.broadcast(sizes), "letter").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("number", F.col("turn") % F.col("size"))  # sizes: one row a letter
    return want.join(top, ["letter", "number"]).select("id", "turn", "pos", "word")
