"""Queries over phrases, definitions and their evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonetics as ph
from ..functions import text as t
from ..operators import backronym as bk
from ..operators import disambiguate as dis
from ..operators import evaluate as ev
from ..operators import extract as ex
from ..operators import generate as gen
from ..operators import reliability as rel
from ..operators import tokenize as tk
from ..operators.vocabulary import literal
from .text_queries import MODEL, _docs, _lexicon, _model

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _phrases(spark, sf):
    """(id, tokens) of distinct part names with their type: three words, all critical."""
    rows = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    words = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    return rows.select("id", words.alias("words"), F.transform(words, lambda w: F.struct(w.alias("text"), F.upper(w).alias("letters"), F.lit(True).alias("critical"))).alias("tokens"))


PH = "ph AS (SELECT min(p_partkey) AS id, string_split(p_name || ' ' || lower(p_type), ' ') AS w FROM part GROUP BY p_name, p_type)"


def cand_sql(w):
    return f"""{MODEL}, {PH},
st AS (SELECT id, upper(left(w[1], a)) || upper(left(w[2], b)) || upper(left(w[3], c)) AS acronym, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS taken, [-a, -b, -c] AS k
  FROM ph, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b), (SELECT unnest([0, 1, 2]) AS c)),
sc AS (SELECT id, acronym, taken, 3 - taken AS loss, taken * 10.0 + (length(acronym) - taken) * 2.0 AS pos_gain, k FROM st WHERE length(acronym) >= 2),
bs AS (SELECT id, acronym, first(pos_gain ORDER BY {w.delta} * loss - {w.alpha} * pos_gain, -taken, loss, k) AS pos_gain, first(loss ORDER BY {w.delta} * loss - {w.alpha} * pos_gain, -taken, loss, k) AS loss FROM sc GROUP BY ALL),
ac AS (SELECT DISTINCT acronym FROM bs), fi AS (SELECT acronym, sum(coalesce(log_prob, low)) / (length(acronym) - 1) AS phi FROM ac CROSS JOIN bo, unnest(range(1, length(acronym))) AS r(i) LEFT JOIN bg ON prev = lower(acronym[i]) AND nxt = lower(acronym[i + 1]) GROUP BY acronym),
al2 AS (SELECT bs.*, phi, CASE WHEN lower(acronym) IN (SELECT word FROM lex) THEN 1.0 ELSE 0.0 END AS lexical FROM bs JOIN fi USING (acronym)),
scored AS (SELECT *, {w.alpha} * pos_gain + {w.beta} * phi + {w.gamma} * lexical - {w.delta} * loss - {w.length_penalty} * greatest(length(acronym) - {w.preferred_length}, 0) AS score FROM al2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, length(acronym), acronym) AS rank FROM scored)"""


STRICT = gen.PRESETS["strict_initialism"]


def _scored(spark, sf, weights=STRICT, model=None):
    m, lex = model or _model(spark, sf)
    return gen.with_scores(gen.candidates(_phrases(spark, sf), weights), weights, m, lex)


@query(f"WITH {PH} SELECT id, upper(w[1][1] || w[2][1] || w[3][1]) AS acronym FROM ph")
def plain_initialism(spark, sf):
    return gen.plain_initialism(_phrases(spark, sf))


@query(f"WITH {cand_sql(STRICT)} SELECT id, acronym, pos_gain AS \"positional\", loss, round(phi, 5) AS phi, lexical, round(score, 5) AS score FROM scored")
def generate_candidates(spark, sf):
    rows = _scored(spark, sf)
    return rows.select("id", "acronym", "positional", "loss", F.round("phi", 5).alias("phi"), "lexical", F.round("score", 5).alias("score"))


@query(f"WITH {cand_sql(STRICT)} SELECT id, rank, acronym FROM ranked WHERE rank <= 5")
def generate_topk(spark, sf):
    return gen.ranked(_scored(spark, sf), 5).select("id", "rank", "acronym")


@query(f"WITH {cand_sql(STRICT)} SELECT id, acronym, rank FROM ranked JOIN ph USING (id) WHERE acronym = upper(w[1][1] || w[2][1] || w[3][1])")
def score_initialism(spark, sf):
    plain = gen.plain_initialism(_phrases(spark, sf))
    return gen.ranked(_scored(spark, sf)).join(plain, ["id", "acronym"], "left_semi").select("id", "acronym", "rank")


@query(" UNION ALL ".join(f"(SELECT '{n}' AS preset, id, acronym FROM (WITH {cand_sql(w)} SELECT id, acronym FROM ranked WHERE rank = 1))" for n, w in gen.PRESETS.items()))
def presets_contrast(spark, sf):
    out, model = None, _model(spark, sf)
    for n, w in gen.PRESETS.items():
        rows = gen.ranked(_scored(spark, sf, w, model), 1).select(F.lit(n).alias("preset"), "id", "acronym")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {cand_sql(STRICT)}, g AS (SELECT ph.id, rank FROM ph LEFT JOIN ranked r ON r.id = ph.id AND r.acronym = upper(w[1][1] || w[2][1])) SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM g, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k")
def recall_at_k(spark, sf):
    gold = _phrases(spark, sf).select("id", F.upper(F.concat(F.substring(F.col("words")[0], 1, 1), F.substring(F.col("words")[1], 1, 1))).alias("acronym"))
    ranks = gold.join(gen.ranked(_scored(spark, sf)).select("id", "acronym", "rank"), ["id", "acronym"], "left")
    return ev.recall_at(ranks, [1, 3, 5, 10])


#: Well-known initialisms.
CANONICAL = [
    ("Application Programming Interface", "API"),
    ("Portable Document Format", "PDF"),
    ("National Aeronautics and Space Administration", "NASA"),
    ("Hyper Text Markup Language", "HTML"),
    ("Random Access Memory", "RAM"),
    ("Central Processing Unit", "CPU"),
    ("Graphics Processing Unit", "GPU"),
    ("Self Contained Underwater Breathing Apparatus", "SCUBA"),
    ("Light Amplification by Stimulated Emission of Radiation", "LASER"),
    ("Structured Query Language", "SQL"),
    ("Customer Relationship Management", "CRM"),
    ("Quality Assurance", "QA"),
    ("Transmission Control Protocol", "TCP"),
    ("Simple Object Access Protocol", "SOAP"),
    ("Basic Input Output System", "BIOS"),
    ("Read Only Memory", "ROM"),
]


def _canonical(spark):
    return literal(spark, [(i, p, a) for i, (p, a) in enumerate(CANONICAL)], "id int, phrase string, expected string")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', '{a}', '{a}', true)" for i, (p, a) in enumerate(CANONICAL)) + ") AS t(id, phrase, expected, acronym, hit)")
def generate_canonical(spark, sf):
    rows = _canonical(spark)
    m, lex = _model(spark, sf)
    found = gen.generate(tk.tokenize(rows, text_column="phrase"), STRICT, m, lex)
    return rows.join(found, "id").select("id", "phrase", "expected", F.col("candidates")[0]["acronym"].alias("acronym"), (F.col("candidates")[0]["acronym"] == F.col("expected")).alias("hit"))


@query(f"WITH {cand_sql(STRICT)} SELECT id, acronym, printf('%.1f*1 + %.3f*0' || '.25 + %.0f*2 - %d*25 - 8*%d = %.3f', pos_gain, phi, lexical, loss, greatest(length(acronym) - 2, 0), score) AS explanation FROM ranked WHERE rank = 1")
def score_breakdown(spark, sf):
    top = gen.ranked(_scored(spark, sf), 1)
    return top.select("id", "acronym", gen.explain(STRICT).alias("explanation"))


@query(f"WITH {cand_sql(STRICT)} SELECT id, count(*) AS candidates, 39 AS evaluated, false AS truncated, first(acronym ORDER BY rank) AS best FROM ranked WHERE rank <= 25 GROUP BY id")
def search_report(spark, sf):
    rows = gen.ranked(_scored(spark, sf), 25)
    return rows.groupBy("id").agg(F.count("*").alias("candidates"), F.max("evaluated").cast("int").alias("evaluated"), F.bool_or("truncated").alias("truncated"), F.min_by("acronym", "rank").alias("best"))


@query(f"WITH {cand_sql(STRICT)}, v AS (SELECT id, acronym, lexical, score FROM scored WHERE regexp_matches(lower(acronym), '[aeiouy]')) SELECT id, count(*) AS with_vowel, count(*) FILTER (lexical = 1) AS words FROM v GROUP BY id")
def hard_filters(spark, sf):
    rows = gen.filtered(_scored(spark, sf), vowel=True)
    return rows.groupBy("id").agg(F.count("*").alias("with_vowel"), F.count(F.when(F.col("lexical") == 1, 1)).alias("words"))


@query(f"WITH {cand_sql(STRICT)}, p AS (SELECT id, upper(w[1][1] || w[2][1] || w[3][1]) AS acronym FROM ph), q AS (SELECT r.id, r.acronym, r.rank, p.id IS NOT NULL AS plain FROM ranked r LEFT JOIN p ON p.id = r.id AND p.acronym = r.acronym) SELECT id, least(rank, 2) AS rank, acronym FROM q WHERE rank = 1 OR (rank = 2 AND id NOT IN (SELECT id FROM q WHERE plain AND rank > 2)) OR (plain AND rank > 2)")
def reserved_initialism(spark, sf):
    rows = gen.ranked(_scored(spark, sf, gen.PRESETS["strict_initialism"])).select("id", "rank", "acronym")
    return gen.limited(rows, gen.plain_initialism(_phrases(spark, sf)), 2)


@query(f"""WITH {cand_sql(STRICT)}, t AS (SELECT id, acronym, k FROM (SELECT s.id, s.acronym, first(s.k ORDER BY {STRICT.delta} * s.loss - {STRICT.alpha} * s.pos_gain, -s.taken, s.loss, s.k) AS k FROM sc s JOIN ranked r ON r.id = s.id AND r.acronym = s.acronym AND r.rank <= 3 GROUP BY ALL)),
e AS (SELECT id, acronym, unnest([0, 1, 2]) AS token, -unnest(k) AS n FROM t), l AS (SELECT id, acronym, token, unnest(range(0, n)) AS o FROM e)
SELECT id, acronym, string_agg(token || ':' || CASE WHEN o = 0 THEN 'initial' ELSE 'contiguous' END, ' ' ORDER BY token, o) AS kinds FROM l GROUP BY ALL""")
def letter_mappings(spark, sf):
    rows = gen.ranked(_scored(spark, sf), 3)
    kinds = F.transform(gen.mappings(F.col("acronym"), gen.assignments(F.col("takes"))), lambda m: F.concat(m["token_index"].cast("string"), F.lit(":"), m["kind"]))
    return rows.select("id", "acronym", F.array_join(kinds, " ").alias("kinds"))


LEXB = "bk AS (SELECT word, upper(word[1]) AS letter, row_number() OVER (PARTITION BY upper(word[1]) ORDER BY (length(word) NOT BETWEEN 3 AND 12)::INT, length(word), word) - 1 AS number, count(*) OVER (PARTITION BY upper(word[1])) AS size FROM lex)"


@query(f"WITH {MODEL}, {LEXB}, tg AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS target FROM part), lt AS (SELECT target, i - 1 AS pos, upper(target[i]) AS letter FROM tg, unnest(range(1, length(target) + 1)) AS r(i)) SELECT target AS id, turn, pos, word FROM lt, (SELECT unnest(range(0, 5)) AS turn) JOIN bk ON bk.letter = lt.letter AND bk.number = turn % bk.size")
def synthesize_backronym(spark, sf):
    targets = spark.read.parquet(f"{sf}/part.parquet").select(F.split("p_name", " ")[1].alias("target")).distinct()
    return gen.synthesize(targets.select(F.col("target").alias("id"), "target"), _lexicon(spark, sf), 5)


@query(f"WITH {MODEL}, {LEXB}, tg AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS target FROM part), lt AS (SELECT target, i - 1 AS pos, upper(target[i]) AS letter FROM tg, unnest(range(1, length(target) + 1)) AS r(i)), sy AS (SELECT target, turn, pos, word FROM lt, (SELECT unnest(range(0, 5)) AS turn) JOIN bk ON bk.letter = lt.letter AND bk.number = turn % bk.size), ex AS (SELECT target, turn, string_agg(word, ' ' ORDER BY pos) AS expansion, count(*) AS n FROM sy GROUP BY target, turn), fx AS (SELECT target, expansion, min(turn) AS turn, max(n) AS n FROM ex GROUP BY ALL), fi AS (SELECT target, sum(coalesce(log_prob, low)) / (length(target) - 1) AS phi FROM tg CROSS JOIN bo, unnest(range(1, length(target))) AS r(i) LEFT JOIN bg ON prev = lower(target[i]) AND nxt = lower(target[i + 1]) GROUP BY target), sc AS (SELECT fx.*, 10.0 * n - 4.0 * (length(target) - n) + 0.25 * phi + 2.0 * (lower(target) IN (SELECT word FROM lex))::INT - 8.0 * greatest(length(target) - 2, 0) AS score FROM fx JOIN fi USING (target)) SELECT target AS id, upper(target) AS target, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, turn) AS rank, round(score, 5) AS score, expansion, n / length(target) AS coverage FROM sc")
def score_synthesized(spark, sf):
    targets = spark.read.parquet(f"{sf}/part.parquet").select(F.split("p_name", " ")[1].alias("target")).distinct().select(F.col("target").alias("id"), "target")
    m, lex = _model(spark, sf)
    rows = bk.score_synthesized(gen.synthesize(targets, lex, 5), targets, STRICT, m, lex)
    return rows.select("id", "target", "rank", F.round("score", 5).alias("score"), "expansion", "coverage")


@query(f"WITH {cand_sql(STRICT)} SELECT s.id, s.acronym, round(score, 5) AS score, pos_gain AS \"positional\", loss FROM scored s JOIN ph ON ph.id = s.id WHERE acronym = upper(w[1][1] || w[2][1] || w[3][1])")
def score_given(spark, sf):
    m, lex = _model(spark, sf)
    rows = _phrases(spark, sf).withColumn("target", F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "."))
    rows = bk.score_given(rows.select("id", "target", "words", F.transform("words", lambda w: F.lit(True)).alias("critical")), STRICT, m, lex)
    return rows.select("id", "acronym", F.round("score", 5).alias("score"), "positional", "loss")


@query()
def align_backronym(spark, sf):
    rows = _phrases(spark, sf).withColumn("target", F.concat(F.substring(F.col("words")[0], 1, 2), F.substring(F.col("words")[2], 1, 1)))
    return bk.align_phrases(rows.select("id", "target", "words", F.transform("words", lambda w: F.lit(True)).alias("critical")), limit=3)


# definitions made from each document: the initials of k consecutive words, somewhere in it, in brackets after them
DEF = """w0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w, CAST(3 + doc_id % 2 AS INT) AS k FROM documents),
w1 AS (SELECT doc_id, w, k, CAST((doc_id * 7919) % (len(w) - k + 1) AS INT) AS a FROM w0 WHERE len(w) >= k),
df AS (SELECT doc_id, w, k, a, array_to_string(w[a + 1 : a + k], ' ') AS long, upper(array_to_string(list_transform(w[a + 1 : a + k], lambda x: x[1]), '')) AS short FROM w1)"""
#: The letters from right to left, each as near as can be, the first at the beginning of a word, within the last 2k words.
MATCHED = f"""{DEF}, wi AS (SELECT doc_id, short, reverse(array_to_string(w[greatest(1, a + k - least(length(short) + 5, 2 * length(short)) + 1) : a + k], ' ')) AS back FROM df),
fo AS (SELECT doc_id, short, reverse(rtrim(regexp_extract(back, '^.*?' || array_to_string(list_reverse(string_split(lower(short), '')), '.*?') || '( |$)'))) AS long FROM wi)"""


def _defined(spark, sf, *keep):
    """(doc_id, long, short, text, …): the words of whole documents with one definition each."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    # an exploded array of one: the words are worked out once and not in each expression that uses them
    rows = _docs(spark, sf).select("doc_id", F.explode(F.array(words)).alias("w"), (3 + F.col("doc_id") % 2).cast("int").alias("k"), *keep)
    rows = rows.where(F.size("w") >= F.col("k")).withColumn("a", ((F.col("doc_id") * 7919) % F.greatest(F.size("w") - F.col("k") + 1, F.lit(1))).cast("int"))
    chosen = F.slice("w", F.col("a") + 1, F.col("k"))
    short = F.upper(F.array_join(F.transform(chosen, lambda x: F.substring(x, 1, 1)), ""))
    head, rest = F.slice("w", F.lit(1), F.col("a") + F.col("k")), F.slice("w", F.col("a") + F.col("k") + 1, F.size("w"))
    made = F.struct(F.array_join(chosen, " ").alias("long"), short.alias("short"), F.array_join(head, " ").alias("head"), F.array_join(rest, " ").alias("rest"))
    others = [c for c in rows.columns if c not in ("doc_id", "w", "k", "a")]
    rows = rows.select("doc_id", *others, F.explode(F.array(made)).alias("m"))
    text = F.concat("m.head", F.lit(" ("), "m.short", F.lit(") "), "m.rest")
    return rows.select("doc_id", "m.long", "m.short", text.alias("text"), *others)


@query(f"WITH {MATCHED} SELECT doc_id, short, long FROM fo WHERE length(long) > length(short)")
def extract_definitions(spark, sf):
    return ex.extract_definitions(_defined(spark, sf).select("doc_id", "text")).select("doc_id", "short", "long")


@query(f"WITH {MATCHED} SELECT doc_id, short, long FROM fo WHERE length(long) > length(short)")
def first_definition_map(spark, sf):
    rows = _defined(spark, sf).select("doc_id", F.concat("text", F.lit(". "), "text").alias("text"))
    return ex.first_definitions(ex.extract_definitions(rows))


@query(f"WITH {MATCHED} SELECT fo.doc_id, t + 2 AS start, t - length(fo.long) AS long_start, t AS long_stop FROM fo JOIN (SELECT doc_id, length(array_to_string(w[1 : a + k], ' ')) AS t FROM df) USING (doc_id) WHERE length(fo.long) > length(fo.short)")
def definition_spans(spark, sf):
    return ex.extract_definitions(_defined(spark, sf).select("doc_id", "text")).select("doc_id", "start", "long_start", "long_stop")


@query(f"WITH {DEF} SELECT doc_id, length(short) BETWEEN 2 AND 10 AND regexp_matches(short, '^[A-Z0-9]') AND regexp_matches(short, '[A-Z]') AS valid FROM df")
def valid_short_form(spark, sf):
    return _defined(spark, sf).select("doc_id", ex.is_valid_short_form(F.col("short")).alias("valid"))


@query(f"WITH {DEF} SELECT doc_id, length(long) > length(short) AND length(replace(long, ' ', '')) >= length(short) AND len(string_split(long, ' ')) <= length(short) + 5 AND NOT list_contains(string_split(long, ' '), short) AS valid FROM df")
def valid_long_form(spark, sf):
    return _defined(spark, sf).select("doc_id", ex.is_valid_long_form(F.col("short"), F.col("long")).alias("valid"))


@query(f"WITH {DEF} SELECT short, count(*) AS n, count(DISTINCT long) AS n_longs FROM df GROUP BY short")
def ambiguity_sets(spark, sf):
    return _defined(spark, sf).groupBy("short").agg(F.count("*").alias("n"), F.countDistinct("long").alias("n_longs"))


FREQ = f"{DEF}, fr AS (SELECT short, long, count(*) AS n, min(doc_id) AS first_doc FROM df GROUP BY ALL), top AS (SELECT short, first(long ORDER BY n DESC, first_doc) AS predicted FROM fr GROUP BY short)"


def _most_frequent(spark, sf):
    rows = _defined(spark, sf)
    per = rows.groupBy("short", "long").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    top = per.groupBy("short").agg(F.min_by("long", F.struct(-F.col("n"), "first_doc")).alias("predicted"))
    return rows.join(top, "short").select("doc_id", "short", F.col("long").alias("gold"), "predicted")


@query(f"WITH {FREQ} SELECT doc_id, short, long AS gold, predicted FROM df JOIN top USING (short)")
def most_frequent_baseline(spark, sf):
    return _most_frequent(spark, sf)


@query(
    f"""WITH {FREQ}, p AS (SELECT long AS gold, predicted FROM df JOIN top USING (short)), g AS (SELECT gold AS c, count(*) AS g, sum((gold = predicted)::INT) AS tp FROM p GROUP BY 1), q AS (SELECT predicted AS c, count(*) AS p FROM p GROUP BY 1),
r AS (SELECT g, tp, CASE WHEN p IS NULL THEN 1.0 ELSE tp / p END AS pr, tp / g AS re FROM g LEFT JOIN q USING (c))
SELECT round(sum(tp) / sum(g), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END), 6) AS macro_f1 FROM r"""
)
def macro_scores(spark, sf):
    return ev.classes(_most_frequent(spark, sf))


@query(f"WITH {DEF} SELECT short, ord, expansion FROM (SELECT short, long AS expansion, row_number() OVER (PARTITION BY short ORDER BY min(doc_id)) - 1 AS ord FROM df GROUP BY short, long)")
def expansion_dictionary(spark, sf):
    rows = _defined(spark, sf).select(F.lit(0).alias("src"), F.col("doc_id").alias("ord"), "short", "long")
    return dis.dictionary(rows).select(F.col("key").alias("short"), "ord", "expansion")


@query()
def disambiguate(spark, sf):
    rows = _defined(spark, sf, F.coalesce("text", F.lit("")).alias("context"))
    entries = dis.dictionary(rows.select(F.lit(0).alias("src"), F.col("doc_id").alias("ord"), "short", "long"))
    instances = rows.select(F.col("doc_id").alias("instance"), F.col("short").alias("key"), "context")
    stops = [w for lang, w, _ in t.stop_rows() if lang == "en"]
    return dis.disambiguate(instances, entries, stops)


@query(f"WITH {MATCHED} SELECT doc_id AS instance, short AS key, long AS expansion, 1.0 AS score, 1 AS rank FROM fo WHERE length(long) > length(short)")
def disambiguate_by_document(spark, sf):
    rows = _defined(spark, sf).select(F.col("doc_id").alias("instance"), F.col("short").alias("key"), F.col("text").alias("context"))
    stops = [w for lang, w, _ in t.stop_rows() if lang == "en"]
    return dis.from_own_definitions(rows, stops).select("instance", "key", "expansion", "score", "rank")


SIM = "CASE WHEN a = b THEN 1.0 WHEN least(length(a), length(b)) >= greatest(4, ceil(least(length(a), length(b)) * 0.6)) AND left(a, greatest(4, ceil(least(length(a), length(b)) * 0.6))::INT) = left(b, greatest(4, ceil(least(length(a), length(b)) * 0.6))::INT) THEN 0.75 ELSE 0.5 * 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END"
BIG = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part), p AS (SELECT a.w AS a, b.w AS b, {BIG.format('a.w')} AS x, {BIG.format('b.w')} AS y FROM w a, w b) SELECT a, b, round({SIM}, 6) AS similarity FROM p")
def word_similarity(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")).alias("w")).distinct()
    all_ = words.agg(F.array_sort(F.collect_set("w")).alias("all"))  # a closed list of 22 words
    pairs = words.select(F.col("w").alias("a")).join(F.broadcast(all_), F.lit(True)).select("a", F.explode("all").alias("b"))
    return pairs.select("a", "b", F.round(dis.word_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


PRED = f"{DEF}, pr AS (SELECT doc_id, short, CASE WHEN doc_id % 3 = 0 THEN 'the ' || long WHEN doc_id % 3 = 1 THEN long ELSE left(long, 5) END AS long FROM df WHERE doc_id % 7 <> 0)"


def _predicted(spark, sf):
    third = F.col("doc_id") % 3
    return _defined(spark, sf).where("doc_id % 7 <> 0").select("doc_id", "short", F.when(third == 0, F.concat(F.lit("the "), "long")).when(third == 1, F.col("long")).otherwise(F.substring("long", 1, 5)).alias("long"))


def prf_sql(fold):
    return f"""WITH {PRED}, g AS (SELECT doc_id, short, {fold} AS f, count(*) AS g FROM df GROUP BY ALL), p AS (SELECT doc_id, short, {fold} AS f, count(*) AS p FROM pr GROUP BY ALL),
s AS (SELECT sum(least(coalesce(g, 0), coalesce(p, 0)))::BIGINT AS tp, sum(coalesce(g, 0))::BIGINT AS n_gold, sum(coalesce(p, 0))::BIGINT AS n_pred FROM g FULL JOIN p USING (doc_id, short, f))
SELECT tp, n_gold, n_pred, round(tp / n_pred, 6) AS precision, round(tp / n_gold, 6) AS recall, round(coalesce(2 * (tp / n_pred) * (tp / n_gold) / nullif(tp / n_pred + tp / n_gold, 0), 0), 6) AS f1 FROM s"""


@query(prf_sql("long"))
def prf1_exact(spark, sf):
    return ev.prf(_defined(spark, sf).select("doc_id", "short", "long"), _predicted(spark, sf), ["doc_id", "short", "long"])


@query(prf_sql("regexp_replace(lower(long), '^(the|a|an) ', '')"))
def prf1_relaxed(spark, sf):
    def fold(df):
        return df.select("doc_id", "short", ev.relaxed(F.col("long")).alias("long"))

    return ev.prf(fold(_defined(spark, sf)), fold(_predicted(spark, sf)), ["doc_id", "short", "long"])


GB = "(SELECT doc_id, long, CASE doc_id % 3 WHEN 0 THEN short WHEN 1 THEN upper(left(replace(long, ' ', ''), 2)) || short[-1] ELSE short || 'Q9' END AS s, short FROM df)"


def _twisted(spark, sf):
    third = F.col("doc_id") % 3
    short = F.when(third == 0, F.col("short")).when(third == 1, F.concat(F.upper(F.substring(F.replace("long", F.lit(" "), F.lit("")), 1, 2)), F.substring("short", -1, 1))).otherwise(F.concat("short", F.lit("Q9")))
    return _defined(spark, sf).select("doc_id", "long", "short", short.alias("s"))


STATE = "{'c': c, 'w': -1, 'o': 0, 'free': 0, 'total': 0.0::DOUBLE}"
LETTERS = f"list_prepend({STATE.replace(': c,', ": '',")}, list_transform(string_split(lower(s), ''), lambda c: {STATE}))"


@query(
    f"""WITH {DEF}, f AS (SELECT doc_id, s, list_reduce({LETTERS}, lambda x, y: CASE WHEN coalesce(list_position(i[x.free + 1 :], y.c), 0) > 0
  THEN {{'c': y.c, 'w': x.w, 'o': x.o, 'free': x.free + list_position(i[x.free + 1 :], y.c), 'total': x.total + 1}} ELSE {{'c': y.c, 'w': x.w, 'o': x.o, 'free': x.free, 'total': x.total}} END) AS e
  FROM (SELECT doc_id, s, list_transform(string_split(long, ' '), lambda w: w[1]) AS i FROM {GB}))
SELECT doc_id, round(0.6 + 0.4 * e.total / length(s), 4) AS confidence FROM f"""
)
def confidence(spark, sf):
    return _twisted(spark, sf).select("doc_id", ex.confidence(F.col("s"), F.col("long")).alias("confidence"))


HERE = "CASE WHEN x.w >= 0 THEN instr(substr(w[x.w + 1], x.o + 1), y.c) ELSE 0 END"
AHEAD = "coalesce(list_position(list_transform(w[x.free + 1 :], lambda z: z[1]), y.c), 0)"


@query(
    f"""WITH {DEF}, f AS (SELECT doc_id, s, list_reduce({LETTERS}, lambda x, y: CASE
  WHEN {AHEAD} > 0 THEN {{'c': y.c, 'w': x.free + {AHEAD} - 1, 'o': 1, 'free': x.free + {AHEAD}, 'total': x.total + 10}}
  WHEN {HERE} > 0 THEN {{'c': y.c, 'w': x.w, 'o': x.o + {HERE}, 'free': x.free, 'total': x.total + CASE WHEN {HERE} = 1 THEN 2 ELSE 3 END}}
  ELSE {{'c': y.c, 'w': x.w, 'o': x.o, 'free': x.free, 'total': x.total}} END) AS e
  FROM (SELECT doc_id, s, string_split(long, ' ') AS w FROM {GB}))
SELECT doc_id, round(least(1.0, e.total / (10 * length(s))), 6) AS derivability FROM f"""
)
def derivability(spark, sf):
    return _twisted(spark, sf).select("doc_id", F.round(dis.derivability(F.col("s"), F.split("long", " ")), 6).alias("derivability"))


@query(f"WITH {DEF} SELECT doc_id, regexp_full_match(lower(s), array_to_string(list_transform(string_split(long, ' '), lambda w: '(' || w[1] || CASE WHEN length(w) > 1 THEN w[2] || '?' ELSE '' END || ')?'), '')) AS ok FROM {GB}")
def representable(spark, sf):
    return _twisted(spark, sf).select("doc_id", ev.reachable(F.col("s"), F.split("long", " "), 2).alias("ok"))


SUBSEQ = "regexp_matches(lower(long), array_to_string(list_transform(string_split(lower(s), ''), lambda c: c), '.*'))"


@query(f"WITH {DEF} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN s = short THEN 'initialism' WHEN {SUBSEQ} THEN 'subword' ELSE 'unreachable' END AS bucket FROM {GB}) GROUP BY bucket")
def gold_bucket(spark, sf):
    return _twisted(spark, sf).groupBy(ev.bucket(F.col("s"), F.col("long")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {DEF} SELECT cause, count(*) AS n FROM (SELECT CASE WHEN length(s) < 2 THEN 'short_form_too_short' WHEN length(s) > 10 THEN 'short_form_too_long' WHEN NOT regexp_matches(s, '[A-Z]') THEN 'no_capital' WHEN lower(long[1]) <> lower(s[1]) THEN 'first_letter_differs' WHEN NOT {SUBSEQ} THEN 'not_a_subsequence' ELSE 'other' END AS cause FROM {GB}) GROUP BY cause")
def miss_taxonomy(spark, sf):
    return _twisted(spark, sf).groupBy(ev.miss(F.col("s"), F.col("long")).alias("cause")).agg(F.count("*").alias("n"))


SYSTEMS = "sy AS (SELECT 'even' AS system, doc_id, short FROM df WHERE doc_id % 2 = 0 UNION ALL SELECT 'third', doc_id, short FROM df WHERE doc_id % 3 = 0 UNION ALL SELECT 'exact', doc_id, short FROM pr WHERE long IN (SELECT long FROM df))"


def _systems(spark, sf):
    d = _defined(spark, sf).select("doc_id", "short", "long")
    exact = _predicted(spark, sf).join(d.select("long").distinct(), "long", "left_semi").select(F.lit("exact").alias("system"), "doc_id", "short")
    return d.where("doc_id % 2 = 0").select(F.lit("even").alias("system"), "doc_id", "short").union(d.where("doc_id % 3 = 0").select(F.lit("third").alias("system"), "doc_id", "short")).union(exact), d


@query(f"WITH {PRED}, {SYSTEMS}, f AS (SELECT doc_id, short, count(DISTINCT system) AS n, min(system) AS only_one FROM sy GROUP BY ALL) SELECT CASE WHEN f.n IS NULL THEN 'missed by all' WHEN n = 1 THEN 'only ' || only_one ELSE 'shared' END AS found, count(*) AS n_pairs FROM df LEFT JOIN f USING (doc_id, short) GROUP BY 1")
def oracle_union(spark, sf):
    systems, gold = _systems(spark, sf)
    per = systems.groupBy("doc_id", "short").agg(F.countDistinct("system").alias("n"), F.min("system").alias("only_one"))
    found = F.when(F.col("n").isNull(), "missed by all").when(F.col("n") == 1, F.concat(F.lit("only "), "only_one")).otherwise("shared")
    return gold.join(per, ["doc_id", "short"], "left").groupBy(found.alias("found")).agg(F.count("*").alias("n_pairs"))


@query(f"WITH {PRED}, {SYSTEMS}, d AS (SELECT DISTINCT * FROM sy) SELECT a.system AS has, b.system AS lacks, count(*) - count(c.doc_id) AS n FROM d a CROSS JOIN (SELECT DISTINCT system FROM sy) b LEFT JOIN d c ON c.system = b.system AND c.doc_id = a.doc_id AND c.short = a.short WHERE a.system <> b.system GROUP BY ALL")
def disagreement(spark, sf):
    systems, _ = _systems(spark, sf)
    d = systems.distinct()
    per = d.groupBy("doc_id", "short").agg(F.collect_set("system").alias("by"))
    names = F.array(*map(F.lit, ["even", "exact", "third"]))
    rows = per.select(F.explode("by").alias("has"), "by").select("has", F.explode(F.array_remove(names, F.col("has"))).alias("lacks"), "by")
    return rows.groupBy("has", "lacks").agg(F.sum((~F.array_contains("by", F.col("lacks"))).cast("long")).alias("n"))


TAGS = f"{DEF}, tg AS (SELECT doc_id, i - 1 AS idx, w[i] AS token, CASE WHEN i = 1 THEN 'O' WHEN i % 3 = 2 THEN 'B' WHEN i % 3 = 0 THEN 'I' ELSE 'O' END AS tag FROM (SELECT doc_id, string_split('results ' || long || ' noted here', ' ') AS w FROM df), unnest(range(1, len(w) + 1)) AS r(i))"


def _tags(spark, sf):
    words = F.split(F.concat(F.lit("results "), "long", F.lit(" noted here")), " ")
    rows = _defined(spark, sf).select("doc_id", F.posexplode(words).alias("idx", "token"))
    i = F.col("idx") + 1
    return rows.withColumn("tag", F.when(i == 1, "O").when(i % 3 == 2, "B").when(i % 3 == 0, "I").otherwise("O"))


@query(f"WITH {TAGS}, s AS (SELECT *, sum((tag = 'B')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS sp FROM tg) SELECT doc_id, min(idx) AS first, max(idx) AS last FROM s WHERE tag <> 'O' GROUP BY doc_id, sp")
def bio_spans(spark, sf):
    return ev.bio_spans(_tags(spark, sf))


OFFS = f"{TAGS}, pl AS (SELECT doc_id, idx, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM tg)"


@query(f'WITH {OFFS} SELECT doc_id, idx, token, begin_at AS "begin", begin_at + length(token) AS stop FROM pl')
def detokenize_offsets(spark, sf):
    return ev.offsets(_tags(spark, sf).select("doc_id", "idx", "token"))


@query(f'WITH {OFFS} SELECT d.doc_id, 8 AS "begin", 8 + length(long) AS stop, min(idx) AS first, max(idx) AS last FROM df d JOIN pl ON pl.doc_id = d.doc_id AND begin_at < 8 + length(long) AND begin_at + length(token) > 8 GROUP BY ALL')
def span_overlap(spark, sf):
    spans = _defined(spark, sf).select("doc_id", F.lit(8).alias("begin"), (8 + F.length("long")).alias("stop"))
    return ev.span_tokens(spans, ev.offsets(_tags(spark, sf).select("doc_id", "idx", "token")))


@query(f"WITH {DEF} SELECT doc_id, short, least(12, a + k) AS n_words FROM df")
def harvest_candidates(spark, sf):
    return rel.harvest(_defined(spark, sf)).select("doc_id", "short", F.size("words").alias("n_words"))


@query()
def strategy_hits(spark, sf):
    return rel.strategy_hits(rel.harvest(_defined(spark, sf))).select(F.explode("hit").alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query()
def estimate_precision(spark, sf):
    return rel.estimate(rel.harvest(_defined(spark, sf)))


@query()
def best_alignment(spark, sf):
    rows = rel.harvest(_defined(spark, sf))
    return rel.best_alignments(rows, rel.estimate(rows))
