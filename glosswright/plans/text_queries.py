"""Queries over tokens, sounds and term statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonetics as ph
from ..functions import text as t
from ..operators import terms
from ..operators.vocabulary import literal

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _stops(spark):
    return F.broadcast(literal(spark, t.stop_rows(), "lang string, low string, category string"))  # a fixed list


STOPS = "stops AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in t.stop_rows()) + ") AS s(lang, low, category))"
TOKS = f"toks AS (SELECT doc_id, lang, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '{t.WORD.replace(chr(39), chr(39) * 2)}') AS w FROM documents))"
ALL_CAPS = "length(token) >= 2 AND regexp_matches(token, '\\p{Lu}') AND NOT regexp_matches(token, '\\p{Ll}')"
ROLE = f"CASE WHEN regexp_matches(token, '{t.NUMERAL}') THEN 'numeral' WHEN {ALL_CAPS} THEN 'acronym' WHEN category IS NOT NULL THEN 'function' ELSE 'content' END"
_suffixes = sorted(((s, tag) for tag, g in t.SUFFIX_POS.items() for s in g), key=lambda x: (-len(x[0]), x[0]))
POS = (
    f"CASE WHEN regexp_matches(token, '{t.NUMERAL}') THEN 'NUM' WHEN {ALL_CAPS} THEN 'PROPN' "
    + " ".join(f"WHEN category = '{c}' THEN '{p}'" for c, p in t.CATEGORY_POS.items())
    + " "
    + " ".join(f"WHEN lower(token) LIKE '%{s}' AND length(token) >= {len(s) + 2} THEN '{p}'" for s, p in _suffixes)
    + " ELSE 'NOUN' END"
)


def _tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", F.posexplode(t.words(F.col("text"))).alias("pos", "token"))


def _classed(spark, sf):
    return _tokens(spark, sf).withColumn("low", F.lower("token")).join(_stops(spark), ["lang", "low"], "left")


@query(f"WITH {TOKS} SELECT doc_id, pos, token FROM toks")
def tokenize_docs(spark, sf):
    return _tokens(spark, sf).select("doc_id", "pos", "token")


@query(f"WITH {TOKS}, {STOPS} SELECT t.lang, {ROLE} AS role, count(*) AS n FROM toks t LEFT JOIN stops s ON s.lang = t.lang AND s.low = lower(token) GROUP BY ALL")
def token_roles(spark, sf):
    return _classed(spark, sf).groupBy("lang", t.role(F.col("token"), F.col("category")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {TOKS}, {STOPS} SELECT t.lang, count(*) AS tokens, count(category) AS stop_words, round(count(category) / count(*), 6) AS share FROM toks t LEFT JOIN stops s ON s.lang = t.lang AND s.low = lower(token) GROUP BY ALL")
def stopword_share_by_lang(spark, sf):
    return _classed(spark, sf).groupBy("lang").agg(F.count("*").alias("tokens"), F.count("category").alias("stop_words"), F.round(F.count("category") / F.count("*"), 6).alias("share"))


@query(f"WITH {TOKS}, {STOPS} SELECT {POS} AS pos_tag, count(*) AS n FROM toks t LEFT JOIN stops s ON s.lang = t.lang AND s.low = lower(token) WHERE t.lang = 'en' GROUP BY ALL")
def pos_heuristic(spark, sf):
    return _classed(spark, sf).where("lang = 'en'").groupBy(t.heuristic_pos(F.col("token"), F.col("category")).alias("pos_tag")).agg(F.count("*").alias("n"))


@query(f"WITH {TOKS} SELECT doc_id, count(*) AS n FROM toks WHERE {ALL_CAPS} GROUP BY doc_id")
def all_caps(spark, sf):
    return _tokens(spark, sf).where(t.is_all_caps(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {TOKS} SELECT token, count(*) AS n FROM toks WHERE token <> '' AND regexp_matches(upper(token), '{t.ROMAN}') GROUP BY token")
def is_roman(spark, sf):
    return _tokens(spark, sf).where(t.is_roman(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


_U = "[" + ", ".join(map(repr, t.UNITS)) + "]"
_T = "[" + ", ".join(map(repr, t.TENS)) + "]"
_TWO = f"(CASE WHEN r < 20 THEN {_U}[r + 1] WHEN r % 10 = 0 THEN {_T}[r // 10 + 1] ELSE {_T}[r // 10 + 1] || '-' || {_U}[r % 10 + 1] END)"


@query(f"SELECT n, CASE WHEN n > 999 THEN NULL WHEN n < 100 THEN {_TWO} WHEN r = 0 THEN {_U}[h + 1] || ' hundred' ELSE {_U}[h + 1] || ' hundred ' || {_TWO} END AS words FROM (SELECT n, n % 100 AS r, n // 100 AS h FROM (SELECT DISTINCT p_partkey % 1005 AS n FROM part))")
def spell_number(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 1005).alias("n")).distinct().select("n", t.cardinal(F.col("n")).alias("words"))


@query("SELECT DISTINCT p_name, upper(left(p_name, 1)) AS first_only, upper(left(p_name, 1)) || upper(left(split_part(p_name, ' ', 2), 1)) AS split_letters, upper(left(replace(p_name, ' ', ''), 2)) AS merged FROM part")
def hyphen_letters(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    name = F.regexp_replace("p_name", " ", "-")
    return rows.select("p_name", t.donated_letters(name, "first_only", 2).alias("first_only"), t.donated_letters(name, "split", 2).alias("split_letters"), t.donated_letters(name, "merge", 2).alias("merged"))


@query("SELECT lang, upper(lang || '-XX') AS upper_tag, lower(lang) AS language, count(*) AS n FROM documents GROUP BY ALL")
def language_tags(spark, sf):
    tag = F.concat("lang", F.lit("-XX"))
    return _docs(spark, sf).groupBy("lang", t.apply_case(tag, "upper").alias("upper_tag"), t.language_of(tag).alias("language")).agg(F.count("*").alias("n"))


LEX = "lex AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3)"
MODEL = f"""{LEX}, pr AS (SELECT substr('^' || word || '$', i, 2) AS p FROM lex, unnest(range(1, length(word) + 2)) AS r(i)),
cn AS (SELECT p[1] AS prev, p[2] AS nxt, count(*) AS n FROM pr GROUP BY ALL), tot AS (SELECT prev, sum(n) AS total FROM cn GROUP BY prev),
al AS (SELECT DISTINCT nxt AS c FROM cn WHERE nxt <> '$'), vv AS (SELECT count(*) + 2 AS v FROM al),
bg AS (SELECT a.prev, b.nxt, ln((coalesce(cn.n, 0) + 0.5) / (coalesce(tot.total, 0) + 0.5 * v)) AS log_prob FROM (SELECT c AS prev FROM al UNION ALL SELECT '^') a, (SELECT c AS nxt FROM al UNION ALL SELECT '$') b
  CROSS JOIN vv LEFT JOIN cn ON cn.prev = a.prev AND cn.nxt = b.nxt LEFT JOIN tot ON tot.prev = a.prev),
bo AS (SELECT ln(0.5) - ln(max(total) + 0.5 * max(v)) AS low FROM tot, vv)"""


def _lexicon(spark, sf):
    return ph.lexicon_of(_docs(spark, sf), least=3)


def _model(spark, sf):
    """(model, lexicon): one pass over the texts trains, another looks words up."""
    lex = _lexicon(spark, sf)
    return ph.fit_bigrams(lex), lex


@query(f'WITH {MODEL} SELECT prev, nxt AS "next", round(log_prob, 6) AS log_prob FROM bg')
def train_bigrams(spark, sf):
    return ph.train_bigrams(_lexicon(spark, sf)).select("prev", "next", F.round("log_prob", 6).alias("log_prob"))


@query(f"WITH {MODEL} SELECT word, round(CASE WHEN length(word) < 2 THEN max(low) ELSE sum(coalesce(log_prob, low)) / (length(word) - 1) END, 6) AS phi FROM lex CROSS JOIN bo LEFT JOIN unnest(range(1, length(word))) AS r(i) ON true LEFT JOIN bg ON prev = word[i] AND nxt = word[i + 1] GROUP BY word")
def phi_score(spark, sf):
    m, lex = _model(spark, sf)
    return lex.select("word", F.round(ph.phi(F.col("word"), m), 6).alias("phi"))


@query(
    f"""WITH {MODEL}, b AS (SELECT word, max(low) AS low, sum(coalesce(log_prob, low)) / (length(word) + 1) AS m FROM (SELECT word, '^' || word || '$' AS f FROM lex) CROSS JOIN bo, unnest(range(1, length(f))) AS r(i) LEFT JOIN bg ON prev = f[i] AND nxt = f[i + 1] GROUP BY word)
SELECT word, round(least(greatest((m - low) / -low, 0.0), 1.0) * CASE WHEN regexp_matches(word, '[aeiouy]') THEN 1.0 ELSE 0.35 END * CASE WHEN regexp_matches(word, '[b-df-hj-np-tv-xz]{{4}}') THEN 0.6 ELSE 1.0 END, 6) AS pronounceability FROM b"""
)
def pronounceability(spark, sf):
    m, lex = _model(spark, sf)
    return lex.select("word", F.round(ph.pronounceability(F.col("word"), m), 6).alias("pronounceability"))


@query(f"WITH {MODEL}, f AS (SELECT word, '^' || word || '$' AS f FROM lex) SELECT word, round(sum(coalesce(log_prob, low)) / (length(word) + 1), 6) AS phi FROM f CROSS JOIN bo, unnest(range(1, length(f))) AS r(i) LEFT JOIN bg ON prev = f[i] AND nxt = f[i + 1] GROUP BY word")
def phi_with_boundaries(spark, sf):
    m, lex = _model(spark, sf)
    return lex.select("word", F.round(ph.phi_framed(F.col("word"), m), 6).alias("phi"))


@query(f"WITH {LEX} SELECT word, round(0.5 * CASE WHEN regexp_matches(word, '[aeiouy]') THEN 1.0 ELSE 0.35 END * CASE WHEN regexp_matches(word, '[b-df-hj-np-tv-xz]{{4}}') THEN 0.6 ELSE 1.0 END, 6) AS pronounceability FROM lex")
def neutral_pronounceability(spark, sf):
    return _lexicon(spark, sf).select("word", F.round(ph.pronounceability(F.col("word"), ph.uniform_model()), 6).alias("pronounceability"))


@query(f"WITH {LEX} SELECT word, greatest(len(regexp_extract_all(word, '[aeiouy]+')) - (regexp_matches(word, '[^aeiouy]e$') AND NOT word LIKE '%le' AND length(word) > 2)::INT, 1) AS syllables, round(length(regexp_replace(word, '[^aeiouy]', '', 'g')) / length(word), 6) AS vowel_ratio, coalesce(list_max(list_transform(regexp_extract_all(word, '[b-df-hj-np-tv-xz]+'), lambda x: length(x))), 0) AS consonant_run FROM lex")
def syllables(spark, sf):
    w = F.col("word")
    return _lexicon(spark, sf).select("word", ph.syllables(w).alias("syllables"), F.round(ph.vowel_ratio(w), 6).alias("vowel_ratio"), ph.consonant_run(w).alias("consonant_run"))


@query(f"WITH {LEX} SELECT length(word) AS length, count(*) AS n, min(word) AS first_word FROM lex GROUP BY 1")
def lexicon_by_length(spark, sf):
    return _lexicon(spark, sf).groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


@query(f"WITH {LEX} SELECT word, n FROM lex WHERE starts_with(word, 'the')")
def lexicon_prefix(spark, sf):
    return _lexicon(spark, sf).where(F.col("word").startswith("the"))


@query(f"WITH {LEX} SELECT p_partkey, w, w IN (SELECT word FROM lex) AS known FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def lexicon_membership(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    lex = _lexicon(spark, sf).select(F.col("word").alias("w"), F.lit(True).alias("hit"))
    return words.join(lex, "w", "left").select("p_partkey", "w", F.coalesce("hit", F.lit(False)).alias("known"))


WORDS = """cl AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS clause FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.,;:!?\\n]+') AS c FROM documents)),
wd AS (SELECT doc_id, clause, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, clause, regexp_extract_all(c, '[a-z]+') AS w FROM cl)),
uni AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df FROM wd GROUP BY word),
big AS (SELECT word AS a, nxt AS b, count(*) AS n FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id, clause ORDER BY pos) AS nxt FROM wd) WHERE nxt IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {WORDS} SELECT word, n, df FROM uni")
def unigram_df(spark, sf):
    return terms.unigrams(_docs(spark, sf))


@query(f"WITH {WORDS} SELECT a, b, n FROM big WHERE n >= 3")
def bigram_counts(spark, sf):
    return terms.bigrams(_docs(spark, sf)).where("n >= 3")


@query(
    f"""WITH {WORDS}, t AS (SELECT sum(n)::DOUBLE AS t FROM uni), j AS (SELECT sum(n)::DOUBLE AS j FROM big)
SELECT a, b, g.n, round(least(greatest(ln((g.n / j) / ((x.n / t) * (y.n / t))) / -ln(g.n / j), -1.0), 1.0) * g.n / (g.n + 3) * least(x.n, y.n) / (least(x.n, y.n) + 3), 5) AS npmi
FROM big g JOIN uni x ON x.word = a JOIN uni y ON y.word = b, t, j WHERE g.n >= 3"""
)
def npmi_association(spark, sf):
    return terms.association(_docs(spark, sf)).withColumn("npmi", F.round("npmi", 5))


@query(f"WITH {WORDS}, s AS (SELECT b, n, sum(n) OVER (PARTITION BY b) AS seen FROM big) SELECT b AS word, max(seen)::BIGINT AS seen, round(CASE WHEN max(seen) < 3 THEN 0.5 ELSE sum(-(n / seen) * ln(n / seen)) / ln(max(seen)) END, 5) AS boundary FROM s GROUP BY b")
def left_entropy(spark, sf):
    return terms.left_entropy(_docs(spark, sf)).withColumn("boundary", F.round("boundary", 5))


@query(f"WITH {WORDS}, d AS (SELECT count(*)::DOUBLE AS docs FROM documents) SELECT word, df, round(least(1.0, ln(docs / (1 + df)) / ln(docs)), 6) AS specificity FROM uni, d")
def specificity(spark, sf):
    return terms.specificity(_docs(spark, sf)).withColumn("specificity", F.round("specificity", 6))


@query(f"WITH {WORDS}, t AS (SELECT sum(n)::DOUBLE AS t FROM uni), m AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM big) SELECT a, b, n FROM m WHERE r = 1")
def select_best_follower(spark, sf):
    return terms.bigrams(_docs(spark, sf)).groupBy("a").agg(F.min_by(F.struct("b", "n"), F.struct(-F.col("n"), "b")).alias("m")).select("a", "m.b", "m.n")
