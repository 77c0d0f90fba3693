"""Queries over tokens with offsets, sentences, numerals, Unicode forms and annotations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.sentences import sentences
from ..operators import annotate as an
from ..operators import tokenize as tk
from .text_queries import STOPS, TOKS, _tokens

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOKS} SELECT token, count(*) AS n, strip_accents(token) AS plain, replace(lower(token), 'ß', 'ss') AS key FROM toks GROUP BY token")
def unicode_forms(spark, sf):
    words = _tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    return words.select("token", "n", tk.accentless(F.col("token")).alias("plain"), tk.text_key(F.col("token")).alias("key"))



_ORD = f"""CASE WHEN last IN ({', '.join(map(repr, tk.ORDINALS))}) THEN {' '.join(['CASE last', *(f"WHEN '{a}' THEN '{b}'" for a, b in tk.ORDINALS.items()), 'END'])}
 WHEN last LIKE '%y' THEN left(last, length(last) - 1) || 'ieth' ELSE last || 'th' END"""


@query(
    f"""WITH u AS (SELECT {t.UNITS!r} AS u, {t.TENS!r} AS t), n AS (SELECT DISTINCT p_partkey % 1010 AS n FROM part),
w AS (SELECT n, n // 100 AS h, n % 100 AS r, CASE WHEN n % 100 < 20 THEN u[n % 100 + 1] WHEN n % 10 = 0 THEN t[n % 100 // 10 + 1] ELSE t[n % 100 // 10 + 1] || '-' || u[n % 10 + 1] END AS tail, u FROM n, u),
c AS (SELECT n, CASE WHEN h = 0 THEN tail WHEN r = 0 THEN u[h + 1] || ' hundred' ELSE u[h + 1] || ' hundred ' || tail END AS c FROM w),
l AS (SELECT n, c, regexp_extract(c, '[a-z]+$') AS last FROM c)
SELECT n, CASE WHEN n < 1000 THEN c END AS cardinal, CASE WHEN n < 1000 THEN left(c, length(c) - length(last)) || {_ORD} END AS ordinal FROM l"""
)
def spell_ordinal(spark, sf):
    n = F.col("n").cast("string")
    spell = F.pandas_udf(lambda s: s.map(tk.spelled), "string")
    rows = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 1010).alias("n")).distinct()
    return rows.select("n", spell(n).alias("cardinal"), spell(F.concat(n, F.lit("th"))).alias("ordinal"))


@query(f"WITH {TOKS}, {STOPS}, w AS (SELECT DISTINCT token AS word FROM toks) SELECT word, category, category IS NOT NULL AS is_stop, coalesce(category IN ('particle', 'determiner', 'other', 'conjunction', 'pronoun', 'auxiliary', 'preposition'), false) AS is_suppressed FROM w LEFT JOIN stops ON stops.lang = 'en' AND low = lower(word)")
def stop_word_suppression(spark, sf):
    words = _tokens(spark, sf).select(F.col("token").alias("word")).distinct()
    return tk.suppressed_words(words, tk.Rules(lending=frozenset(["article"])))


# phrases with a stop word, a word in capitals, a compound, an ordinal and an elision, from the part table
PHRASE = "p_name || ' of the ' || p_type || ' ' || replace(p_name, ' ', '-') || ' 21st l''eau ' || p_size"
PIECES = f"""tx AS (SELECT p_partkey AS id, {PHRASE} AS text, p_name, p_size FROM part),
pc AS (SELECT id, p_name, unnest(string_split(replace(text, 'l''eau', 'l eau'), ' ')) AS token, generate_subscripts(string_split(replace(text, 'l''eau', 'l eau'), ' '), 1) - 1 AS i FROM tx),
st AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS p0 FROM pc),
rl AS (SELECT id, i::INT AS "index", token AS text, p0 AS "start", p0 + length(token) AS stop,
  CASE WHEN regexp_matches(token, '^[0-9]+(st)?$') THEN 'numeral' WHEN upper(token) = token AND length(token) > 1 THEN 'acronym' WHEN token IN ('of', 'the') THEN 'function' ELSE 'content' END AS role FROM st)"""


def _phrase_texts(spark, sf):
    text = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" 21st l'eau "), "p_size")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), text.alias("text"))


def _phrase_tokens(spark, sf):
    return tk.token_rows(tk.tokenize(_phrase_texts(spark, sf)))


@query(f"""WITH {PIECES} SELECT id, "index", text, "start", stop, role, role = 'acronym' OR (role = 'content' AND length(text) > 1) AS critical, role = 'numeral' OR role = 'acronym' OR (role = 'content' AND length(text) > 1) AS eligible,
CASE role WHEN 'numeral' THEN regexp_extract(text, '^[0-9]+') WHEN 'acronym' THEN text ELSE CASE WHEN text LIKE '%-%' THEN upper(text[1] || string_split(text, '-')[2][1]) ELSE upper(left(text, 2)) END END AS letters FROM rl""")
def token_offsets(spark, sf):
    return _phrase_tokens(spark, sf).select("id", "index", "text", "start", "stop", "role", "critical", "eligible", "letters")


# the texts are made so that every rule for a full stop occurs
SENT = """['Dr. ' || p_name || ' left, e.g. No. 5 of J. R. ' || p_type || '.', 'Then v3.5mm!', '"' || upper(p_name) || '?"', 'Yes... and no more']"""


@query(f"""WITH s AS (SELECT p_partkey AS doc_id, {SENT} AS s FROM part), k AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS ord FROM s),
o AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS p0 FROM k)
SELECT doc_id, ord::INT AS ord, p0 AS "begin", (p0 + length(sentence))::INT AS stop, sentence FROM o""")
def sentence_split(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    text = F.concat(F.lit("Dr. "), "p_name", F.lit(" left, e.g. No. 5 of J. R. "), "p_type", F.lit('. Then v3.5mm! "'), F.upper("p_name"), F.lit('?" Yes... and no more'))
    return sentences(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query()
def document_sentences(spark, sf):
    return sentences(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("characters"))


PENN = "VALUES " + ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in an.PENN.items())


@query(f"WITH p(tag, u) AS ({PENN}), x AS (SELECT DISTINCT tag || s AS tag FROM p, (SELECT unnest(['', 'X', '-TL']) AS s)) SELECT x.tag, coalesce(u, CASE WHEN x.tag LIKE 'NNP%' THEN 'PROPN' WHEN x.tag LIKE 'WRB%' THEN 'ADV' WHEN x.tag LIKE 'WDT%' THEN 'DET' WHEN x.tag LIKE 'PRP%' THEN 'PRON' WHEN x.tag LIKE 'NN%' THEN 'NOUN' WHEN x.tag LIKE 'VB%' THEN 'VERB' WHEN x.tag LIKE 'JJ%' THEN 'ADJ' WHEN x.tag LIKE 'RB%' THEN 'ADV' WHEN x.tag LIKE 'WP%' THEN 'PRON' ELSE 'X' END) AS universal FROM x LEFT JOIN p USING (tag)")
def penn_tags(spark, sf):
    tags = spark.createDataFrame([(tag + s,) for tag in an.PENN for s in ("", "X", "-TL")], "tag string").distinct()
    return tags.select("tag", F.pandas_udf(lambda s: s.map(an.penn_to_universal), "string")("tag").alias("universal"))


#: A tag for each token by its place, as if from a tagger; and tags of halves of tokens for the alignment.
_TAGS = ["NOUN", "ADP", "DET", "VERB", "X", "NUM", "PRON", "PUNCT"]


@query(f"""WITH {PIECES}, p AS (SELECT *, {_TAGS!r}["index" % 8 + 1] AS pos FROM rl), r AS (SELECT *, CASE WHEN role IN ('acronym', 'numeral') THEN role WHEN pos IN ('NOUN', 'VERB', 'NUM') OR (pos = 'X' AND regexp_matches(text, '[A-Z]')) THEN 'content' WHEN pos IN ('ADP', 'DET', 'PRON') THEN 'function' ELSE role END AS now FROM p)
SELECT id, "index", pos, now AS role, CASE WHEN now = role THEN role = 'acronym' OR (role = 'content' AND length(text) > 1) ELSE now = 'content' AND (role = 'numeral' OR (role = 'content' AND length(text) > 1)) END AS critical FROM r""")
def annotated_roles(spark, sf):
    tags = F.array(*map(F.lit, _TAGS))
    rows = _phrase_tokens(spark, sf).withColumn("pos", F.get(tags, F.col("index") % 8))
    return an.with_roles(rows).select("id", "index", "pos", "role", "critical")


@query(f"""WITH {PIECES} SELECT id, "index", CASE WHEN length(text) = 1 THEN 'NOUN' WHEN "index" % 2 = 0 THEN 'ADJ' ELSE 'ADP' END AS pos FROM rl""")
def aligned_annotations(spark, sf):
    # part is small in its file and large in tokens: as one partition it would be one task
    rows = tk.token_rows(tk.tokenize(_phrase_texts(spark, sf).repartition("id")))
    mid = F.col("start") + F.floor(F.length("text") / 2).cast("int")
    one = F.length("text") == 1
    first = rows.select("id", F.col("start"), F.when(one, F.col("stop")).otherwise(mid).alias("stop"), F.when(one, "NOUN").otherwise("ADP").alias("pos"), F.lit(None).cast("string").alias("lemma"))
    second = rows.where(~one).select("id", mid.alias("start"), "stop", F.when(F.col("index") % 2 == 0, "ADJ").otherwise("DET").alias("pos"), F.lit(None).cast("string").alias("lemma"))
    return an.align_by_offsets(rows, first.union(second)).select("id", "index", "pos")


@query(f"""WITH {PIECES} SELECT id, "index", CASE role WHEN 'numeral' THEN 'NUM' WHEN 'acronym' THEN 'PROPN' ELSE CASE WHEN text = 'of' THEN 'ADP' WHEN text = 'the' THEN 'DET'
 {" ".join(f"WHEN lower(text) LIKE '%{s}' AND length(text) >= {len(s) + 2} THEN '{g}'" for s, g in an._SUFFIXES)} ELSE 'NOUN' END END AS pos FROM rl""")
def guessed_tags(spark, sf):
    backend, _ = an.resolve("auto")
    return an.annotate(tk.tokenize(_phrase_texts(spark, sf)), backend).select("id", "index", "pos")
