"""Queries that score predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disambiguate as dis
from ..operators import evaluate as ev
from ..operators import reliability as rel
from ..operators import terms
from ..operators import workloads as wl
from .acronym_queries import DEF, TAGS, _defined, _tags
from .text_queries import WORDS, _docs

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {DEF}, v AS (SELECT doc_id, short, long FROM df UNION ALL SELECT doc_id, lower(short), ' ' || upper(long) FROM df UNION ALL SELECT doc_id, short, long || 's' FROM df WHERE doc_id % 2 = 0) SELECT doc_id, count(DISTINCT lower(short) || '|' || lower(trim(long))) AS n FROM v GROUP BY doc_id")
def deduplicated_predictions(spark, sf):
    d = _defined(spark, sf).select("doc_id", "short", "long", F.lit(0).alias("ord"))
    more = d.select("doc_id", F.lower("short").alias("short"), F.concat(F.lit(" "), F.upper("long")).alias("long"), F.lit(1).alias("ord"))
    other = d.where("doc_id % 2 = 0").select("doc_id", "short", F.concat("long", F.lit("s")).alias("long"), F.lit(2).alias("ord"))
    return ev.deduplicated(d.union(more).union(other)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {DEF} SELECT count(*) AS n_gold, count(*) FILTER (WHERE doc_id % 3 <> 1) AS reachable FROM df")
def candidate_space_recall(spark, sf):
    d = _defined(spark, sf)
    third = F.col("doc_id") % 3
    gold = d.select("doc_id", "short", F.when(third == 1, F.concat("long", F.lit(" x"))).when(third == 2, F.substring_index("long", " ", -2)).otherwise(F.col("long")).alias("long"))
    return ev.space_recall(gold, d)


ENTRIES = f"{DEF}, en AS (SELECT short AS key, long AS expansion, row_number() OVER (PARTITION BY short ORDER BY min(doc_id)) - 1 AS ord FROM df GROUP BY short, long), sz AS (SELECT key, count(*) AS k FROM en GROUP BY key), tr AS (SELECT long AS expansion, count(*) AS n FROM df WHERE doc_id % 2 = 0 GROUP BY long)"


def _instances(spark, sf):
    d = _defined(spark, sf)
    entries = dis.dictionary(d.select(F.lit(0).alias("src"), F.col("doc_id").alias("ord"), "short", "long"))
    return d.select(F.col("doc_id").alias("instance"), F.col("short").alias("key"), F.col("long").alias("gold")), entries


@query(f"WITH {ENTRIES} SELECT count(*) AS n, round(sum(1.0 / sz.k), 6) AS expected, true AS offered FROM df JOIN sz ON sz.key = short")
def random_baseline(spark, sf):
    instances, entries = _instances(spark, sf)
    picked = ev.random_choice(instances, entries)
    known = entries.select(F.col("expansion").alias("predicted"), F.lit(True).alias("ok")).distinct()
    return picked.join(known, "predicted", "left").agg(F.count("*").alias("n"), F.round(F.sum("expected"), 6).alias("expected"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("offered"))


BUCKETS = "CASE WHEN sz.k <= 1 THEN '1' WHEN sz.k = 2 THEN '2' WHEN sz.k <= 5 THEN '3-5' WHEN sz.k <= 10 THEN '6-10' ELSE '11+' END"


@query(f"WITH {ENTRIES}, mf AS (SELECT key, first(expansion ORDER BY coalesce(n, 0) DESC, ord) AS predicted FROM en LEFT JOIN tr USING (expansion) GROUP BY key) SELECT {BUCKETS} AS bucket, count(*) AS n, sum((long = predicted)::INT)::BIGINT AS correct FROM df JOIN mf ON mf.key = short JOIN sz ON sz.key = short GROUP BY 1")
def accuracy_by_candidates(spark, sf):
    instances, entries = _instances(spark, sf)
    train = instances.where("instance % 2 = 0").select("gold")
    predicted = ev.most_frequent(instances, entries, train).join(instances.select("instance", "key"), "instance")
    return ev.accuracy_by_candidates(predicted, entries)


@query(f"WITH {ENTRIES} SELECT count(*) AS instances, count(*) FILTER (WHERE doc_id % 5 <> 0) AS reachable FROM df")
def selection_ceiling(spark, sf):
    instances, entries = _instances(spark, sf)
    return ev.ceiling(instances.withColumn("gold", F.when(F.col("instance") % 5 == 0, F.concat("gold", F.lit("!"))).otherwise(F.col("gold"))), entries)


@query(f"WITH {DEF}, t AS (SELECT doc_id, short, long, length(array_to_string(w[1 : a + k], ' ')) AS t FROM df) SELECT doc_id, t + 2 AS short_begin, t + 2 + length(short) AS short_stop, t - length(long) AS long_begin, t AS long_stop FROM t")
def pair_location(spark, sf):
    rows = ev.located(_defined(spark, sf).select("doc_id", "text", "short", "long"))
    return rows.select("doc_id", F.col("short_span.begin").alias("short_begin"), F.col("short_span.stop").alias("short_stop"), F.col("long_span.begin").alias("long_begin"), F.col("long_span.stop").alias("long_stop"))


SPANS = f"{TAGS}, s AS (SELECT *, sum((tag = 'B')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS sp FROM tg), gs AS (SELECT doc_id, sp, doc_id % 3 AS k FROM s WHERE tag <> 'O' GROUP BY doc_id, sp), dg AS (SELECT doc_id, k, count(*) AS g FROM gs GROUP BY ALL)"


def _moved(spark, sf):
    """Gold spans, and the same moved by none, one or two tokens."""
    gold = ev.bio_spans(_tags(spark, sf))
    k = (F.col("doc_id") % 3).cast("int")
    return gold, gold.select("doc_id", (F.col("first") + k).alias("first"), (F.col("last") + k).alias("last"))


@query(f"WITH {SPANS}, x AS (SELECT sum(g) AS g, sum(CASE WHEN k = 0 THEN g ELSE 0 END) AS tp FROM dg) SELECT tp::BIGINT AS tp, (g - tp)::BIGINT AS fp, (g - tp)::BIGINT AS fn FROM x")
def span_match_exact(spark, sf):
    return ev.matched_spans(*_moved(spark, sf))


@query(f"WITH {SPANS}, x AS (SELECT sum(g) AS g, sum(CASE WHEN k < 2 THEN g ELSE g - 1 END) AS tp FROM dg) SELECT tp::BIGINT AS tp, (g - tp)::BIGINT AS fp, (g - tp)::BIGINT AS fn FROM x")
def span_match_overlap(spark, sf):
    return ev.matched_spans(*_moved(spark, sf), overlap=True)




@query(
    f"""WITH {DEF}, tk AS (SELECT doc_id, w[a + 1] AS x, w[a + 2] AS y, w[a + 3] AS z FROM df),
t AS (SELECT doc_id, ['(', x, ',', y, '-', z, ')', '.', 'End'] AS t, [0, 0, 0, 1, 0, 0, 0, 0, 1] AS g FROM tk),
u AS (SELECT doc_id, unnest(t) AS token, unnest(g) AS g, generate_subscripts(t, 1) - 1 AS idx FROM t),
v AS (SELECT *, sum(g + length(token)) OVER (PARTITION BY doc_id ORDER BY idx) AS z FROM u)
SELECT doc_id, idx, token, (z - length(token))::BIGINT AS "begin", z::BIGINT AS stop FROM v"""
)
def detokenize_tight(spark, sf):
    words = F.split("long", " ")
    tokens = F.array(F.lit("("), words[0], F.lit(","), words[1], F.lit("-"), words[2], F.lit(")"), F.lit("."), F.lit("End"))
    return ev.detokenized(_defined(spark, sf).select("doc_id", F.posexplode(tokens).alias("idx", "token")))


NPMI = f"""{WORDS}, t AS (SELECT sum(n)::DOUBLE AS t FROM uni), j AS (SELECT sum(n)::DOUBLE AS j FROM big),
np AS (SELECT a, b, least(greatest(ln((g.n / j) / ((x.n / t) * (y.n / t))) / -ln(g.n / j), -1.0), 1.0) * g.n / (g.n + 3) * least(x.n, y.n) / (least(x.n, y.n) + 3) AS npmi
 FROM big g JOIN uni x ON x.word = a JOIN uni y ON y.word = b, t, j WHERE g.n >= 3)"""
CASES = f"{NPMI}, {DEF}, ca AS (SELECT doc_id, CASE WHEN a > 0 THEN w[a] END AS previous, w[a + 1 : a + k] AS s FROM df)"
SCORED = f"""{CASES}, ln AS (SELECT doc_id, i, s[i] AS a, s[i + 1] AS b FROM ca, unnest(range(1, len(s))) AS r(i)),
co AS (SELECT doc_id, avg(coalesce(npmi, 0.0)) AS cohesion, max(CASE WHEN i = 1 THEN coalesce(npmi, 0.0) END) AS inside FROM ln LEFT JOIN np USING (a, b) GROUP BY doc_id),
ac AS (SELECT doc_id, coalesce(npmi, 0.0) AS across FROM ca LEFT JOIN np ON np.a = previous AND np.b = s[1]),
sn AS (SELECT b, n, sum(n) OVER (PARTITION BY b) AS seen FROM big), le AS (SELECT b AS word, CASE WHEN max(seen) < 3 THEN 0.5 ELSE sum(-(n / seen) * ln(n / seen)) / ln(max(seen)) END AS boundary FROM sn GROUP BY b),
dn AS (SELECT count(*)::DOUBLE AS docs FROM documents), sp AS (SELECT word, least(1.0, ln(docs / (1 + df)) / ln(docs)) AS specificity FROM uni, dn),
sc AS (SELECT ca.doc_id, cohesion, inside - across AS contrast, coalesce(boundary, 0.5) AS boundary, coalesce(specificity, 1.0) AS specificity FROM ca JOIN co USING (doc_id) JOIN ac USING (doc_id) LEFT JOIN le ON le.word = s[1] LEFT JOIN sp ON sp.word = s[1])"""


def _spans(spark, sf):
    words = F.regexp_extract_all(F.regexp_extract("text", r"^([^()]*)\(", 1), F.lit("[a-z]+"), F.lit(0))
    rows = _defined(spark, sf).select("doc_id", F.split("long", " ").alias("words"), words.alias("before"))
    return rows.select(F.col("doc_id").alias("id"), F.try_element_at("before", -F.size("words") - 1).alias("previous"), "words")


@query(f"WITH {SCORED} SELECT doc_id AS id, round(cohesion, 5) AS cohesion, round(contrast, 5) AS contrast, round(boundary, 5) AS boundary, round(specificity, 5) AS specificity FROM sc")
def span_statistics(spark, sf):
    rows = terms.span_scores(_spans(spark, sf), _docs(spark, sf))
    return rows.select("id", *(F.round(c, 5).alias(c) for c in ("cohesion", "contrast", "boundary", "specificity")))


@query(f"WITH {CASES}, x AS (SELECT doc_id, s, len(s) AS k, l.npmi IS NOT NULL AS x1, m.npmi IS NOT NULL AS x2 FROM ca LEFT JOIN np l ON l.a = s[len(s) - 2] AND l.b = s[len(s) - 1] AND l.npmi >= 0.05 LEFT JOIN np m ON m.a = s[len(s) - 3] AND m.b = s[len(s) - 2] AND m.npmi >= 0.05) SELECT doc_id AS \"case\", (2 + x1::INT + (x1 AND k > 3 AND x2)::INT)::INT AS n FROM x")
def extended_spans(spark, sf):
    cases = _spans(spark, sf).select(F.col("id").alias("case"), "words", F.sequence(F.lit(2), F.size("words")).alias("sizes"))
    return terms.extend_span(cases, terms.association(_docs(spark, sf)), 0.05)


@query(f"WITH {WORDS}, k AS (SELECT word, n FROM uni WHERE n >= 3) SELECT 'words' AS kind, count(*) AS entries, sum(n)::BIGINT AS n FROM k UNION ALL SELECT 'pairs', count(*), sum(n)::BIGINT FROM big WHERE n >= 2 AND a IN (SELECT word FROM k) AND b IN (SELECT word FROM k)")
def pruned_statistics(spark, sf):
    docs = _docs(spark, sf)
    uni, pairs = terms.pruned(terms.unigrams(docs), terms.bigrams(docs), 3, 2)
    return uni.agg(F.lit("words").alias("kind"), F.count("*").alias("entries"), F.sum("n").alias("n")).union(pairs.agg(F.lit("pairs").alias("kind"), F.count("*").alias("entries"), F.sum("n").alias("n")))


@query()
def cascade_extraction(spark, sf):
    rows = rel.harvest(_defined(spark, sf))
    return rel.long_forms(rows, rel.estimate(rows), 0.5).select("doc_id", "short", "long", "strategy")


@query()
def reranked_extraction(spark, sf):
    rows = rel.kept(rel.harvest(_defined(spark, sf)), "harvest")
    return rel.reranked(rows, rel.estimate(rows), 0.5).select("doc_id", "short", "long")


@query("SELECT id, string_agg('Q' || chr((65 + (v // 17576) % 26)::INT) || chr((65 + (v // 676) % 26)::INT) || chr((65 + (v // 26) % 26)::INT) || chr((65 + v % 26)::INT), '_' ORDER BY v) AS identifier FROM (SELECT id, id * 18 + j AS v FROM (SELECT unnest(range(0, 500)) AS id), (SELECT unnest(range(0, 18)) AS j)) GROUP BY id")
def novel_identifiers(spark, sf):
    return wl.novel_identifiers(spark, 500)


POOL = ["CUST", "ACCT", "TXN", "AMT", "CD", "DT", "ID", "NM", "STAT", "TYPE"]


@query(f"SELECT id, string_agg({POOL!r}[((id * 7919 + j * 104729 + (id * j) % 9973) % 10) + 1], '_' ORDER BY j) AS identifier FROM (SELECT unnest(range(0, 500)) AS id), (SELECT unnest(range(0, 6)) AS j) WHERE j < [3, 4, 6][(id * 31 % 3) + 1] GROUP BY id")
def schema_identifiers(spark, sf):
    return wl.schema_identifiers(spark, 500, POOL, [3, 4, 6])


@query(f"WITH {DEF} SELECT cause, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'search budget' WHEN 1 THEN 'short words' ELSE 'unrepresentable' END AS cause FROM df WHERE length(replace(long, ' ', '')) - length(short) >= 0) GROUP BY cause")
def coverage_causes(spark, sf):
    third = F.col("doc_id") % 3
    rows = _defined(spark, sf).select("doc_id", F.when(third == 0, "ABC").when(third == 1, "AXC").otherwise("QQQ").alias("short"), F.when(third == 0, "Alpha Beta Core").when(third == 1, "Alpha x Core").otherwise("Alpha Beta Core").alias("long"))
    return wl.coverage_causes(rows).groupBy("cause").agg(F.count("*").alias("n"))
