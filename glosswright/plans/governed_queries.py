"""Queries over identifiers made from the part table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as fi
from ..operators import governed as g
from ..operators import vocabulary as v

#: Names in six styles, in SQL that both engines read.
BASE = "upper(replace(p_name, ' ', '_')) || '_' || p_type || '_CD'"
CAMEL = "split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'Cd'"
STYLED = f"CASE p_partkey % 6 WHEN 0 THEN {BASE} WHEN 1 THEN {CAMEL} WHEN 2 THEN {BASE} || '_' || cast(p_size as varchar(9)) WHEN 3 THEN 'dw.' || {BASE} WHEN 4 THEN lower({BASE}) || '#' ELSE replace({BASE}, '_CD', '') END"
IDS_SQL = f"ids AS (SELECT p_partkey AS id, {STYLED} AS identifier FROM part)"

CATALOG = [
    ("CD", "Code", ["Code"], None, "class_word_abbrev", True, "Code", "E01", "governed", 1.0),
    ("PROMO", "Promotion", [], None, "approved_abbrev", True, None, "E02", "governed", 0.9),
    ("ECONOMY", "Economy Grade", [], None, "unapproved_expansion", False, None, "E03", "governed", 0.8),
    ("ECG", "Economy Grade", [], None, "approved_abbrev", True, None, "E04", "governed", 0.95),
    ("STANDARD", "Standards", ["Standards", "Standard", "Standardized"], None, "ambiguous_pinned", False, None, "E05", "scored", 0.5),
    ("MEDIUM", "Medium", ["Mediums", "Medium"], "Medium", "ambiguous_pinned", True, None, "E06", "pinned", 0.7),
    ("LARGE", "Large", [], None, "short_full_word", False, None, "E07", "governed", 1.0),
    ("SMALL", "Small", [], None, "short_full_word", False, None, "E08", "governed", 1.0),
    ("RING", "Ringing", ["Ringing", "Rings", "Ring"], None, "ambiguous_pinned", False, None, "E09", "scored", 0.5),
    ("BOLT", "Bolt", [], None, "approved_abbrev", True, None, "E10", "governed", 1.0),
    ("WIDGET", "Widget", [], None, "unapproved_expansion", False, None, "E11", "governed", 0.6),
    ("WDG", "Widget", [], None, "approved_abbrev", True, None, "E12", "governed", 0.9),
    ("GEAR", "Gear Assembly", [], None, "domain_pin", True, None, "E13", "governed", 0.9),
    ("RED", "Red", [], None, "proper_noun_acronym", False, None, "E14", "governed", 1.0),
    ("BLUE", "Blue", ["Blue", "Bluely"], None, "ambiguous_pinned", False, None, "E15", "scored", 0.5),
    ("DW", "Data Warehouse", [], None, "approved_abbrev", True, None, "E16", "governed", 1.0),
    ("VAL", "Value", [], None, "class_word_abbrev", True, "Value", "E17", "governed", 1.0),
]
OVERLAY = [(0, "RED", "Crimson"), (1, "RED", "Scarlet"), (0, "ANVIL", "Anvil Block"), (0, "BOLT", "Bolt")]
ALLOW = [("approved_abbreviations", "HOT"), ("common_keywords", "NEW"), ("common_keywords", "HOT"), ("short_full_words", "OLD")]
CLASSES = [("AMT", "Amount"), ("CD", "Code"), ("VAL", "Value"), ("ECG", "Grade")]
TERMS = [("Small Ring Promotion Code", "T-1"), ("Scarlet Widget Economy Grade Code", "T-2"), ("Bolt", "T-3")]
PINS = [("BLUE", ["Blue", "Bluely"], "Blue"), ("ROD", ["Rod", "Rodding"], None), ("PLATE", ["Plate"], "Plate")]


def _lit(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return f"{[*x]!r}::VARCHAR[]"
    return f"'{x}'" if isinstance(x, str) else str(x)


def _values(rows, names):
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS t({names}))"


SCORE_SQL = f"""(CASE WHEN regexp_matches(token, '^[A-Za-z]{{2}}$') AND lower(c) IN ({", ".join(map(repr, fi.STATES))}) THEN 100.0 ELSE 0.0 END
 + CASE WHEN lower(c) LIKE '%ing' THEN 50.0 ELSE 0.0 END + CASE WHEN lower(c) LIKE '%ly' THEN 40.0 ELSE 0.0 END
 + CASE WHEN lower(c) LIKE '%ed' AND string_split(lower(c), ' ')[-1] NOT IN ({", ".join(map(repr, fi.PAST_TENSE_NOUNS))}) THEN 30.0 ELSE 0.0 END
 + CASE WHEN lower(c) LIKE '%s' AND string_split(lower(c), ' ')[-1] NOT IN ({", ".join(map(repr, fi.SINGULAR_PLURALS))}) THEN 20.0 ELSE 0.0 END
 + CASE WHEN c LIKE '% %' THEN 10.0 ELSE 0.0 END + length(c))"""

SPLIT_SQL = r"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 identifier, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'),
 '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' '), lambda x: x <> '')"""

TITLE_SQL = "upper(left(token, 1)) || lower(substr(token, 2))"


def prefix(policy: v.Policy = v.POLICIES["governed_default"]) -> str:
    if policy.mode == "most_common":
        long = "coalesce(k.candidates[1], k.canonical)"
        how = "CASE WHEN keep AND coalesce(k.candidates[1], k.canonical) <> k.canonical THEN 'governed' END"
    else:
        long, how = "coalesce(k.pin, b.best, k.canonical)", "CASE WHEN k.pin IS NOT NULL THEN 'pinned' WHEN b.best IS NOT NULL THEN 'scored' END"
    return f"""WITH {IDS_SQL},
toks AS (SELECT id, identifier, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT id, identifier, {SPLIT_SQL} AS ts FROM ids)),
cat AS {_values(CATALOG, "token, canonical, candidates, pin, kind, keep, class_word, entry_id, source, confidence")},
overlay0 AS {_values(OVERLAY, "layer, token, canonical")},
overlay AS (SELECT token, arg_max(canonical, layer) AS custom FROM overlay0 GROUP BY token),
allow0 AS {_values(ALLOW, "list, token")},
allow AS (SELECT token, min(CASE list WHEN 'approved_abbreviations' THEN 0 WHEN 'common_keywords' THEN 1 ELSE 2 END) AS listed FROM allow0 GROUP BY token),
classes AS {_values(CLASSES, "abbrev, full_name")},
terms AS {_values(TERMS, "logical_name, term_id")},
cand AS (SELECT token, unnest(candidates) AS c FROM cat WHERE len(candidates) > 1),
best AS (SELECT token, first(c ORDER BY {SCORE_SQL}, c) AS best FROM cand GROUP BY token),
own AS (SELECT k.token, {long} AS long, coalesce({how}, CASE WHEN keep THEN 'approved' ELSE 'governed' END) AS source, entry_id, confidence, kind, keep, class_word, canonical
        FROM cat k LEFT JOIN best b USING (token)),
joined AS (SELECT coalesce(o.token, c.token) AS token, o.* EXCLUDE (token), c.custom,
           c.custom IS NOT NULL AND (o.long IS NULL OR {str(policy.allow_override).lower()} OR lower(c.custom) = lower(o.long)) AS wins
           FROM own o FULL JOIN overlay c ON o.token = c.token),
res AS (
  SELECT token, CASE WHEN wins THEN custom ELSE long END AS long, CASE WHEN wins THEN 'custom' ELSE source END AS source,
         CASE WHEN wins THEN NULL ELSE entry_id END AS entry_id, CASE WHEN wins THEN 1.0 ELSE confidence END AS confidence,
         CASE WHEN wins THEN 'approved_abbrev' ELSE kind END AS kind, CASE WHEN wins THEN false ELSE keep END AS keep, CASE WHEN wins THEN NULL ELSE class_word END AS class_word, CASE WHEN wins THEN custom ELSE canonical END AS canonical FROM joined
  UNION ALL
  SELECT token, {TITLE_SQL}, 'approved', NULL, 1.0, CASE WHEN listed = 2 THEN 'short_full_word' ELSE 'approved_abbrev' END, true, NULL, {TITLE_SQL}
  FROM allow WHERE token NOT IN (SELECT token FROM joined)),
cw AS (SELECT token, arg_min(class_word, rank) AS cw FROM (
  SELECT token, class_word, 0 AS rank FROM cat WHERE class_word IS NOT NULL AND token NOT IN (SELECT token FROM overlay) UNION ALL SELECT upper(abbrev), full_name, 1 FROM classes UNION ALL SELECT upper(full_name), full_name, 2 FROM classes) GROUP BY token),
approved AS (SELECT token FROM overlay UNION SELECT token FROM cat WHERE keep UNION SELECT token FROM allow),
forms AS (SELECT DISTINCT token, confidence, canonical, unnest(list_concat([canonical], candidates)) AS form FROM cat),
rev AS (SELECT lower(form) AS key, first(token ORDER BY (lower(form) <> lower(canonical))::INT, length(token), token) AS short FROM forms GROUP BY 1),
et AS (SELECT t.id, t.identifier, t.pos, t.token, upper(t.token) AS up, r.long IS NOT NULL AS is_known, coalesce(r.long, {TITLE_SQL.replace("token", "t.token")}) AS long,
       coalesce(r.source, 'passthrough') AS source, r.entry_id, coalesce(r.confidence, 0.0) AS confidence, coalesce(r.kind, 'passthrough') AS kind,
       coalesce(r.class_word, cw.cw) AS class_word, coalesce(r.keep, false) AS keep, r.canonical
       FROM toks t LEFT JOIN res r ON r.token = upper(t.token) LEFT JOIN cw ON cw.token = upper(t.token)),
judged AS (SELECT et.*, CASE WHEN NOT regexp_matches(up, '[A-Z]') THEN NULL WHEN source = 'custom' THEN 'custom_abbrev' WHEN a.listed = 0 THEN 'approved_abbrev'
  WHEN a.listed = 1 THEN 'common_keyword' WHEN a.listed = 2 THEN 'short_full_word' WHEN is_known AND kind = 'proper_noun_acronym' THEN 'proper_noun_acronym'
  WHEN is_known AND kind = 'short_full_word' THEN 'short_full_word' WHEN is_known AND (kind = 'class_word_abbrev' OR keep OR p.token IS NOT NULL) THEN 'approved_abbrev'
  WHEN p.token IS NOT NULL THEN 'approved_abbrev' ELSE 'unapproved_abbrev' END AS code,
  CASE WHEN rv.short <> up AND rv.short IN (SELECT token FROM approved) THEN rv.short END AS short
  FROM et LEFT JOIN allow a ON a.token = up LEFT JOIN approved p ON p.token = up LEFT JOIN rev rv ON rv.key = lower(et.canonical)),
j AS (SELECT * EXCLUDE (short), CASE WHEN code = 'unapproved_abbrev' AND is_known THEN short END AS fix FROM judged),
expanded AS (SELECT i.id, i.identifier, coalesce(string_agg(long, ' ' ORDER BY pos), '') AS logical_name,
  coalesce(bool_and(is_known), true) AND NOT regexp_matches(i.identifier, '#') AS fully_known, coalesce(min(confidence), 0.0) AS confidence,
  arg_max(class_word, pos) FILTER (WHERE pos = last_pos) AS class_word, count(token) AS n_tokens, coalesce(string_agg(token, '' ORDER BY pos) FILTER (WHERE false), CASE WHEN i.identifier LIKE '%#' THEN '#' ELSE '' END) AS unaccounted
  FROM ids i LEFT JOIN (SELECT *, max(pos) OVER (PARTITION BY id) AS last_pos FROM et) e ON e.id = i.id GROUP BY i.id, i.identifier),
nm AS (SELECT i.id, i.identifier, count(j.token) AS n, string_agg(up, '_' ORDER BY pos) AS upname, string_agg(coalesce(fix, up), '_' ORDER BY pos) AS fixed,
  max(class_word) FILTER (WHERE pos = last_pos) AS class_word
  FROM ids i LEFT JOIN (SELECT *, max(pos) OVER (PARTITION BY id) AS last_pos FROM j) j ON j.id = i.id GROUP BY i.id, i.identifier),
findings AS (
  SELECT id, pos AS seq, token, CASE WHEN code = 'unapproved_abbrev' THEN 'fail' ELSE 'pass' END AS verdict, code, fix FROM j WHERE code IS NOT NULL
  UNION ALL SELECT id, 0, NULL, 'fail', 'empty_name', NULL FROM nm WHERE n = 0
  UNION ALL SELECT id, 1000000, NULL, 'fail', 'not_upper_snake', upname FROM nm WHERE n > 0 AND NOT regexp_matches(identifier, '^[A-Z0-9]+(_[A-Z0-9]+)*$')
  UNION ALL SELECT id, 1000001, NULL, 'fail', 'missing_class_word', upname || '_VAL' FROM nm WHERE {str(policy.require_trailing_class_word).lower()} AND n > 0 AND class_word IS NULL
  UNION ALL SELECT id, 1000002, NULL, 'fail', 'exceeds_max_length', CASE WHEN fixed <> identifier AND length(fixed) <= {policy.max_name_length} THEN fixed END
    FROM nm WHERE {str(policy.enforce_name_length).lower()} AND n > 0 AND length(identifier) > {policy.max_name_length})
"""


def _ids(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", STYLED.replace("varchar(9)", "string") + " AS identifier")


def _vocabulary(spark):
    return v.vocabulary(spark, CATALOG, OVERLAY, ALLOW, CLASSES, TERMS)


DEFAULT, STRICT = v.POLICIES["governed_default"], v.POLICIES["strict_length"].but(max_name_length=18)
QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {IDS_SQL} SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT id, {SPLIT_SQL} AS ts FROM ids)")
def split_identifier(spark, sf):
    return g.tokens_of(_ids(spark, sf)).select("id", "pos", "token")


@query(f"WITH {IDS_SQL} SELECT id, '#' AS ch, length(identifier) - length(replace(identifier, '#', '')) AS n FROM ids WHERE identifier LIKE '%#%'")
def unaccounted_chars(spark, sf):
    return _ids(spark, sf).select("id", F.explode(fi.unaccounted(F.col("identifier"))).alias("ch")).groupBy("id", "ch").agg(F.count("*").alias("n"))


@query(f"WITH {IDS_SQL} SELECT id, string_split(identifier, '.')[-1] AS leaf FROM ids")
def strip_qualifier(spark, sf):
    return _ids(spark, sf).select("id", fi.strip_qualifier(F.col("identifier")).alias("leaf"))


@query(f"SELECT id, unnest(ts) AS part, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT p_partkey AS id, string_split(regexp_replace({CAMEL}, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') AS ts FROM part)")
def camel_split(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", CAMEL + " AS name")
    return rows.select("id", F.posexplode(fi.split_camel_case(F.col("name"))).alias("pos", "part"))


@query(f"WITH {IDS_SQL} SELECT regexp_matches(identifier, '^[A-Z0-9]+(_[A-Z0-9]+)*$') AS ok, count(*) AS n FROM ids GROUP BY 1")
def upper_snake(spark, sf):
    return _ids(spark, sf).groupBy(fi.is_upper_snake(F.col("identifier")).alias("ok")).agg(F.count("*").alias("n"))


@query(f"{prefix()} SELECT token, c AS candidate, {SCORE_SQL} AS score FROM cand")
def collision_score(spark, sf):
    rows = _vocabulary(spark).catalog.where(F.size("candidates") > 1).select("token", F.explode("candidates").alias("candidate"))
    return rows.withColumn("score", fi.canonical_form_score(F.col("candidate"), F.col("token")))


@query(f"{prefix()} SELECT id, pos, token, long, is_known, source, entry_id, confidence, kind, class_word FROM et")
def expand_token(spark, sf):
    rows = g.expand_tokens(g.tokens_of(_ids(spark, sf)), _vocabulary(spark), DEFAULT)
    return rows.select("id", "pos", "token", "long", "is_known", "source", "entry_id", "confidence", "kind", "class_word")


@query(f"{prefix()} SELECT id, identifier, logical_name, fully_known, confidence, class_word, n_tokens, unaccounted FROM expanded")
def expand_identifier(spark, sf):
    return g.expand_identifiers(_ids(spark, sf), _vocabulary(spark), DEFAULT)


@query(" UNION ALL ".join(f"(SELECT '{name}' AS policy, * FROM ({prefix(p)} SELECT token, long, source FROM res))" for name, p in v.POLICIES.items()))
def policy_contrast(spark, sf):
    out = None
    for name, p in v.POLICIES.items():
        rows = _vocabulary(spark).resolved(p).select(F.lit(name).alias("policy"), "token", "long", "source")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{prefix(v.POLICIES['frequency_baseline'])} SELECT token, long, source, confidence FROM res WHERE token IN (SELECT token FROM overlay)")
def overlay_precedence(spark, sf):
    vocab = _vocabulary(spark)
    return vocab.resolved(v.POLICIES["frequency_baseline"]).join(vocab.overlay.select("token"), "token", "left_semi").select("token", "long", "source", "confidence")


@query(f"{prefix()} SELECT key, short FROM rev")
def reverse_index(spark, sf):
    return _vocabulary(spark).reverse().select("key", "short")


@query(f"{prefix()} SELECT token, cw AS class_word FROM cw")
def class_word(spark, sf):
    return _vocabulary(spark).class_words()


@query(f"{prefix()} SELECT e.id, e.logical_name, t.term_id FROM expanded e JOIN terms t ON lower(t.logical_name) = lower(e.logical_name)")
def term_id(spark, sf):
    vocab = _vocabulary(spark)
    rows = g.expand_identifiers(_ids(spark, sf), vocab, DEFAULT).select("id", "logical_name")
    return rows.join(vocab.small(vocab.terms.select("key", "term_id")), fi.phrase_key(F.col("logical_name")) == F.col("key")).drop("key")


@query(f"{prefix(STRICT)} SELECT id, seq, token, verdict, code, fix FROM findings")
def compliance_findings(spark, sf):
    return g.compliance_findings(_ids(spark, sf), _vocabulary(spark), STRICT)


SUMMARY_SQL = "SELECT i.id, count(*) FILTER (WHERE verdict = 'fail') = 0 AS compliant, count(f.code) AS n_findings, count(*) FILTER (WHERE verdict = 'fail') AS n_failures FROM ids i LEFT JOIN findings f ON f.id = i.id GROUP BY i.id"


@query(f"{prefix()} {SUMMARY_SQL}")
def compliance_summary(spark, sf):
    return g.compliance_summary(_ids(spark, sf), _vocabulary(spark), DEFAULT)


@query(f"{prefix()} SELECT id, identifier, coalesce(fixed, '') AS normalized FROM nm")
def normalize_names(spark, sf):
    return g.normalize(_ids(spark, sf), _vocabulary(spark), DEFAULT)


@query("SELECT 0::BIGINT AS changed")
def normalize_idempotent(spark, sf):
    vocab = _vocabulary(spark)
    once = g.normalize(_ids(spark, sf), vocab, DEFAULT).select("id", F.col("normalized").alias("identifier"))
    return g.normalize(once, vocab, DEFAULT).agg(F.coalesce(F.sum((F.col("identifier") != F.col("normalized")).cast("long")), F.lit(0)).alias("changed"))


def physical_sql(policy, names, append):
    """Greedy longest match, one position at a time, in a recursive query."""
    tail = "CASE WHEN c.token IS NULL THEN physical || '_VAL' ELSE physical END" if append else "physical"
    return f"""{prefix(policy).replace("WITH ids", "WITH RECURSIVE ids", 1)},
names AS ({names}), w AS (SELECT id, logical, list_filter(string_split(logical, ' '), lambda x: x <> '') AS w FROM names),
idx AS (SELECT key, first(short ORDER BY rank, short) AS short, first(confidence ORDER BY rank, short) AS confidence FROM (
  SELECT r.key, r.short, c.confidence, 1 AS rank FROM rev r JOIN cat c ON c.token = r.short UNION ALL SELECT lower(custom), token, 1.0, 0 FROM overlay) GROUP BY key),
gov AS (SELECT token, min(confidence) AS confidence FROM (SELECT token, confidence FROM cat UNION ALL SELECT token, 1.0 FROM overlay UNION ALL SELECT token, 1.0 FROM approved) GROUP BY token),
sp AS (SELECT id, a.i AS p0, n.n AS n, array_to_string(w[a.i + 1 : a.i + n.n], ' ') AS text FROM w, (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(1, (SELECT max(len(string_split(key, ' '))) FROM idx) + 1)) AS n) n WHERE a.i + n.n <= len(w)),
ch AS (SELECT sp.id, p0, n, CASE WHEN o.token IS NOT NULL THEN o.token WHEN idx.short IS NOT NULL THEN idx.short WHEN n = 1 THEN upper(text) END AS short,
  CASE WHEN o.token IS NOT NULL THEN o.confidence WHEN idx.short IS NOT NULL THEN idx.confidence WHEN ap.token IS NOT NULL THEN 1.0 ELSE 0.0 END AS sure, o.token IS NOT NULL AS own
  FROM sp LEFT JOIN idx ON idx.key = lower(text) LEFT JOIN gov o ON n = 1 AND o.token = text AND upper(text) = text AND regexp_matches(text, '[A-Z]')
  LEFT JOIN approved ap ON n = 1 AND ap.token = upper(text)),
bst AS (SELECT id, p0, first(n ORDER BY own DESC, n DESC) AS n, first(short ORDER BY own DESC, n DESC) AS short, first(sure ORDER BY own DESC, n DESC) AS sure FROM ch WHERE short IS NOT NULL GROUP BY id, p0),
walk AS (SELECT id, 0::BIGINT AS free, ''::VARCHAR AS physical, 1.0::DOUBLE AS sure, ''::VARCHAR AS last FROM w
  UNION ALL SELECT k.id, k.free + b.n, CASE WHEN physical = '' THEN short ELSE physical || '_' || short END, least(k.sure, b.sure), short FROM walk k JOIN bst b ON b.id = k.id AND b.p0 = k.free),
fin AS (SELECT w.id, w.logical, arg_max(k.physical, k.free) AS physical, CASE WHEN max(k.free) = 0 THEN 0.0 ELSE arg_max(k.sure, k.free) END AS confidence, arg_max(k.last, k.free) AS last FROM walk k JOIN w ON w.id = k.id GROUP BY w.id, w.logical),
phys AS (SELECT f.id, f.logical, CASE WHEN f.physical = '' THEN '' ELSE {tail} END AS physical, f.confidence, t.term_id FROM fin f LEFT JOIN (SELECT DISTINCT token FROM cw) c ON c.token = f.last LEFT JOIN terms t ON lower(t.logical_name) = lower(f.logical))"""


@query(physical_sql(DEFAULT, "SELECT id, logical_name AS logical FROM expanded", True) + " SELECT id, logical, physical, confidence, term_id FROM phys")
def to_physical_name(spark, sf):
    vocab = _vocabulary(spark)
    names = g.expand_identifiers(_ids(spark, sf), vocab, DEFAULT).select("id", F.col("logical_name").alias("logical"))
    return g.to_physical(names, vocab, DEFAULT)


@query(
    physical_sql(DEFAULT, "SELECT min(id) AS id, logical_name AS logical FROM expanded GROUP BY identifier, logical_name", False)
    + " SELECT CASE WHEN p.physical = n.identifier THEN 'stable' WHEN p.physical = coalesce(n.fixed, '') THEN 'corrected' ELSE 'inconsistent' END AS outcome, count(*) AS n FROM phys p JOIN nm n ON n.id = p.id GROUP BY 1"
)
def round_trip_breaks(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), DEFAULT).round_trip().groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    f"""{prefix()}, per AS (SELECT i.identifier, count(*) AS occ, min(i.id) AS id FROM ids i GROUP BY 1),
summ AS ({SUMMARY_SQL}), anyk AS (SELECT id, bool_or(is_known) AS anyk FROM et GROUP BY id)
SELECT sum(occ)::BIGINT AS identifiers, count(*) AS distinct_identifiers, coalesce(sum(occ) FILTER (WHERE n_tokens = 0), 0)::BIGINT AS empty, coalesce(sum(occ) FILTER (WHERE fully_known), 0)::BIGINT AS fully_known,
coalesce(sum(occ) FILTER (WHERE NOT fully_known AND anyk), 0)::BIGINT AS partially_known, coalesce(sum(occ) FILTER (WHERE compliant), 0)::BIGINT AS compliant
FROM per JOIN expanded e ON e.id = per.id JOIN summ s ON s.id = per.id LEFT JOIN anyk ON anyk.id = per.id"""
)
def audit_summary(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), DEFAULT).summary()


BACKLOG_SQL = f"""{prefix()}, per AS (SELECT identifier, count(*) AS occ, min(id) AS id FROM ids GROUP BY 1),
u AS (SELECT e.up AS token, per.id, per.identifier, per.occ, count(*) AS k FROM et e JOIN per ON per.id = e.id WHERE NOT is_known AND regexp_matches(e.token, '[A-Za-z]') GROUP BY ALL),
backlog AS (SELECT token, sum(k * occ)::BIGINT AS occurrences, sum(occ)::BIGINT AS identifier_rows, array_to_string(list(identifier ORDER BY id)[1:3], '|') AS examples FROM u GROUP BY token)"""


@query(BACKLOG_SQL + " SELECT * FROM backlog")
def unknown_backlog(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), DEFAULT).backlog()


@query(f"{prefix(STRICT)} SELECT code, count(*) AS occurrences FROM findings WHERE verdict = 'fail' GROUP BY code")
def finding_tally(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), STRICT).findings()


@query(BACKLOG_SQL + " SELECT b.token, b.occurrences, r.short AS proposal FROM backlog b LEFT JOIN rev r ON r.key = lower(b.token) AND r.short IN (SELECT token FROM approved)")
def suggestions(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), DEFAULT).suggestions()


LONGS = "SELECT row_number() OVER (ORDER BY p_partkey) AS ord, upper(left(p_name, 2)) AS short, upper(left(p_name, 1)) || substr(p_name, 2) AS long FROM part"


@query(
    f"""WITH p AS ({LONGS}), f AS (SELECT short AS token, long AS c, min(ord) AS ord FROM p GROUP BY ALL)
SELECT token, first(c ORDER BY {SCORE_SQL}, c) AS canonical, count(*) AS n_candidates, first(c ORDER BY ord) AS first_candidate, CASE WHEN count(*) > 1 THEN 0.5 ELSE 1.0 END AS confidence, CASE WHEN count(*) > 1 THEN 'scored' ELSE 'governed' END AS source FROM f GROUP BY token"""
)
def invert_catalog(spark, sf):
    pairs = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS ord", "upper(left(p_name, 2)) AS short", "upper(left(p_name, 1)) || substr(p_name, 2) AS long")
    return v.invert(pairs).select("token", "canonical", F.size("candidates").cast("long").alias("n_candidates"), F.element_at("candidates", 1).alias("first_candidate"), "confidence", "source")


@query(
    f"""WITH cat AS {_values(CATALOG, "token, canonical, candidates, pin, kind, keep, class_word, entry_id, source, confidence")}, pins AS {_values(PINS, "token, candidates, pin")}
SELECT coalesce(c.token, p.token) AS token, coalesce(c.canonical, p.pin, p.candidates[1]) AS canonical, coalesce(c.pin, p.pin) AS pin, c.token IS NULL AS minted, CASE WHEN c.token IS NULL AND p.pin IS NULL THEN 0.5 ELSE 1.0 END AS confidence FROM cat c FULL JOIN pins p ON c.token = p.token"""
)
def merge_pins(spark, sf):
    pins = v.literal(spark, PINS, "token string, candidates array<string>, pin string")
    return v.merge_pins(_vocabulary(spark).catalog, pins).select("token", "canonical", "pin", "minted", "confidence")


@query(f"WITH o AS {_values(OVERLAY, 'layer, token, canonical')} SELECT token, arg_max(canonical, layer) AS canonical FROM o GROUP BY token")
def layer_overlays(spark, sf):
    return _vocabulary(spark).overlay.select("token", "canonical")


#: Tokens that begin with digits, and an overlay of whole entries.
DIGITS = [("1MM", "One Million", [], None, "approved_abbrev", True, None, "D1", "governed", 1.0), ("7DAY", "Seven Day", [], None, "approved_abbrev", True, None, "D2", "governed", 1.0), ("RATE", "Rate", [], None, "approved_abbrev", True, "Rate", "D3", "governed", 1.0)]
WHOLE = [(0, "RATE", " Interest  Rate ", "X9", 0.75, "domain_pin", True, "Percent", ["Rate"]), (0, "MM", " ", None, None, None, None, None, None)]
DIGIT_IDS = "'RATE_' || p_size || CASE p_partkey % 3 WHEN 0 THEN 'MM' WHEN 1 THEN 'DAY' ELSE '_MM_2' END || '_RATE'"


def _digit_rows(spark, sf):
    ids = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", DIGIT_IDS + " AS identifier")
    return ids, v.vocabulary(spark, DIGITS, WHOLE)


@query(
    f"""WITH s AS (SELECT p_partkey AS id, p_size, p_partkey % 3 AS k FROM part),
j AS (SELECT id, CASE WHEN k <> 1 AND p_size = 1 THEN ['RATE', '1MM'] WHEN k = 1 AND p_size = 7 THEN ['RATE', '7DAY'] ELSE ['RATE', p_size::VARCHAR, CASE k WHEN 1 THEN 'DAY' ELSE 'MM' END] END || CASE k WHEN 2 THEN ['2', 'RATE'] ELSE ['RATE'] END AS t FROM s)
SELECT id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM j"""
)
def rejoin_digits(spark, sf):
    ids, vocab = _digit_rows(spark, sf)
    return g.tokens_of(ids, vocab).select("id", "token", "pos")


@query(
    """WITH s AS (SELECT p_partkey AS id, p_size, p_partkey % 3 AS k FROM part)
SELECT id, 'Interest Rate ' || CASE WHEN k <> 1 AND p_size = 1 THEN 'One Million' WHEN k = 1 AND p_size = 7 THEN 'Seven Day' ELSE p_size || CASE k WHEN 1 THEN ' Day' ELSE ' Mm' END END || CASE k WHEN 2 THEN ' 2' ELSE '' END || ' Interest Rate' AS logical_name,
CASE WHEN k <> 2 AND ((k = 0 AND p_size = 1) OR (k = 1 AND p_size = 7)) THEN 0.75 ELSE 0.0 END AS confidence, 'Percent' AS class_word FROM s"""
)
def whole_overlay_entries(spark, sf):
    ids, vocab = _digit_rows(spark, sf)
    return g.expand_identifiers(ids, vocab, DEFAULT).select("id", "logical_name", "confidence", "class_word")


@query(f"{prefix()} SELECT up AS token, sum(occ)::BIGINT AS occurrences FROM et JOIN (SELECT identifier, count(*) AS occ, min(id) AS id FROM ids GROUP BY 1) p ON p.id = et.id WHERE NOT is_known AND NOT regexp_matches(up, '[A-Z]') GROUP BY up")
def letterless_tokens(spark, sf):
    return g.Audit(_ids(spark, sf), _vocabulary(spark), DEFAULT).ordinals()
