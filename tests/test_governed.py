"""Tokens that begin with digits in a large vocabulary."""

from pyspark.sql import functions as F

from glosswright.operators import governed as g
from glosswright.operators.vocabulary import Vocabulary, literal


def test_digits_join_beyond_the_bound(spark):
    n = 10_050
    empty = literal(spark, [], "layer int, token string, canonical string")
    allow, classes, terms = literal(spark, [], "list string, token string"), literal(spark, [], "abbrev string, full string"), literal(spark, [], "logical_name string, term_id string")
    vocabulary = Vocabulary(spark.range(n).select(F.concat("id", F.lit("q")).alias("token")), empty, allow, classes, terms)
    ids = spark.range(n + 50).select("id", F.concat(F.lit("AB_"), "id", F.lit("_Q_"), "id", F.lit("_X")).alias("identifier"))
    got = g.tokens_of(ids.unionByName(literal(spark, [(-1, ""), (-2, None)], "id long, identifier string")), vocabulary)
    per = got.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("t")).collect()
    assert {r["id"]: r["t"] for r in per} == {i: f"AB {i}Q {i} X" if i < n else f"AB {i} Q {i} X" for i in range(n + 50)}
