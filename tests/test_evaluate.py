"""Places of short and long forms against loops."""

from pyspark.sql import functions as F

from glosswright.operators import evaluate as ev
from glosswright.operators import reliability as rel
from glosswright.operators.vocabulary import literal


def test_occurrences(spark):
    rows = [("aaaa", "aa"), ("xABxAB", "AB"), ("AB", "AB"), ("nothing", "AB"), ("a.b a.b", "a.b"), ("", "a"), ("abc", ""), ("été été", "té")]
    got = literal(spark, rows, "t string, n string").select("t", "n", ev.occurrences(F.col("t"), F.col("n")).alias("o")).collect()
    for r in got:
        want = [i for i in range(len(r["t"])) if r["n"] and r["t"].startswith(r["n"], i)]
        assert [x["begin"] for x in r["o"]] == want and [x["stop"] for x in r["o"]] == [i + len(r["n"]) for i in want]


def test_bracketed_is_linear_and_whole(spark):
    rows = [("one two (AB) then (c d) ((x) y) (" + "z" * 31 + ") () (EF", 1), ("a ) b (GH)", 2), ("word " * 40000 + "(IJ) " + "tail " * 40000, 3), (None, 4)]
    got = {r["i"]: [(x["short"], x["before"][-8:]) for x in r["b"]] for r in literal(spark, rows, "t string, i int").select("i", rel.bracketed(F.col("t")).alias("b")).collect()}
    assert got == {1: [("AB", "one two "), ("c d", " then "), ("x", "")], 2: [("GH", " b ")], 3: [("IJ", "rd word ")], 4: []}
