"""The beam of long phrases against a search of every acronym."""

import pytest
from pyspark.sql import functions as F

from glosswright.operators import generate as gen
from glosswright.operators.vocabulary import literal

PHRASE = "institute of the advanced study on numerical methods for physics"
STOPS = {"of", "the", "on", "for"}


def _best(words, w, cap=2, longest=6):
    """The best (score without phi and lexicon) of each acronym, over every alignment."""
    states = {"": (0, 0)}  # chars: (taken, loss); a better value of equal chars stays better
    for word in words:
        new = {}
        for chars, (taken, loss) in states.items():
            for k in range(min(cap, len(word)) + 1):
                c, s = chars + word[:k].upper(), (taken + (k > 0), loss + (k == 0 and word not in STOPS))
                if len(c) <= longest and (c not in new or value(c, *s, w) > value(c, *new[c], w)):
                    new[c] = s
        states = new
    return {c: value(c, *s, w) for c, s in states.items() if len(c) > 1}


def value(chars, taken, loss, w):
    return w.alpha * (taken * 10.0 + (len(chars) - taken) * 2.0) - w.delta * loss - w.length_penalty * max(len(chars) - w.preferred_length, 0)


@pytest.mark.parametrize("preset", ["strict_initialism", "max_pronounceable"])
def test_long_phrase_with_stop_words(spark, preset):
    w, words = gen.PRESETS[preset], PHRASE.split()
    assert 3 ** len(words) > gen.NODES
    phrases = literal(spark, [(1, PHRASE)], "id int, phrase string")
    token = F.transform(F.split("phrase", " "), lambda x: F.struct(x.alias("text"), F.upper(x).alias("letters"), (~x.isin(*STOPS)).alias("critical")))
    rows = gen.candidates(phrases.select("id", token.alias("tokens")), w).collect()
    got = {r["acronym"]: value(r["acronym"], r["taken"], r["loss"], w) for r in rows}
    want = _best(words, w)
    assert "IOTASO" in got
    if preset == "strict_initialism":
        assert "IASNMP" in got
    top = sorted(want, key=lambda c: (-want[c], len(c), c))[:20]
    assert [want[c] for c in top] == pytest.approx(sorted(got.values(), reverse=True)[:20])
    assert all(got[c] <= want[c] + 1e-9 for c in got)
