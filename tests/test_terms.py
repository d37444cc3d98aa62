"""The inverted lexicon against its terms' patterns, one at a time."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from paperflow.functions import scoring, terms, wordlists

ALL = {"verbs": scoring.OUTCOME_VERBS, "nouns": scoring.SUBJECT_NOUNS, "theory": scoring.THEORETICAL_MARKERS, **wordlists.EVERYDAY_DOMAINS}


def by_patterns(lexicon, text):
    return [k for k, t in enumerate(lexicon.terms) if regex.search(scoring.term_pattern(t).replace("\\x{2010}", "‐").replace("\\x{2015}", "―").replace("\\x{2212}", "−"), text)]


def texts(lexicon, n=250, seed=1):
    rng = random.Random(seed)
    words = [w for t in lexicon.terms for w in regex.split("[ -]", t)]
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice([rng.choice(lexicon.terms), rng.choice(words), rng.choice(words) + rng.choice(["s", "es", "x", "é", "2"]), rng.choice(["8", "a", "of", "the"]) + rng.choice(words)]))
            out.append(rng.choice([" ", " ", "-", "–", "−", " - ", ", ", ".", "/", "'", "\n", "\xa0"]))
        yield "".join(out)


def test_lexicon_has_sixteen_domains():
    assert len(wordlists.EVERYDAY_DOMAINS) == 16 and sum(map(len, wordlists.EVERYDAY_DOMAINS.values())) == 269


def test_found_terms_are_those_of_the_patterns(spark):
    lexicon = terms.Lexicon(ALL)
    rows = [(k, t) for k, t in enumerate(texts(lexicon))] + [(900, None), (901, ""), (902, "state - of–the−art results; heat pumpes, bus buses busses analysis")]
    got = {r.k: r.found for r in spark.createDataFrame(rows, "k int, t string").select("k", lexicon.found(F.col("t")).alias("found")).collect()}
    for k, t in rows:
        assert got[k] == by_patterns(lexicon, t or ""), t


def test_hits_keep_the_order_of_a_list_and_know_titles(spark):
    lexicon = terms.Lexicon({"a": ["rent", "heat pump", "milk"], "b": ["buses", "rent"]})
    df = spark.createDataFrame([("milk and rents", "a heat-pump for rent")], "t string, b string").select(lexicon.found(F.col("t")).alias("t"), lexicon.found(F.col("b")).alias("b"))
    row = df.select(lexicon.hits("a", F.col("t"), F.col("b")).alias("a"), lexicon.hits("b", F.col("t"), F.col("b")).alias("b")).first()
    assert [tuple(x) for x in row.a] == [("rent", True), ("heat pump", False), ("milk", True)] and [tuple(x) for x in row.b] == [("rent", True)]


def test_number_of_terms_does_not_grow_the_plan(spark):
    def size(n):
        words = ["".join(chr(97 + (k // 26**p) % 26) for p in range(4)) + "q" for k in range(n)]
        return len(str(spark.range(1).select(terms.Lexicon({"x": words}).found(F.lit("aaaaq")).alias("f"))._jdf.queryExecution().analyzed().treeString()).split("lambda"))

    assert size(20) == size(2000)


def test_terms_need_letters():
    for bad in ("", "covid-19", "a's"):
        with pytest.raises(ValueError):
            terms.forms(bad)
