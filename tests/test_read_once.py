"""A candidate's text is prepared once for all that reads it, and what is read is what each factor reads alone."""

import re

from pyspark.sql import functions as F

from paperflow.functions import scoring, text
from paperflow.functions.identity import squeeze
from paperflow.operators import selection
from paperflow.plans import digest
from paperflow.tables import let

CASES = [
    ("Sleep reduced pain: a new framework", "We prove  that heat-pumps\nreduced rents by 5 %. n = 120 patients. State-of-the-art results, LED TO floods", "older adults"),
    ("Notes", "linked", "to milk"), (None, None, None), ("", "", ""), ("MEN", "the last word is rent", "Sleep; we prove"), ("İstanbul homes", "ΣΟΦΟΣ 12 mice, x86 b2b internationalisation", None),
]


def test_read_is_what_each_factor_reads(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, title string, abstract string, tldr string")
    t, a, n = (F.col(c) for c in ("title", "abstract", "tldr"))
    rows = df.select("k", let(scoring.texts(t, a, n), scoring.read).alias("r"), scoring.explainability(t, a, n).alias("e"), scoring.everyday_relevance(t, a).alias("l"), scoring.sample_size(squeeze(F.coalesce(a, F.lit("")))).alias("n")).collect()
    for r in rows:
        assert (r.r.explain, r.r.everyday, r.r.n_cases) == (r.e, r.l, r.n), r.k
    assert "reduced (title)" in rows[0].r.explain.verbs and "led to" in rows[0].r.explain.verbs and "heat pump" in rows[0].r.everyday.terms
    assert rows[1].r.explain.verbs == [] and "we prove" in rows[4].r.explain.theory  # nothing goes from the abstract into the note


def test_scored_squeezes_an_abstract_once(spark):
    plan = digest.scored(spark, "/root/testdata/sf0.001").select("doc_id", "total")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(coalesce\((?:text|abstract)#", plan)) == 1


def test_open_and_sound_is_without_reason(spark):
    long = "word " * 90
    bodies = ["", "short", long, "{" + '"a" : [' + long, "an Inverted_Index " + long, "1, 2; 3 4 5] " * 40, "a 1 b 2 c 3 d 4 " * 30, "a 1 b 2 c d 4 " * 30]
    rows = [(title, b, note, kind, gone, age, seen) for b in bodies for title, note, kind, gone, age, seen in [
        ("T", None, "article", False, 1, None), ("Retracted: T", None, "article", False, 1, None), ("T", "note", " Letter", False, 1, None), ("T", "note", None, None, 7, None), ("T", None, "article", True, 1, None),
        ("Erratum", None, "article", False, 1, None), ("T", None, "article", False, 8, None), ("T", None, "article", False, None, None), ("T", None, "article", False, 1, "doi"), (None, None, "article", False, 1, "title"), (None, None, None, None, 1, None),
    ]]
    df = spark.createDataFrame(rows, "title string, abstract string, tldr string, kind string, retracted boolean, age int, seen string")
    fixed = {n: F.col(n) for n in ("title", "kind", "retracted", "age", "seen")}
    kept = selection.open_to(**fixed) & selection.sound_text(squeeze(F.coalesce("abstract", F.lit(""))), squeeze(F.coalesce("tldr", F.lit(""))))
    reason = selection.exclusion_reason(**fixed, abstract=F.col("abstract"), tldr=F.col("tldr"))
    assert df.where(kept.isNull() | (kept != reason.isNull())).count() == 0 and df.where(kept).count() > 5


def test_words_are_counted_only_beside_numbers(spark):
    cases = ["1 2 3 4 5 a b c d e", "1 2 3 4 5 a b c d e f", "1 2 3 4", "1, 2; 3] 4 5 6 7 8 9 10", "a" * 50, "indexLENGTH", "x { \"a\": [", ' {"a": [', "ſ ınverted index", "", "x1 2 3 4 5 6 7 8 9 0 1"]
    plain = F.col("t").rlike(r'(?s)^\s*\{.*"\s*:\s*\[') | F.col("t").rlike(r"(?i)inverted[_\s]?index|indexlength") | ((F.regexp_count("t", F.lit(r"\S+")) >= 10) & (F.regexp_count("t", F.lit(r"(?<!\S)[0-9]+[,;\]]?(?!\S)")) * 2 >= F.regexp_count("t", F.lit(r"\S+"))))
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert df.where(text.inverted_index_like(F.col("t")) != plain).count() == 0 and df.where(plain).count() >= 5
