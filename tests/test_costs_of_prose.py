"""Whole texts in few passes: syllables, running sums, long runs of numbers, endings, and places of stems."""

import random
import unicodedata

from pyspark.sql import functions as F

from paperflow.functions import lexicon, prose, text
from paperflow.functions.stems import Stems, form
from paperflow.tables import match_spans, running


def test_syllables_of_whole_texts_are_those_of_the_words(spark):
    rng = random.Random(3)
    parts = [*"aáeoumrlkzpsťňß'’-19 .,;\n", "ou", "au", "eu", "na", "přes", "pod", "do", " ", " ", "İ", "Σ", "Ⅷ", "x2", "\u00a0", "|", "#", "$1"]
    texts = [None, "", "   ", "12 345", "naučit přeorat vlk osm doučit krk 'it’s' a-b rytmus", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    each = F.transform(F.filter(prose.words(F.col("t"), prose.COUNTABLE), lambda w: w.rlike(r"\p{L}")), prose.syllables)
    for r in rows.select("t", each.alias("each"), prose.spoken(F.col("t")).alias("s")).collect():
        want = (len(r.each), sum(r.each), sum(k >= 4 for k in r.each), sum(k >= 5 for k in r.each))
        assert tuple(r.s) == want, r.t


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 2, 3, 10, 99, 1000)] + [(None,)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", running(F.col("a")).alias("r")).collect():
        assert r.r == [sum(r.a[:k]) for k in range(len(r.a))] if r.a is not None else not r.r


def test_a_long_run_of_numbers_is_masked(spark):
    long = "7, " * 40_000 + "konec"
    row = spark.createDataFrame([(long,)], "t string").repartition(1).select(prose.masked(F.col("t"), prose.MASKS).alias("m")).first()
    assert len(row.m) == len(long) and row.m.startswith(prose.MASK * 1000) and row.m.endswith("konec")


def test_findings_hold_the_limits_against_the_evidence(spark):
    """Limits at which one word more or less decides."""
    rng = random.Random(5)
    words = "the of running station quickly dům ale nebo jeho malých psaní kost house xyz dog že ready nation během".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) + "." for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    lim, kinds = prose.ENGLISH_LIMITS, set()
    for r in rows.select("t", prose.evidence(F.col("t")).alias("e"), prose.english_findings(F.col("t")).alias("f")).collect():
        e = r.e
        foreign = e.tokens >= lim["min_tokens"] and e.english >= lim["english_hard"] and e.czech <= lim["czech_hard"] and e.marked == 0 and e.czech_words <= lim["max_czech_words"]
        mixed = e.tokens >= lim["mixed_min_tokens"] and e.english >= lim["mixed_warn"] and e.marked > 0
        want = [("untranslated", "hard")] if foreign else [("mixed", "warn")] if mixed else []
        assert [(f.rule, f.severity) for f in r.f if f.rule != "run"] == want, r.t
        kinds.update(want)
    assert len(kinds) == 2


def test_places_of_stems_far_apart(spark):
    found = Stems([form(0, "alpha beta+"), form(1, "gam"), form(2, "alpha")])
    t = "(gamma) " + "x, y " * 700 + "alpha – betas gam\u00a0alpha beta " + "z" * 50 + " gam"
    r = spark.createDataFrame([(t,)], "t string").select(found.found(F.col("t")).alias("s"), match_spans(F.col("t"), r"gam(?:ma)?|alpha").alias("m")).first()
    assert sorted({s.start for s in r.s}) == sorted(m.start for m in r.m)
    assert [t[s.start : s.end] for s in r.s if s.owner == 0] == ["alpha – betas"] and {t[s.start : s.end] for s in r.s if s.owner == 1} == {"gamma", "gam"}


def test_patterns_ask_for_their_first_letters():
    assert lexicon.begun(r"(?<!\p{L})OR\s*=") == r"(?=OR)(?<!\p{L})OR\s*=" and lexicon.begun(r"x(?<!y)") == r"x(?<!y)"


def test_one_spelling_with_and_without_signs(spark):
    texts = ["plain Text", "a`b", "“x” – y…", "´", "«q»", "−1", "e\u0301", "\u212b", "한", "ﬀ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.quote_form(F.col("t")).alias("q"), text.composed(F.col("t")).alias("c")).collect()
    swap = str.maketrans(text.TYPED, text.PLAIN)
    assert all(r.q == r.t.translate(swap).replace("…", "...").lower() and r.c == unicodedata.normalize("NFC", r.t) for r in rows)
