import unicodedata

from pyspark.sql import functions as F

from paperflow.functions import claims, lexicon
from paperflow.operators import claims as columns
from paperflow.operators import style

SOURCE = {
    "title": "Hedges along cycle paths and fine dust",
    "abstract": "During 14 weeks we measured dust on 36 cycle paths in Ghent. Along paths behind a hedge of privet the filters held 31 percent less dust than filters along open paths.",
    "tldr": None, "venue": "Annals of Street Planting", "type": "article", "date": "2025-03-02",
}
OPENING, RESULT = "V Gentu změřili prach na 36 cyklostezkách.", "Za živým plotem ho zachytili o 31 procent méně."
EXAMPLE = f"{OPENING} {RESULT}"
FIRST = dict(id="a", text="Dust was measured on 36 cycle paths in Ghent", kind="setting", span=OPENING, verdict="supported", quote="we measured dust on 36 cycle paths in Ghent", field="abstract")
SECOND = dict(id="b", text="Filters behind a hedge held 31 percent less dust", kind="quantity", span=RESULT, verdict="supported", quote="the filters held 31 percent less dust", field="abstract")


ORDER = ("id", "text", "kind", "span", "verdict", "quote", "field")
FIELDS = "example string, claims array<" + columns.CLAIM + ">, model_verdict string, " + ", ".join(f"{c} string" for c in columns.SOURCE)


def reports(spark, *cases, illustration=False):
    """The report of each (example, claims, model's verdict, source)."""
    rows = [(n, example, None if listed is None else [tuple(c.get(k) for k in ORDER) for c in listed], verdict, *[source.get(c) for c in columns.SOURCE]) for n, (example, listed, verdict, source) in enumerate(cases)]
    out = columns.adjudicated(spark.createDataFrame(rows, "n int, " + FIELDS), F.lit(illustration)).orderBy("n")
    return [r.report for r in out.collect()]


def case(first=None, second=None, example=EXAMPLE, verdict="supported"):
    return example, [FIRST | (first or {}), SECOND | (second or {})], verdict, SOURCE


def codes(report):
    return {f.code for f in report.failures}


def test_supported(spark):
    (r,) = reports(spark, case())
    assert r.verdict == "supported" and r.failures == [] and r.coverage > 0.9


def test_one_rule_each(spark):
    changes = [
        ({"quote": "we measured dust on 36 cycle paths in Bruges"}, "V4_FABRICATED_QUOTE"), ({"verdict": "unsupported"}, "V2_UNSUPPORTED_CLAIM"), ({"quote": None}, "V3_QUOTE_TOO_WEAK"), ({"quote": "the paths"}, "V3_QUOTE_TOO_WEAK"),
        ({"span": "něco jiného"}, "V5_SPAN_NOT_IN_EXAMPLE"), ({"text": "Bakers knead dough"}, "V7_QUOTE_IRRELEVANT"), ({"text": "36 cycle paths", "quote": "Annals of Street Planting article", "field": "venue"}, "V7_MAGNITUDE_UNSUPPORTED"),
        ({"text": "Planting in a street", "kind": "mechanism", "quote": "Annals of Street Planting article", "field": "venue"}, "V8_VENUE_CANNOT_SUPPORT_MECHANISM"),
    ]
    for (_, code), r in zip(changes, reports(spark, *[case(c) for c, _ in changes]), strict=True):
        assert code in codes(r), code


def test_whole_example(spark):
    number, narrow, veto, nothing, many = reports(spark, case(example=EXAMPLE + " Zaplatili 640 korun."), case({"span": EXAMPLE[:12]}, {"span": EXAMPLE[:12]}), case(verdict="unsupported"), (None, None, None, {}), (EXAMPLE, [FIRST] * 13, "supported", SOURCE))
    assert "V9_UNACCOUNTED_NUMBER" in codes(number) and "V6_COVERAGE_TOO_LOW" in codes(narrow) and codes(veto) == {"MODEL_VETO"} and "EXAMPLE_TOO_ELABORATE" in codes(many)
    assert nothing.verdict == "unsupported" and nothing.coverage == 0.0
    assert "V6_COVERAGE_TOO_LOW" not in codes(reports(spark, case({"span": EXAMPLE[:12]}, {"span": EXAMPLE[:12]}), illustration=True)[0])
    # quotes as they were typed, and letters that are written apart
    odd = case({"quote": "We  measured\u00a0dust on 36 cycle paths in Ghent", "span": unicodedata.normalize("NFD", OPENING)})
    assert reports(spark, odd)[0].verdict == "supported"
    # several quotes that are beside the point, each of a kind that alone is let pass
    loose = [dict(FIRST, id=k, kind="finding", text="Bakers knead dough") for k in "xyz"]
    assert [f.claim for f in reports(spark, (EXAMPLE, loose, "supported", SOURCE))[0].failures if f.code == "V7_QUOTE_IRRELEVANT"] == ["x", "y", "z"]


def test_columns_of_numbers_and_stems(spark):
    one = lambda column, text="": spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first().o
    assert set(one(claims.numbers, "007, 4,10 and B2")) == {"7", "4.1"} and one(claims.numbers, None) == []
    assert one(claims.magnitudes, "61,4 % ze 7 kilogramů, 33 °C, pokoj 812") == ["61.4", "7", "33"]
    near = lambda v, *k: one(lambda _: claims.accounted(F.lit(v), F.array(*map(F.lit, k))))
    assert near("61", "61.4") and near("200", "199.2") and not near("700", "7")
    assert set(one(claims.stems, "The leaves were counted 18 times")) == {"leav", "coun", "18", "tim"}
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s])
    assert one(lambda t: claims.coverage(t, spans((1, 3), (0, 2))), "ab cd") == 0.5 and one(lambda t: claims.coverage(t, spans((0, 1))), "") == 0.0


def test_grades(spark):
    rows = [(n, example, [tuple(c.get(k) for k in ORDER) for c in listed], verdict, *[source.get(c) for c in columns.SOURCE], expected, flags, need) for n, ((example, listed, verdict, source), expected, flags, need) in enumerate([
        (case(second={"verdict": "unsupported"}), "unsupported", [RESULT], True), (case(), "unsupported", [], False), (case({"quote": "nobody ever said a word of this"}), "supported", [], False), (case({"verdict": "unsupported"}, {"verdict": "unsupported"}), "unsupported", ["zzz"], True),
    ])]
    df = columns.graded(columns.adjudicated(spark.createDataFrame(rows, "n int, " + FIELDS + ", expected string, must_flag array<string>, need_supported boolean")))
    assert [r.problems for r in df.orderBy("n").collect()] == [[], ["verdict"], ["verdict", "invented quote"], ["not flagged: zzz", "nothing supported"]]
    total = columns.summary(df.withColumn("actual", F.col("report.verdict"))).first()
    assert (total.passed, total.false_accepts, total.false_rejects, total.drift) == (2, 1, 1, 3)


def test_overstatements(spark):
    entries = [lexicon.Overstatement("a", ("průlom",), "warn"), lexicon.Overstatement("b", ("průlomov",), reject="bolest"), lexicon.Overstatement("c", ("amazing",), english=True)]
    rows = spark.createDataFrame([("Průlomový stroj (amazing).",), ("Průlomová bolest",), (None,)], "t string")
    found = {r.t: [tuple(f) for f in r.f] for r in rows.select("t", lexicon.overstatements(F.col("t"), entries).alias("f")).collect()}
    assert found == {"Průlomový stroj (amazing).": [("b", "hard", 0, 9)], "Průlomová bolest": [("a", "warn", 0, 9)], None: []}


def test_glosses(spark):
    glossary = lexicon.Glossary([lexicon.Term("k", original="cohort", forms=("kohort",)), lexicon.Term("p", forms=("placeb",))])
    texts = ["Kohorta jedla.", "Kohorta, tedy všichni narození jednoho roku, jedla.", "Kohorta (cohort), tedy všichni narození jednoho roku, jedla. Kohorta pila.", None, ""]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)] + [(9, 0, "Nic."), (9, 1, "Placebo."), (9, 2, "Placebo, tedy cukr bez účinné látky.")], "doc int, block int, text string")
    found = sorted(tuple(r) for r in style.gloss_findings(rows, glossary).collect())
    assert found == [(0, 0, "no_gloss:k", "hard", 0, 7), (1, 0, "no_english_original:k", "warn", 0, 7), (9, 1, "no_gloss:p", "hard", 0, 7)]
