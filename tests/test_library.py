import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperflow.functions import identity, scoring, text
from paperflow.operators import ledger, merge, pages, selection, similarity
from paperflow.sources import feeds, sinks
from paperflow.streaming import dedup


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw", ["10.1038/s41586-026-01234-5", "https://doi.org/10.1038/S41586-026-01234-5", "http://dx.doi.org/10.1038/s41586-026-01234-5", "doi:10.1038/s41586-026-01234-5", "  10.1038/s41586-026-01234-5.  ", "10.1038/s41586-026-01234-5),"])
def test_doi(spark, raw):
    assert one(spark, identity.normalise_doi, raw) == "10.1038/s41586-026-01234-5"


def test_ids_and_keys(spark):
    assert one(spark, identity.normalise_doi, " ") is None
    assert one(spark, identity.normalise_work_id, "https://openalex.org/w4401234567") == "W4401234567"
    assert one(spark, identity.normalise_preprint_id, "arxiv:2608.01234v3") == "2608.01234"
    assert one(spark, identity.preprint_id_from_url, "http://arxiv.org/abs/2608.01234v1") == "2608.01234"
    assert one(spark, identity.title_key, "Delaying School Start Times: A Two-Year Study") == "delayingschoolstarttimesatwoyearstudy"
    assert one(spark, identity.merge_key, "Éléments — a survey") == "elementsasurvey"
    assert one(spark, identity.trigrams, "abcd") == ["abc", "bcd"]
    assert one(spark, identity.trigrams, "ab") == []
    pair = spark.createDataFrame([("", ""), ("ab", "ab"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in pair.select(identity.trigram_jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


@pytest.mark.parametrize(
    ("index", "want"),
    [({"we": [0], "tested": [1], "it": [2]}, "we tested it"), ({"a": [0], "b": [1], "d": [3]}, "a b d"), ({"the": [0, 2], "cat": [1], "hat": [3], "top": [3]}, "the cat the hat"), ({"x": [-1], "z": [0]}, "z"), ({"b": [0], "7": [0]}, "7"), ({}, None), (None, None)],
)
def test_reconstruct(spark, index, want):
    assert one(spark, identity.reconstruct, index, "map<string,array<int>>") == want


def test_scoring(spark):
    day = spark.createDataFrame([(dt.date(2026, 8, 19),), (dt.date(2026, 8, 12),), (dt.date(2026, 8, 22),), (None,)], "d date")
    age = scoring.age_in_days(F.col("d"), F.lit(None).cast("date"), F.lit("2026-08-19").cast("date"))
    assert [tuple(r) for r in day.select(age, scoring.freshness(age, 7)).collect()] == [(0, 1.0), (7, 0.0), (0, 1.0), (None, 0.0)]
    assert scoring.weights_version([0.4, 0.28, 0.18, 0.14], 7) == "3be8ddaeeb8c"
    paper = spark.createDataFrame([("A framework: a new method", "We prove a theorem. We derive a lemma.")], "t string, a string")
    got = paper.select(scoring.explainability(F.col("t"), F.col("a"), F.lit("")).alias("e")).first()["e"]
    assert got["value"] == 0 and got["t"] == 1 and abs(got["c"] - 0.3) < 1e-9
    assert [one(spark, lambda v, p=p: v.rlike(p), t) for t, p in (("our towns here", scoring.term_pattern("town")), ("townships", scoring.term_pattern("towns")), ("led–to", scoring.term_pattern("led to")))] == [True, False, True]
    life = one(spark, lambda v: scoring.everyday_relevance(v, v, {"home": ["rent"], "food": ["bread", "apples"]}), "Rents and an apple")
    assert life["domains"] == ["home", "food"] and abs(life["value"] - (0.8 * 2 / 3 + 0.2 * 2 / 6)) < 1e-9


def test_exclusion_order_and_deferral(spark):
    base = {"title": "A title", "abstract": "short", "tldr": None, "kind": "article", "retracted": None, "age": 1, "seen": None}
    cases = [({"title": "RETRACTED: x"}, "EXCL_RETRACTED"), ({"abstract": " "}, "EXCL_NO_ABSTRACT"), ({}, "EXCL_ABSTRACT_TOO_THIN"), ({"tldr": "t"}, None), ({"tldr": "t", "age": 8}, "EXCL_STALE"), ({"tldr": "t", "age": 7}, None), ({"tldr": "t", "seen": "title"}, "EXCL_SEEN_TITLE"), ({"tldr": "t", "seen": "doi", "kind": "letter"}, "EXCL_SEEN"), ({"tldr": "t", "title": "Reply to X"}, "EXCL_TYPE"), ({"tldr": "t", "abstract": '{"a": [1]}'}, "EXCL_NO_ABSTRACT")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], "title string, abstract string, tldr string, kind string, retracted boolean, age int, seen string")
    columns = {n: F.col(n) for n in base}
    assert [r[0] for r in df.select(selection.exclusion_reason(**columns)).collect()] == [w for _, w in cases]
    assert df.limit(3).select(selection.exclusion_reason(**columns, defer_abstract=True)).collect()[2][0] is None


def test_choice_does_not_depend_on_row_order(spark):
    rows = [(k, f"g{k % 3}", (k * 37) % 50) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, s int")
    order = [F.col("s").desc(), F.col("id").asc()]
    want, used, out = sorted(rows, key=lambda r: (-r[2], r[0])), {}, []
    for r in want:
        if used.get(r[1], 0) < 2 and len(out) < 5:
            used[r[1]] = used.get(r[1], 0) + 1
            out.append(r[0])
    for shuffled in (df, df.repartition(5), df.orderBy(F.rand(1))):
        assert {r["id"] for r in selection.capped(shuffled, "g", order, 2, 5).collect()} == set(out)
    assert [r["rank"] for r in selection.top(df, order, 3).collect()] == [1, 2, 3]


def test_ledger(spark):
    today = dt.date(2026, 8, 19)
    entries = [(f"W{a}", None, None, None, today - dt.timedelta(days=a), "c", k) for k, a in enumerate([0, 179, 180, 181, 400])] + [("W999", "d1", None, None, None, "c", 9), (None, "d2", None, None, today, "c", 10), ("W5", "d2", None, None, today, "c", 11)]
    led = spark.createDataFrame(entries, feeds.LEDGER)
    rows = spark.createDataFrame([(str(a), f"W{a}", None, None) for a in (0, 179, 180, 181, 400, 999)] + [("both", "W5", "d2", None)], "id string, work_id string, doi string, preprint_id string")
    got = {r["id"]: r["seen_kind"] for r in ledger.seen(rows, led, F.lit(today)).collect()}
    assert got == {"0": "work_id", "179": "work_id", "180": "work_id", "181": None, "400": None, "999": "work_id", "both": "doi"}


def test_merge_and_similarity(spark):
    df = spark.createDataFrame([("k", 0, "W1", None, False), ("k", 1, "a1", "text", True), ("z", 2, "W2", " ", None)], "key string, pos int, id string, abstract string, retracted boolean")
    got = {r["key"]: r for r in merge.merge_by(df, "key", "pos", lead=["id"], fill=["abstract"], any_true=["retracted"], rich=merge.richness(["abstract"])).collect()}
    assert (got["k"]["id"], got["k"]["abstract"], got["k"]["retracted"], got["z"]["abstract"]) == ("a1", "text", True, None)
    keys = ["delayingschoolstarttimesatwoyearstudyofsleep", "delayingschoolstarttimesatwoyearstudyofsleeps", "somethingelsealtogether", "ab"]
    assert [tuple(r) for r in similarity.similar_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()] == [(keys[0], keys[1])]


@pytest.mark.parametrize(("html", "want"), [("<p>see https://x.y</p>", []), ('<a href="https://x.y">t</a>', []), ("<link rel=x>", ["link"]), ('<style>a{background:url("https://x")}</style>', ["css url"]), ("<style>a{background:url(data:x)}</style>", []), ('<p data="https://x">', ["remote url"]), ("<img src=a>", ["remote element"]), ('<p onclick="x">', ["inline handler"])])
def test_pages(spark, html, want):
    assert one(spark, pages.violations, html) == want


def test_text(spark):
    assert one(spark, text.author_line, ["a", "b", "c", "d", "e", "f", "g"], "array<string>") == "a, b, c, d, e, f and others"
    assert one(spark, text.paragraphs, "a <b>\n\n c  d ") == "<p>a &lt;b&gt;</p>\n<p>c d</p>"
    assert one(spark, text.redact, "http://h/?api_key=s3&x=1") == "http://h/?api_key=***&x=1"
    assert one(spark, text.quote_form, "“A”  – b…") == '"a" - b...'


def test_sources_and_sinks(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "title": " A  title ", "publication_date": "2026-08-18", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": " N "}}, {"author": {"display_name": " "}}]}
    (tmp_path / "w.json").write_text(json.dumps({"results": [work, {"id": None, "title": "x", "publication_date": "2026-08-18"}, work | {"publication_date": "2027-01-01"}]}))
    got = feeds.works(spark, str(tmp_path / "w.json"), "2026-08-12", "2026-08-19").collect()
    assert [(r["id"], r["doi"], r["title"], r["abstract"], r["authors"]) for r in got] == [("W1", "10.1/x", "A title", "a b", ["N"])]
    entry = '<entry><id>http://arxiv.org/abs/2608.1v2</id><title>T\n x</title><summary>s</summary><published>2026-08-18T00:00:00Z</published><link href="http://l" rel="alternate"/><author><name>Q</name></author></entry>'
    (tmp_path / "f.xml").write_text(f"<feed>{entry}<entry><title>none</title></entry></feed>")
    got = feeds.atom(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["id"], r["title"], r["url"], r["authors"], r["date"]) for r in got] == [("arxiv:2608.1", "T x", "http://l", ["Q"], dt.date(2026, 8, 18))]
    (tmp_path / "days").mkdir()
    (tmp_path / "days/2026-08-19.json").write_text('{"date": "1999-01-01", "categoryLabel": "c", "entries": [{"title": "t"}]}')
    (tmp_path / "days/2026-08-18.json").write_text("broken")
    assert [tuple(r) for r in feeds.archived_days(spark, str(tmp_path / "days")).collect()] == [("2026-08-19", "c", ["t"])]
    assert feeds.ledger(spark, str(tmp_path / "none")).count() == 0
    days, new = spark.createDataFrame([("2026-08-19", "x")], "date string, body string"), spark.createDataFrame([("W1", None, None, "t", dt.date(2026, 8, 19), "c", 1)], feeds.LEDGER)
    line = spark.createDataFrame([("published",)], "outcome string")
    at = {n: str(tmp_path / n) for n in ("archive", "ledger", "runs")}
    assert not sinks.publish(days, new, line, **at, least=2)
    assert feeds.ledger(spark, at["ledger"]).count() == 0
    assert sinks.publish(days, new, line, **at, least=1) and sinks.publish(days, new, line, **at, least=1)
    assert spark.read.parquet(at["archive"]).count() == 1 and feeds.ledger(spark, at["ledger"]).count() == 2 and spark.read.json(at["runs"]).count() == 3
    sources = [feeds.Source("a", lambda c: True, lambda s, c: days), feeds.Source("b", lambda c: c == "x", lambda s, c: new)]
    assert feeds.scan_all(spark, "y", sources).columns == ["date", "body", "source_rank"] and feeds.scan_all(spark, "x", sources).count() == 2


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0)), (1, dt.datetime(2024, 1, 1, 0, 5)), (2, dt.datetime(2024, 1, 1, 0, 1))], "k int, ts timestamp").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "s"))
    q = dedup.first_within(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == [1, 2]
