"""A whole day from files to the ledger, and the command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperflow import __main__ as cli
from paperflow.config import Config, ConfigError, resolved, secrets
from paperflow.operators import day, gram_index, ledger, merge
from paperflow.sources import feeds

TODAY = dt.date(2026, 3, 4)
SETTINGS = {"categories": [{"key": f"k{n}", "weekday": n, "label": f"Label {n}"} for n in range(1, 8)], "language": "en", "least_papers": 2, "papers_per_day": 3, "cap": 1, "relaxed_cap": 1}
FILLER = " ".join(f"fillerword{n}" for n in range(60))


def work(n, title, area, **more):
    words = f"We found that bread reduced hunger in children by 30 % over {n} weeks. {FILLER}".split()
    index = {}
    for at, w in enumerate(words):
        index.setdefault(w, []).append(at)
    return {"id": f"https://openalex.org/W{n}", "doi": f"https://doi.org/10.5/{n}", "title": title, "publication_date": "2026-03-02", "type": "article", "language": "en", "abstract_inverted_index": index, "primary_topic": {"subfield": {"id": area}, "field": {"id": "f"}}, "open_access": {"is_oa": True}, "primary_location": {"source": {"display_name": "Journal"}}} | more


def files(folder):
    rows = [
        work(1, "Bread reduced hunger in children", "s1"), work(2, "Milk improved sleep of students", "s1"), work(3, "Trees lowered heat in cities", "s2"), work(4, "A retraction", "s3", type="retraction"), work(5, "Bicycles prevented injuries among workers", "s4"),
        work(6, "Old news on buses", "s5", publication_date="2026-01-01"), {"id": None, "title": "none", "publication_date": "2026-03-02"},
    ]
    (folder / "works.json").write_text(json.dumps({"results": rows}))
    entry = "<entry><id>http://arxiv.org/abs/2603.{0}v1</id><title>{1}</title><summary>Heating reduced costs of households by 12 %. {2}</summary><published>2026-03-03T00:00:00Z</published><author><name>A B</name></author><arxiv:primary_category term='cs.X'/><arxiv:doi>10.5/{0}</arxiv:doi></entry>"
    (folder / "feed.xml").write_text("<feed xmlns:arxiv='http://arxiv.org/schemas/atom'>" + entry.format(3, "Trees lowered heat in cities", FILLER) + entry.format(9, "Heating reduced costs of households", FILLER) + "</feed>")
    (folder / "config.json").write_text(json.dumps(SETTINGS))


class Writer:
    def __init__(self):
        self.n = 0

    def complete(self, row, corrections):
        self.n += 1
        return {"text": f"About {row['title']}"}

    def calls(self):
        return self.n


def writer():
    return Writer()


def sources(folder):
    return [feeds.Source("works", lambda _: True, lambda s, _: feeds.works(s, f"{folder}/works.json")), feeds.Source("arxiv", lambda _: True, lambda s, _: feeds.atom(s, f"{folder}/feed.xml"))]


def test_run_publishes_once(spark, tmp_path):
    files(tmp_path)
    config, root = Config.read(json.dumps(SETTINGS)), tmp_path / "site"
    options = {"today": TODAY, "domains": {"food": ["bread", "milk"], "home": ["heating"]}}
    first = day.run_day(spark, config, str(root), sources(tmp_path), Writer(), **options)
    assert first.exit_code == 0 and first.outcome == "published"
    # the preprint of W3 merged with it by its DOI; one a subfield
    assert first.line["fetched"] == {"works": 6, "arxiv": 2} and len(first.line["selected"]) == 3
    assert first.line["reasons"] == {"EXCL_RETRACTED": 1, "EXCL_STALE": 1}
    twin = json.loads((root / "archive/2026-03-04.json").read_text())
    page = (root / "archive/2026-03-04.html").read_text()
    assert [e["id"] for e in twin["entries"]] == first.line["selected"] and page.count("<article>") == 3 and "About " in page
    assert "2026-03-04.html" in (root / "index.html").read_text()
    history = feeds.ledger(spark, str(root / "ledger")).collect()
    assert len(history) == 3 and {r.published_on for r in history} == {TODAY}
    with pytest.raises(FileExistsError):
        day.run_day(spark, config, str(root), sources(tmp_path), Writer(), **options)
    assert day.run_day(spark, config, str(root), sources(tmp_path), Writer(), skip_if_published=True, **options).outcome == "skipped"
    # what the ledger has is left out the next day
    later = day.run_day(spark, config, str(root), sources(tmp_path), None, **(options | {"today": TODAY + dt.timedelta(days=1)}))
    assert later.outcome == "discovered" and not set(later.line["selected"]) & set(first.line["selected"]) and later.line["reasons"]["EXCL_SEEN"] == 3
    before = page, (root / "index.html").read_text()
    assert day.rerender(spark, config, str(root)) == 1
    assert before == ((root / "archive/2026-03-04.html").read_text(), (root / "index.html").read_text())
    assert spark.read.json(str(root / "runs")).count() == 1


def test_days_with_an_index_of_titles(spark, tmp_path):
    files(tmp_path)
    config, root, index = Config.read(json.dumps(SETTINGS)), tmp_path / "site", str(tmp_path / "titles")
    gram_index.create(spark, index, spark.createDataFrame([], "key string"))
    options = {"domains": {"food": ["bread", "milk"]}, "index": index}
    first = day.run_day(spark, config, str(root), sources(tmp_path), Writer(), today=TODAY, **options)
    history = feeds.ledger(spark, str(root / "ledger"))
    assert first.outcome == "published" and {r.key for r in gram_index._stored(spark, index, "keys").collect()} == {r.title_key for r in history.collect()} - {"", None}
    later = day.run_day(spark, config, str(root), sources(tmp_path), None, today=TODAY + dt.timedelta(days=1), **options)
    assert later.line["reasons"]["EXCL_SEEN"] == 3


def test_lookup_fills_and_too_few_abort(spark, tmp_path):
    files(tmp_path)
    config = Config.read(json.dumps(SETTINGS | {"least_papers": 3, "cap": 1}))
    bare = [feeds.Source("works", lambda _: True, lambda s, _: feeds.works(s, f"{tmp_path}/works.json").where("id = 'W1'").withColumn("abstract", F.lit(None).cast("string")))]
    lookup = spark.createDataFrame([("DOI:10.5/1", None, "Bread helps children.")], "key string, abstract string, tldr string")
    options = {"today": TODAY, "domains": {}}
    assert day.run_day(spark, config, str(tmp_path / "a"), bare, None, **options).line["selected"] == []
    assert day.run_day(spark, config, str(tmp_path / "a"), bare, None, lookup=lookup, **options).line["selected"] == ["W1"]
    few = day.run_day(spark, config, str(tmp_path / "b"), bare, Writer(), lookup=lookup, **options)
    assert (few.outcome, few.exit_code) == ("aborted", 1) and not (tmp_path / "b/archive").exists() and spark.read.json(str(tmp_path / "b/runs")).count() == 1


def test_command_line(spark, tmp_path, capsys):
    files(tmp_path)
    base = ["--root", str(tmp_path / "site"), "--config", str(tmp_path / "config.json"), "--works", str(tmp_path / "works.json"), "--feed", str(tmp_path / "feed.xml"), "--date", "2026-03-04"]
    assert cli.main(["run", *base, "--discover-only"], spark) == 0
    assert "2026-03-04 k3: discovered; fetched arxiv 2, works 5; left out EXCL_RETRACTED 1; selected 3" in capsys.readouterr().out
    assert cli.main(["run", *base, "--client", "test_day:writer"], spark) == 0
    assert cli.main(["reindex", *base], spark) == cli.main(["rerender", *base], spark) == 0
    assert cli.main(["nothing"], spark) == 2 and cli.main(["--help"], spark) == 0


def test_truncated_feed_is_an_error(spark, tmp_path):
    files(tmp_path)
    whole = (tmp_path / "feed.xml").read_text()
    (tmp_path / "cut.xml").write_text(whole[: whole.index("</entry>") + 8])
    with pytest.raises(ValueError, match="not well formed"):
        feeds.atom(spark, str(tmp_path / "cut.xml"))


def test_asked_for_works(spark, tmp_path):
    files(tmp_path)
    path = str(tmp_path / "works.json")
    assert [r.id for r in feeds.works(spark, path, fields=["f"], kinds=["article"], languages=["en"], with_abstract=True, retracted=False, most=2, until="2026-03-04").collect()] == ["W1", "W2"]
    records = spark.read.schema(feeds.WORKS).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    assert tuple(feeds.left_out(records).first()) == (7, 1)
    valid, seen = feeds.counted(feeds.work_candidates(records))
    assert str(valid._jdf.queryExecution().optimizedPlan()).count("Relation [") == 1
    assert valid.count() == 6 and seen.get == {"read": 7, "left_out": 1}


def test_settings(tmp_path):
    for broken in ({"nonsense": 1}, {"categories": []}, {"cap": 5, "relaxed_cap": 1}):
        with pytest.raises(ConfigError):
            Config.read(json.dumps(SETTINGS | broken))
    assert resolved(["Computer  science"], {"computer Science": "17"}) == ["17"]
    with pytest.raises(ConfigError):
        resolved(["a", "b"], {"a": "1"})
    lines = "# x\nexport A='1 2'\nB = two # note\nC=\n"
    assert secrets(["A", "B", "C", "D"], lines, {"B": "env", "D": ""}) == {"A": "1 2", "B": "env"}


def plain_fold(rows):
    slots = []
    for place, doi, title, note, flag in rows:
        at = next((s for s in slots if doi and s["doi"] == doi), None) or next((s for s in slots if title and title in s["titles"] and s is next(x for x in slots if title in x["titles"])), None)
        if at is not None and not (doi and at["doi"] and at["doi"] != doi):
            rich = (at["note"] is not None) + (at["doi"] is not None) >= (note is not None) + (doi is not None)
            at["lead"] = at["lead"] if rich else place
            at["note"] = (at["note"] or note) if rich else (note or at["note"])
            at["doi"], at["flag"] = at["doi"] or doi, at["flag"] or flag
            if title and not any(title in s["titles"] for s in slots):
                at["titles"].append(title)
        else:
            fresh = [title] if title and not any(title in s["titles"] for s in slots) else []
            slots.append({"place": place, "lead": place, "doi": doi, "titles": fresh, "note": note, "flag": flag})
    return sorted((s["place"], s["lead"], s["doi"], s["note"], s["flag"]) for s in slots)


def test_merge_fold(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        rows = [(n, rng.choice([None, None, *(f"d{k}" for k in range(12))]), rng.choice([None, *(f"t{k}" for k in range(14))]), rng.choice([None, f"note{n}"]), rng.random() < 0.1) for n in range(60)]
        df = spark.createDataFrame(rows, "place int, doi string, title string, note string, flag boolean").withColumn("lead", F.col("place"))
        out = merge.merge_fold(df, place="place", doi="doi", title="title", lead=["lead"], fill=["note"], any_true=["flag"])
        assert sorted((r.place, r.lead, r.doi, r.note, r.flag) for r in out.collect()) == plain_fold(rows)


def test_ledger_upsert(spark):
    kinds = "work_id string, doi string, preprint_id string, title_key string, category string"
    old = spark.createDataFrame([("W1", None, None, "", "a", dt.date(2026, 1, 1), 0), (None, "d2", None, "hedgesalongcyclepathsandfinedust", None, dt.date(2026, 5, 1), 1), ("W3", "d2", None, "x", "c", dt.date(2026, 1, 1), 2)], kinds + ", published_on date, entry_idx long")
    new = spark.createDataFrame([(0, "W1", "d1", None, "t1", "z"), (1, None, "d2", "p2", "", "z"), (2, None, None, None, "hedgesalongcyclepathsandfinedusts", "z"), (3, "W9", None, None, "fresh", "z"), (4, None, "d9", None, "fresh", "z"), (5, "W9", None, "p9", "other", "z"), (6, None, None, None, "", "z")], "id int, " + kinds)
    out = {r.entry_idx: (r.published_on.isoformat(), r.work_id, r.doi, r.preprint_id, r.title_key, r.category) for r in ledger.record_published(old, new, F.lit("2026-03-04").cast("date")).collect()}
    assert out == {
        0: ("2026-03-04", "W1", "d1", None, "t1", "a"), 1: ("2026-05-01", None, "d2", "p2", "hedgesalongcyclepathsandfinedust", "z"), 2: ("2026-01-01", "W3", "d2", None, "x", "c"), 3: ("2026-03-04", "W9", "d9", "p9", "fresh", "z"), 4: ("2026-03-04", None, None, None, None, "z"),
    }


def test_merge_fold_with_more_fields(spark):
    import random

    def fold(rows):
        """The merge in the order of places, record by record."""
        out, by_doi, by_title = [], {}, {}
        fields = ("doi", "a", "b", "c")
        have = lambda v: v is not None and v != [] and (not isinstance(v, str) or v.strip() != "")
        for row in rows:
            at = by_doi.get(row["doi"]) if row["doi"] else None
            if at is None and row["title"] in by_title and not (row["doi"] and out[by_title[row["title"]]]["doi"] not in (None, "", row["doi"])):
                at = by_title[row["title"]]
            if at is None:
                at = len(out)
                out.append(dict(row))
            else:
                old = out[at]
                one, other = (old, row) if sum(have(old[c]) for c in fields) >= sum(have(row[c]) for c in fields) else (row, old)
                out[at] = one | {c: one[c] if have(one[c]) else other[c] for c in fields} | {"flag": bool(old["flag"]) or bool(row["flag"]), "place": old["place"]}
            if out[at]["doi"]:
                by_doi.setdefault(out[at]["doi"], at)
            if row["title"]:
                by_title.setdefault(row["title"], at)
        return out

    rng = random.Random(9)
    for n in range(4):
        rows = [{"place": k, "doi": rng.choice([None, None, "", *(f"d{j}" for j in range(25))]), "title": rng.choice([None, "", *(f"t{j}" for j in range(20))]), "lead": f"l{k}", "a": rng.choice([None, " ", f"a{k}"]), "b": rng.choice([None, k]), "c": rng.choice([None, [], [k]]), "flag": rng.choice([None, True, False])} for k in range(150 if n else 1)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "place int, doi string, title string, lead string, a string, b int, c array<int>, flag boolean").repartition(3)
        got = merge.merge_fold(df, place="place", doi="doi", title="title", lead=["lead"], fill=["a", "b", "c"], any_true=["flag"]).collect()
        clean = lambda v: None if v in ("", " ", []) else v
        key = lambda r: (r["place"], r["lead"], clean(r["doi"]), clean(r["a"]), r["b"], clean(r["c"]), bool(r["flag"]))
        assert sorted(map(key, got), key=str) == sorted(map(key, fold(rows)), key=str)
    assert merge.merge_fold(df.limit(0), place="place", doi="doi", title="title", lead=["lead"], fill=["a"]).collect() == []


def test_merge_fold_of_one_title_on_very_many_records(spark):
    """No task but the last sees more rows than sets of fields: what is grouped has combined before it is shuffled."""
    rows = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 7, F.concat(F.lit("d"), F.col("id").cast("string"))).alias("doi"), F.lit("one title").alias("title"), F.when(F.col("id") == 5000, F.lit("a")).alias("a"), F.lit(None).cast("string").alias("b")).repartition(8)
    got = {r.id: (r.doi, r.a) for r in merge.merge_fold(rows, place="id", doi="doi", title="title", lead=[], fill=["a", "b"]).collect()}
    assert len(got) == 100 and got[0] == ("d7", "a") and all(got[k] == (f"d{k}", None) for k in range(1007, 100_000, 1000))
