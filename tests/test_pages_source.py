"""Works pages as a data source: the same candidates as by the JSON scan, filters in the plan, pages left out."""

import datetime as dt
import json
import random
import re

import pytest

from paperflow.sources import feeds, pages


def record(k, rng):
    day = dt.date(2026, 1, 1) + dt.timedelta(days=k // 10)
    return {
        "id": rng.choice([f"https://openalex.org/W{k}", f"W{k}", None if k % 17 == 0 else f"w{k}"]), "title": f"Title {k}", "publication_date": "no date" if k % 23 == 0 and k > 100 else day.isoformat(), "type": rng.choice(["article", "preprint", "review"]),
        "language": rng.choice(["en", "cs", None]), "primary_topic": {"field": {"id": f"f{k % 3}"}} if k % 5 else None, "is_retracted": k % 7 == 0, "abstract_inverted_index": {"word": [0], "two": [1]} if k % 2 else None,
    }


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    for page in range(12):
        (tmp_path / f"p{page:02}.json").write_text(json.dumps({"meta": {"page": page}, "results": [record(page * 20 + k, rng) for k in range(20)]}))
    return str(tmp_path)


def got(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


ASKED = [{}, {"since": "2026-01-05", "until": "2026-01-09"}, {"kinds": ["article", "review"], "languages": ["en"], "fields": ["f1"]}, {"retracted": False, "with_abstract": True}, {"since": "2026-01-03", "kinds": ["preprint"], "most": 4}]


@pytest.mark.parametrize("asked", ASKED)
def test_same_candidates_as_the_scan(spark, folder, asked):
    want = got(feeds.works(spark, f"{folder}/p*.json", **asked))
    assert want and got(pages.works(spark, pages.FolderPages, folder, **asked)) == want
    pages.write_list(folder)
    assert got(pages.works(spark, pages.FolderPages, folder, **asked)) == want


def test_filters_are_answered_by_the_source_and_pages_left_out(spark, folder):
    found = pages.rows(spark, pages.FolderPages, folder).where("published BETWEEN DATE '2026-01-05' AND DATE '2026-01-06' AND kind = 'article'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("BatchScan", "") and re.search(r"works_pages", plan)
    assert found.rdd.getNumPartitions() == 12
    n = found.count()
    pages.write_list(folder)
    again = pages.rows(spark, pages.FolderPages, folder).where("published BETWEEN DATE '2026-01-05' AND DATE '2026-01-06' AND kind = 'article'")
    assert again.rdd.getNumPartitions() == 1 and again.count() == n > 0


def test_a_service_is_told_what_is_wanted(spark, folder, tmp_path):
    every = [record(k, random.Random(3)) for k in range(45)]

    def page(number, asked):
        (tmp_path / f"asked-{number}.txt").write_text(json.dumps({k: str(v) for k, v in asked.items()}))
        return every[(number - 1) * 20 : number * 20]

    source = pages.service_pages("some_service", page, 4)
    found = pages.works(spark, source, since="2026-01-02", kinds=["article"])
    assert all(r.source_type == "article" and r.date >= dt.date(2026, 1, 2) for r in found.collect())
    assert len(list(tmp_path.glob("asked-*.txt"))) == 4
    assert json.loads((tmp_path / "asked-2.txt").read_text()) == {"since": "2026-01-02", "until": "9999-12-31", "kind": "['article']"}
    assert pages.rows(spark, source).count() == 45


def test_no_pages_and_broken_ones(spark, tmp_path):
    assert pages.rows(spark, pages.FolderPages, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(Exception, match="JSON|Expecting"):
        pages.rows(spark, pages.FolderPages, str(tmp_path)).count()
