"""A day from scans to the ledger: merge, exclude, rank, look up, choose, write, publish.

The corpus stays in DataFrames up to the shortlist; what generation and pages take from there is a day's handful of rows."""

from __future__ import annotations

import datetime as dt
import json
import pathlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperflow.config import Config
from paperflow.functions import identity, scoring
from paperflow.operators import generation, gram_index, ledger, merge, render, selection
from paperflow.sources import feeds, sinks
from paperflow.tables import durable

LEAD = ["id", "title", "date", "url", "source"]
FILL = ["abstract", "licence", "work_id", "oa_pdf_url", "venue", "indexed_date", "subfield_id", "field_id", "authors", "cited_by_count", "referenced_works_count", "source_type"]
FLAGS = ["is_preprint", "is_retracted", "is_open_access"]
COLUMNS = {"work_id": "string", "doi": "string", "oa_pdf_url": "string", "abstract": "string", "licence": "string", "venue": "string", "indexed_date": "date", "authors": "array<string>", "cited_by_count": "int", "referenced_works_count": "int", "source_type": "string"}


@dataclass
class Discovery:
    """What a day chose and why."""

    ranked: DataFrame
    selected: list[dict[str, Any]]
    remainder: list[dict[str, Any]]
    reasons: dict[str, int]
    fetched: dict[str, int]
    shortfall: str
    notes: list[tuple[str, str]] = field(default_factory=list)


def merged(records: DataFrame) -> DataFrame:
    """Sources' candidates as one list in their order, the same paper once."""
    have = set(records.columns)
    rows = records.select("*", *[F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c not in have])
    part = lambda c: F.col(c)["id"].alias(f"{c}_id") if c in have else F.lit(None).cast("string").alias(f"{c}_id")
    order = F.struct("source_rank", (-F.unix_date("date")).alias("age"), "id").alias("place")
    rows = rows.select(*LEAD, "doi", *[c for c in FILL if c not in ("subfield_id", "field_id")], part("subfield"), part("field"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) if c in have else F.lit(False).alias(c) for c in FLAGS], "source_rank", order)
    rows = rows.withColumn("merge_key", F.nullif(identity.merge_key(F.col("title")), F.lit("")))
    return merge.merge_fold(rows.drop("source_rank"), place="place", doi="doi", title="merge_key", lead=LEAD, fill=FILL, any_true=FLAGS)


def scored(rows: DataFrame, config: Config, today: Column, domains: dict[str, list[str]]) -> DataFrame:
    """Rows with their factors, total, subfield_key and evidence."""
    review = scoring.peer_review(F.col("is_preprint"), F.col("source_type"), F.col("venue"))
    access, n = scoring.open_access(F.col("is_open_access"), F.col("licence")), scoring.sample_size(identity.squeeze(F.coalesce("abstract", F.lit(""))))
    tldr = F.col("tldr") if "tldr" in rows.columns else F.lit(None).cast("string")
    body = F.concat_ws(" ", "abstract", tldr)
    base = rows.select("*", scoring.explainability(F.col("title"), F.col("abstract"), tldr).alias("explain"), scoring.everyday_relevance(F.col("title"), body, domains).alias("everyday"), review.alias("review"), access.alias("access"), n.alias("n_cases"))
    factors = {"explainability": F.col("explain")["value"], "everyday_relevance": F.col("everyday")["value"], "freshness": scoring.freshness(F.col("age"), config.freshness_days), "credibility": scoring.credibility(F.col("review"), F.col("n_cases"), F.col("access"))}
    out = base.withColumns(factors).withColumn("subfield_key", identity.subfield_key(F.col("subfield_id"), F.col("field_id"), F.col("id")))
    out = out.withColumn("total", scoring.total_score(config.weights, **{k: F.col(k) for k in factors}))
    score = F.struct("total", "explain", "everyday", "age", "review", "access", "n_cases")
    return out.withColumn("evidence", scoring.evidence(score, config.weights, config.gate))


def discover(records: DataFrame, history: DataFrame, config: Config, today: dt.date, domains: dict[str, list[str]], lookup: DataFrame | None = None, index: str | None = None) -> Discovery:
    """The day's choice among candidates of all sources. `lookup` has key, abstract and tldr; `index` is where the ledger's titles are indexed, if they are."""
    now = F.lit(today.isoformat()).cast("date")
    records = durable(records)
    fetched = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    papers = merged(records)
    known = identity.candidate_identity(F.col("id"), F.col("source"), F.col("work_id"), F.col("doi"), F.col("title"))
    papers = papers.withColumn("identity", known).select("*", F.col("identity.preprint_id").alias("preprint_id"), F.col("identity.title_key").alias("title_key")).withColumns({"work_id": F.col("identity.work_id"), "doi": F.col("identity.doi")})
    asked = papers.select("id", "work_id", "doi", "preprint_id", F.col("title_key").alias("key"))
    seen = ledger.seen_or_similar(asked, history.withColumn("key", F.coalesce("title_key", F.lit(""))), now, config.window_days, index=index).select("id", "seen_kind")
    aged = papers.join(seen, "id", "left").withColumn("age", scoring.age_in_days(F.col("date"), F.col("indexed_date"), now))
    reason = selection.exclusion_reason(title=F.col("title"), abstract=F.col("abstract"), tldr=F.lit(None).cast("string"), kind=F.col("source_type"), retracted=F.col("is_retracted"), age=F.col("age"), seen=F.col("seen_kind"), freshness_days=config.freshness_days, least_chars=config.least_abstract_chars, defer_abstract=lookup is not None)
    judged = durable(aged.withColumn("reason", reason))
    reasons = {r["reason"]: r["n"] for r in selection.counts_by_reason(judged).collect()}
    order = selection.ranking("total", "explainability", "date", "access", "credibility", "id")
    shortlist = selection.top(scored(judged.where(F.col("reason").isNull()), config, now, domains), order, config.shortlist)
    if lookup is not None:
        keyed = shortlist.withColumn("key", identity.lookup_key(F.col("doi"), F.col("preprint_id")))
        filled = merge.enrich(keyed.drop("explain", "everyday", "review", "access", "n_cases", *config.weights, "subfield_key", "total", "evidence", "rank"), lookup, "key", "abstract", "tldr")
        late = selection.exclusion_reason(title=F.col("title"), abstract=F.col("abstract"), tldr=F.col("tldr"), kind=F.col("source_type"), retracted=F.col("is_retracted"), age=F.col("age"), seen=F.col("seen_kind"), freshness_days=config.freshness_days, least_chars=config.least_abstract_chars)
        shortlist = selection.top(scored(filled.withColumn("reason", late).where(F.col("reason").isNull()), config, now, domains), order, config.shortlist)
    ranked = durable(shortlist)
    chosen = durable(selection.select_day(ranked, "id", "subfield_key", order, F.col("explainability") >= config.gate, **config.selection()))
    selected = [r.asDict(recursive=True) for r in chosen.orderBy("rank").collect()]
    rest = [r.asDict(recursive=True) for r in ranked.join(chosen.select("id"), "id", "left_anti").orderBy("rank").collect()]
    passing = sum(r["explainability"] >= config.gate for r in [*selected, *rest])
    short = "none" if len(selected) >= config.papers_per_day else "diversity-cap" if passing > len(selected) else "candidate-shortage"
    return Discovery(ranked, selected, rest, reasons, fetched, short)


@dataclass
class Result:
    outcome: str
    exit_code: int
    line: dict[str, Any]


def run_day(spark: SparkSession, config: Config, root: str, sources: list[feeds.Source], client: generation.Client | None, *, today: dt.date, domains: dict[str, list[str]], check: Callable[[dict[str, Any]], list[str]] = lambda _: [], lookup: DataFrame | None = None, dry_run: bool = False, force: bool = False, skip_if_published: bool = False, discover_only: bool = False, index: str | None = None) -> Result:
    """One day under `root` (archive, ledger, runs). A published day is not published again unless forced; the ledger is written last, a run line always.

    With `index`, the path of a `gram_index` of the ledger's titles, titles are looked up there, and what is published is added before the ledger tells of it."""
    twin = pathlib.Path(root) / "archive" / f"{today.isoformat()}.json"
    category = config.category(today.isoweekday())
    line: dict[str, Any] = {"run_id": today.isoformat(), "category": category.key, "outcome": "skipped"}
    if twin.exists() and not (dry_run or force):
        if skip_if_published:
            return Result("skipped", 0, line)
        raise FileExistsError(f"{today} is published already")
    history = feeds.ledger(spark, f"{root}/ledger")
    found = discover(feeds.scan_all(spark, category.key, sources), history, config, today, domains, lookup, index)
    line |= {"fetched": found.fetched, "reasons": {k: v for k, v in found.reasons.items() if v}, "selected": [r["id"] for r in found.selected], "shortfall": found.shortfall}
    if discover_only or client is None:
        return Result("discovered", 0, line | {"outcome": "discovered"})
    rows = [r | {"subfield": r["subfield_key"]} for r in found.selected]
    rest = [r | {"subfield": r["subfield_key"]} for r in found.remainder]
    day = generation.produce(client, rows, rest, check, wanted=config.papers_per_day, least=config.least_papers, cap=config.cap, gate=config.gate, max_calls=config.max_calls, regenerations=config.regenerations, shortfall=found.shortfall)
    line |= {"outcome": day.outcome, "dropped": day.dropped, "degradations": generation.by_source(day.degradations), "calls": client.calls()}
    if day.exit_code == 0 and not dry_run:
        publish(spark, config, root, category.key, category.label, today, day, history, index)
    if not dry_run:
        sinks.append_run(spark.createDataFrame([(json.dumps(line, default=str),)], "line string"), f"{root}/runs")
    return Result(day.outcome, day.exit_code, line)


ENTRY = "date date, rank int, title string, url string, authors array<string>, summary string, notes string"


def entry_rows(document: dict[str, Any]) -> list[tuple]:
    day = dt.date.fromisoformat(document["date"])
    return [(day, n, e["title"], e["url"], e["authors"], e["summary"], note) for n, e in enumerate(document["entries"]) for note in (document["notes"] or [None])]


def write_page(spark: SparkSession, config: Config, root: str, document: dict[str, Any]) -> None:
    rows = spark.createDataFrame(entry_rows(document), ENTRY).groupBy("date", "rank", "title", "url", "authors", "summary").agg(F.collect_list("notes").alias("all_notes"))
    rows = rows.select("date", "rank", "title", "url", "authors", "summary", F.explode_outer("all_notes").alias("notes"))
    first = rows.withColumn("notes", F.when(F.col("rank") == 0, F.col("notes"))).distinct()
    html = render.day_pages(first.dropDuplicates(["rank", "notes"]), config.language).first()["html"]
    sinks.write_text(f"{root}/archive/{document['date']}.html", html)


def publish(spark: SparkSession, config: Config, root: str, key: str, label: str, today: dt.date, day: generation.Day, history: DataFrame, index: str | None = None) -> None:
    """Page and twin, then the index, then the ledger."""
    notes = list(dict.fromkeys(render.degradation_text(s, config.language) for s, _ in generation.by_source(day.degradations)))
    entries = [{"id": r["id"], "title": r["title"], "url": r["url"], "authors": r["authors"] or [], "summary": w.summary.get("text", "") if w.summary else "", "score": r["total"], "rank": r["rank"], "evidence": r["evidence"], "findings": w.findings} for r, w in day.entries]
    document = {"schemaVersion": 1, "date": today.isoformat(), "category": key, "categoryLabel": label, "entries": entries, "notes": notes, "shortfall": day.shortfall}
    write_page(spark, config, root, document)
    sinks.write_text(f"{root}/archive/{today.isoformat()}.json", json.dumps(document, ensure_ascii=False, indent=1, sort_keys=True, default=str) + "\n")
    reindex(spark, config, root)
    fresh = [(n, r["work_id"], r["doi"], r["preprint_id"], r["title_key"], key) for n, (r, _) in enumerate(day.entries)]
    rows = spark.createDataFrame(fresh, "id int, work_id string, doi string, preprint_id string, title_key string, category string")
    state = durable(ledger.record_published(history.drop("key"), rows, F.lit(today.isoformat()).cast("date"), index))
    if index is not None:
        gram_index.append(spark, index, rows, "title_key")
    sinks.rewrite_ledger(state, f"{root}/ledger")


def reindex(spark: SparkSession, config: Config, root: str) -> None:
    """The index anew from the twins; the same twins give the same bytes."""
    days = feeds.archived_days(spark, f"{root}/archive/*.json").select(F.col("date").cast("date").alias("date"), F.coalesce("label", F.lit("")).alias("category"), "titles")
    sinks.write_text(f"{root}/index.html", render.index_page(days, config.language).first()["html"])


def rerender(spark: SparkSession, config: Config, root: str) -> int:
    """Every page anew from its twin, and the index; twins of another format are left alone. How many pages were written."""
    n = 0
    for twin in sorted(pathlib.Path(root, "archive").glob("????-??-??.json")):
        document = json.loads(twin.read_text(encoding="utf-8"))
        if document.get("schemaVersion") == 1 and document.get("entries"):
            write_page(spark, config, root, document)
            n += 1
    reindex(spark, config, root)
    return n
