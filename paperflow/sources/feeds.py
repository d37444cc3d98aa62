"""Scans: a registry of them, works pages (JSON), feeds (Atom XML), the ledger, and archived days."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperflow.functions.identity import bare_doi, bare_work_id, normalise_doi, normalise_work_id, preprint_id_from_url, reconstruct, squeeze
from paperflow.sources.fetch import paged

TOPIC = "STRUCT<id: STRING, display_name: STRING, subfield: STRUCT<id: STRING, display_name: STRING>, field: STRUCT<id: STRING, display_name: STRING>>"
WORKS = f"""results ARRAY<STRUCT<id: STRING, doi: STRING, title: STRING, display_name: STRING, publication_date: STRING, type: STRING, primary_topic: {TOPIC},
  open_access: STRUCT<is_oa: BOOLEAN, oa_url: STRING>, primary_location: STRUCT<landing_page_url: STRING, license: STRING, source: STRUCT<display_name: STRING>>,
  cited_by_count: INT, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, is_retracted: BOOLEAN, abstract_inverted_index: MAP<STRING, ARRAY<INT>>, created_date: STRING, language: STRING, referenced_works_count: INT, best_oa_location: STRUCT<pdf_url: STRING>>>"""
ATOM = "id STRING, title STRING, summary STRING, published STRING, updated STRING, link ARRAY<STRUCT<_href: STRING, _rel: STRING, _title: STRING>>, author ARRAY<STRUCT<name: STRING>>, category ARRAY<STRUCT<_term: STRING>>, `arxiv:primary_category` STRUCT<_term: STRING>, `arxiv:doi` STRING"
LEDGER = "work_id STRING, doi STRING, preprint_id STRING, title_key STRING, published_on DATE, category STRING, entry_idx BIGINT"


@dataclass(frozen=True)
class Source:
    """A scan and the categories that it serves."""

    name: str
    applies: Callable[[str], bool]
    scan: Callable[[SparkSession, str], DataFrame]


def scan_all(spark: SparkSession, category: str, sources: list[Source]) -> DataFrame:
    """The union of the sources that serve a category, in their order, which source_rank keeps."""
    used = [s for s in sources if s.applies(category)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.scan(spark, category).withColumn("source_rank", F.lit(k)) for k, s in enumerate(used)])


def work_candidates(records: DataFrame, record: str = "r") -> DataFrame:
    """Candidates of work records (a struct column) with `valid`: an id, a title and a date that can be read."""
    r = F.col(record)
    day, doi = F.try_to_date(r["publication_date"]), bare_doi(r["doi"])
    out = records.select(
        bare_work_id(r["id"]).alias("id"), bare_work_id(r["id"]).alias("work_id"), squeeze(F.coalesce(r["title"], r["display_name"])).alias("title"), reconstruct(r["abstract_inverted_index"]).alias("abstract"), day.alias("date"),
        F.coalesce(r["primary_location"]["landing_page_url"], F.concat(F.lit("https://doi.org/"), doi), r["id"]).alias("url"), r["primary_location"]["license"].alias("licence"), F.lit("works").alias("source"), doi.alias("doi"),
        r["primary_topic"]["subfield"].alias("subfield"), r["primary_topic"]["field"].alias("field"), F.struct(r["primary_topic"]["id"].alias("id"), r["primary_topic"]["display_name"].alias("display_name")).alias("topic"),
        r["cited_by_count"].alias("cited_by_count"), r["referenced_works_count"].alias("referenced_works_count"), F.coalesce(r["open_access"]["is_oa"], F.lit(False)).alias("is_open_access"), F.coalesce(r["best_oa_location"]["pdf_url"], r["open_access"]["oa_url"]).alias("oa_pdf_url"),
        r["type"].alias("source_type"), (F.lower(r["type"]) == "preprint").alias("is_preprint"), F.coalesce(r["is_retracted"], F.lit(False)).alias("is_retracted"), F.filter(F.transform(r["authorships"], lambda a: F.trim(a["author"]["display_name"])), lambda n: n != "").alias("authors"),
        r["primary_location"]["source"]["display_name"].alias("venue"), F.try_to_date(r["created_date"]).alias("indexed_date"), r["language"].alias("language"),
    )
    return out.withColumn("valid", F.col("id").isNotNull() & F.coalesce(F.col("title") != "", F.lit(False)) & F.col("date").isNotNull())


def wanted_works(candidates: DataFrame, *, since: str | None = None, until: str | None = None, fields: list[str] | None = None, kinds: list[str] | None = None, languages: list[str] | None = None, with_abstract: bool = False, retracted: bool = True, most: int | None = None) -> DataFrame:
    """The records that a scan asks its source for, the newest first if only `most` are wanted. Filters that columns can answer reach the scan."""
    out = candidates.where(F.col("valid") & F.col("date").between(since or "0001-01-01", until or "9999-12-31"))
    for column, values in (("field.id", fields), ("source_type", kinds), ("language", languages)):
        if values is not None:
            out = out.where(F.col(column).isin(*values))
    if with_abstract:
        out = out.where(F.col("abstract").isNotNull())
    if not retracted:
        out = out.where(~F.col("is_retracted"))
    return (out if most is None else out.orderBy(F.col("date").desc(), "id").limit(most)).drop("valid")


def works(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, **asked) -> DataFrame:
    """Candidates of works pages; records without id, title or date are left out, and so are those that are not asked for."""
    records = spark.read.schema(WORKS).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return wanted_works(work_candidates(records), since=since, until=until, **asked)


def fetched_works(spark: SparkSession, page: Callable[[int], list[dict]], per_page: int, most_pages: int, **asked) -> DataFrame:
    """`works` of a paged service: pages up to a short one, a run's few hundred records, which become rows at once."""
    raw = [(json.dumps(r),) for r in paged(page, per_page, most_pages)]
    kind = spark.createDataFrame([], WORKS).schema["results"].dataType.elementType
    records = spark.createDataFrame(raw, "value string").select(F.from_json("value", kind).alias("r"))
    return wanted_works(work_candidates(records), **asked)


def counted(candidates: DataFrame, name: str = "works") -> tuple[DataFrame, Observation]:
    """The valid candidates, and what has read and left_out once they have been read: counted in the same pass."""
    seen = Observation(name)
    return candidates.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(~F.col("valid")).alias("left_out")).where("valid"), seen


def left_out(records: DataFrame) -> DataFrame:
    """(read, left_out) of work records."""
    return work_candidates(records).agg(F.count(F.lit(1)).alias("read"), F.count_if(~F.col("valid")).alias("left_out"))


def broken_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of XML files that are not well formed as a whole. A reader by rows sees no fault in a file cut after a row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    ElementTree.fromstring(content)
                except ElementTree.ParseError as error:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([str(error)])], ["path", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(check, "path string, error string")


def entry_candidates(entries: DataFrame) -> DataFrame:
    """Candidates of Atom entries: preprints, all of them open. Entries without id, title or date are left out."""
    href = lambda test: F.get(F.filter("link", test), F.lit(0))["_href"]
    ident, area = preprint_id_from_url(F.col("id")), F.coalesce(F.col("`arxiv:primary_category`")["_term"], F.get("category", F.lit(0))["_term"])
    subject = F.when(area.isNotNull(), F.struct(F.concat(F.lit("arxiv:"), area).alias("id"), area.alias("display_name")))
    day, abstract = F.try_to_date(F.substring(F.coalesce("published", "updated"), 1, 10)), squeeze("summary")
    out = entries.select(
        F.concat(F.lit("arxiv:"), ident).alias("id"), squeeze("title").alias("title"), F.when(abstract != "", abstract).alias("abstract"), day.alias("date"), F.coalesce(href(lambda x: x["_rel"] == "alternate"), F.regexp_replace("id", "^http:", "https:")).alias("url"),
        F.coalesce(href(lambda x: x["_rel"] == "license"), F.lit("arxiv-nonexclusive")).alias("licence"), F.lit("arxiv").alias("source"), bare_doi(F.col("`arxiv:doi`")).alias("doi"), subject.alias("subfield"), href(lambda x: x["_title"] == "pdf").alias("oa_pdf_url"),
        F.lit(True).alias("is_preprint"), F.lit(True).alias("is_open_access"), F.lit(False).alias("is_retracted"), F.lit("arXiv").alias("venue"), day.alias("indexed_date"), F.filter(F.transform("author", lambda a: squeeze(a["name"])), lambda n: n != "").alias("authors"),
        F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("areas"),
    )
    return out.where((F.col("id") != "arxiv:") & (F.col("title") != "") & F.col("date").isNotNull())


def atom(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, areas: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Candidates of Atom feeds; a file that is not well formed as a whole is an error."""
    if bad := broken_documents(spark, path).limit(1).collect():
        raise ValueError(f"{bad[0]['path']} is not well formed: {bad[0]['error']}")
    rows = entry_candidates(spark.read.format("xml").option("rowTag", "entry").option("mode", "FAILFAST").schema(ATOM).load(path))
    rows = rows.where(F.col("date").between(since or "0001-01-01", until or "9999-12-31"))
    if areas is not None:
        rows = rows.where(F.arrays_overlap("areas", F.array(*map(F.lit, areas))))
    return (rows if most is None else rows.orderBy(F.col("date").desc(), "id").limit(most)).drop("areas")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, its identifiers in the forms that are compared; none yet is an empty one, a malformed one an error."""
    try:
        rows = spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)
    return rows.withColumns({"work_id": normalise_work_id(F.col("work_id")), "doi": normalise_doi(F.col("doi"))})


def archived_days(spark: SparkSession, folder: str) -> DataFrame:
    """(date, label, titles) of documents named by their day; the name's date counts, what cannot be read is left out."""
    raw = spark.read.text(folder, wholetext=True).withColumn("date", F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})\.json$", 1))
    body = F.from_json("value", "categoryLabel STRING, entries ARRAY<STRUCT<title: STRING>>")
    return raw.where(F.col("date") != "").select("date", body.alias("b")).where(F.col("b.entries").isNotNull()).select("date", F.col("b.categoryLabel").alias("label"), F.col("b.entries.title").alias("titles")).orderBy(F.col("date").desc())
