"""Works pages as a data source of Spark: one partition a page, filters answered before a record leaves its page.

A source of pages is a folder of JSON files (`FolderPages`) or a paged service (`service_pages`). Either gives rows of
(id, published, kind, language, field, retracted, record), the record as JSON. What Spark pushes down (comparisons,
equality and membership of these columns) is tested where the page is read; a service is told of it, too. A folder may
have a list of its pages with their first and last dates (`write_list`): pages that lie outside the dates asked for are
no partitions at all. `works` turns the rows into candidates.

Defined cases: a record without id or with a date that cannot be read is a row with nulls there, and is left out where a filter asks
for it; an empty folder gives no rows; a page that is not JSON is an error."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from paperflow.session import reachable
from paperflow.sources import feeds

SCHEMA = "id string, published date, kind string, language string, field string, retracted boolean, record string"
COLUMNS = ("id", "published", "kind", "language", "field", "retracted")
TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}
LIST = "_pages.json"


def _date(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat((text or "").strip())
    except ValueError:
        return None


def row_of(record: dict[str, Any]) -> tuple:
    field = ((record.get("primary_topic") or {}).get("field") or {}).get("id")
    return (record.get("id"), _date(record.get("publication_date")), record.get("type"), record.get("language"), field, bool(record.get("is_retracted")), json.dumps(record, ensure_ascii=False))


def answers(f: Filter) -> bool:
    """Whether a page's reader can test a filter by itself."""
    inner = f.child if isinstance(f, Not) else f
    column = getattr(inner, "attribute", ())
    return len(column) == 1 and column[0] in COLUMNS and (type(inner) in TESTS or (isinstance(inner, IsNotNull) and inner is f))


def passes(row: tuple, filters: Iterable[Filter]) -> bool:
    for f in filters:
        inner = f.child if isinstance(f, Not) else f
        value = row[COLUMNS.index(inner.attribute[0])]
        if value is None or not (isinstance(f, IsNotNull) or TESTS[type(inner)](value, inner.value) != isinstance(f, Not)):
            return False
    return True


def dates_asked(filters: Iterable[Filter]) -> tuple[dt.date, dt.date]:
    """The first and last date that the filters leave."""
    first, last = dt.date.min, dt.date.max
    for f in filters:
        if not isinstance(f, (Not, IsNotNull)) and f.attribute == ("published",):
            values = list(f.value) if isinstance(f, In) else [f.value]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                first = max(first, min(values))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                last = min(last, max(values))
    return first, last


class Page(InputPartition):
    """A page by its number or the path of its file."""


class PageReader(DataSourceReader):
    """Reads pages that `pages` lists, by `fetch`."""

    def __init__(self) -> None:
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if answers(f):
                self.filters.append(f)
            else:
                yield f

    def fetch(self, page: Any) -> list[dict[str, Any]]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        records = self.fetch(partition.value) if partition is not None else []  # none is what Spark gives where there is no page
        rows = [r for r in map(row_of, records) if passes(r, self.filters)]
        kinds = [pa.string(), pa.date32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        names = [*COLUMNS, "record"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may be a URI of any that Arrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FolderReader(PageReader):
    def __init__(self, path: str) -> None:
        super().__init__()
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        first, last = dates_asked(self.filters)
        if files.get_file_info(f"{root}/{LIST}").type == fs.FileType.File:
            with files.open_input_stream(f"{root}/{LIST}") as f:
                listed = json.load(f)
            dated = (first, last) != (dt.date.min, dt.date.max)  # a record without a date is none of those asked for then
            return [Page(f"{root}/{p['file']}") for p in listed if not dated or (p["first"] and p["first"] <= last.isoformat() and p["last"] >= first.isoformat())]
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Page(p) for p in sorted(i.path for i in found if i.path.endswith(".json") and not i.base_name.startswith("_"))]

    def fetch(self, page: str) -> list[dict[str, Any]]:
        with opened(self.path)[0].open_input_stream(page) as f:
            return json.load(f)["results"]


class FolderPages(DataSource):
    """Format works_pages: the JSON files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "works_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return FolderReader(self.options["path"])


def service_pages(name: str, page: Callable[[int, dict[str, Any]], list[dict[str, Any]]], most_pages: int) -> type[DataSource]:
    """A data source of a paged service. `page` is asked for a page by its number, from 1, and told of what is wanted: since and until, and equal values by column.

    Every page is a partition, fetched where it is needed; those beyond the end are empty."""

    class ServiceReader(PageReader):
        def partitions(self) -> list[InputPartition]:
            return [Page(k) for k in range(1, most_pages + 1)]

        def fetch(self, number: int) -> list[dict[str, Any]]:
            first, last = dates_asked(self.filters)
            asked = {f.attribute[0]: list(f.value) if isinstance(f, In) else [f.value] for f in self.filters if isinstance(f, (EqualTo, In)) and f.attribute[0] != "published"}
            return page(number, {"since": first, "until": last, **asked})

    class ServicePages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: Any) -> DataSourceReader:
            return ServiceReader()

    return ServicePages


def write_list(path: str) -> None:
    """Lists the pages of a folder with their first and last dates."""
    files, root = opened(path)
    out = []
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".json") and not info.base_name.startswith("_"):
            with files.open_input_stream(info.path) as f:
                days = [_date(r.get("publication_date")) for r in json.load(f)["results"]]
            known = sorted(d.isoformat() for d in days if d)
            out.append({"file": info.base_name, "first": known[0] if known else None, "last": known[-1] if known else None})
    with files.open_output_stream(f"{root}/{LIST}") as f:
        f.write(json.dumps(out).encode())


def rows(spark: SparkSession, source: type[DataSource], path: str | None = None) -> DataFrame:
    """The rows of a data source of pages, with pushdown of filters."""
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    return reader.load(path) if path else reader.load()


def works(spark: SparkSession, source: type[DataSource], path: str | None = None, *, since: str | None = None, until: str | None = None, fields: list[str] | None = None, kinds: list[str] | None = None, languages: list[str] | None = None, retracted: bool = True, with_abstract: bool = False, most: int | None = None) -> DataFrame:
    """Candidates of works pages. What is asked for of dates, fields, kinds, languages and retractions is answered where a page is read."""
    found = rows(spark, source, path)
    if since or until:
        found = found.where(F.col("published").between(F.lit(since or "0001-01-01").cast("date"), F.lit(until or "9999-12-31").cast("date")))
    for column, values in (("field", fields), ("kind", kinds), ("language", languages)):
        if values is not None:
            found = found.where(F.col(column).isin(*values) if len(values) > 1 else F.col(column) == values[0])
    if not retracted:
        found = found.where(F.col("retracted") == F.lit(False))
    kind = spark.createDataFrame([], feeds.WORKS).schema["results"].dataType.elementType
    candidates = feeds.work_candidates(found.select(F.from_json("record", kind).alias("r")))
    return feeds.wanted_works(candidates, since=since, until=until, with_abstract=with_abstract, most=most)
