"""Sinks: partitioned days, the ledger written last, appended run lines."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame


def write_days(days: DataFrame, path: str, by: str = "date") -> None:
    """Whole days; a day that is written again is replaced, the others stay."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def append_run(line: DataFrame, path: str) -> None:
    line.coalesce(1).write.mode("append").json(path)


def publish(days: DataFrame, entries: DataFrame, line: DataFrame, *, archive: str, ledger: str, runs: str, least: int) -> bool:
    """Nothing is written below `least` rows but the run line; else the days come first and the ledger after them."""
    enough = entries.limit(least).count() >= least
    if enough:
        write_days(days, archive)
        append_ledger(entries, ledger)
    append_run(line, runs)
    return enough


def write_text(fs_path: str, text: str) -> None:
    """One small file, whole or not at all: written beside its place and moved there."""
    place = pathlib.Path(fs_path)
    place.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=place.parent, prefix=place.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(name, place)
    except BaseException:
        os.unlink(name)
        raise


def rewrite_ledger(entries: DataFrame, path: str) -> None:
    """The whole ledger anew, beside the old one until it is complete."""
    fresh = f"{path}.new"
    entries.write.mode("overwrite").json(fresh)
    old = pathlib.Path(path)
    if old.exists():
        os.replace(path, f"{path}.old-{uuid.uuid4().hex}")
    os.replace(fresh, path)
