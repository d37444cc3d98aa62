"""The command line: run, reindex, rerender."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import pathlib
import sys

from pyspark.sql import SparkSession

from paperflow.config import Config
from paperflow.operators import day
from paperflow.session import reachable
from paperflow.sources import feeds


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="paperflow", description="A daily digest of papers.")
    out.add_argument("command", choices=("run", "reindex", "rerender"))
    out.add_argument("--root", required=True, help="folder of archive, ledger and runs")
    out.add_argument("--config", required=True, help="settings as JSON")
    out.add_argument("--works", help="pages of works (JSON)")
    out.add_argument("--feed", help="Atom feeds (XML)")
    out.add_argument("--client", help="module:function that returns what writes summaries")
    out.add_argument("--date", type=dt.date.fromisoformat, default=None)
    for flag in ("dry-run", "force", "discover-only", "skip-if-published"):
        out.add_argument(f"--{flag}", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, domains: dict[str, list[str]] | None = None) -> int:
    """0 published or skipped, 1 aborted, 2 wrong use or settings."""
    try:
        asked = parser().parse_args(argv)
        config = Config.read(pathlib.Path(asked.config).read_text(encoding="utf-8"))
    except SystemExit as stop:
        return 0 if stop.code == 0 else 2
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("paperflow").getOrCreate()
    reachable(spark)
    if asked.command == "reindex":
        day.reindex(spark, config, asked.root)
        return 0
    if asked.command == "rerender":
        day.rerender(spark, config, asked.root)
        return 0
    today = asked.date or dt.date.today()
    since, until = (today - dt.timedelta(days=config.freshness_days)).isoformat(), today.isoformat()
    category = config.category(today.isoweekday())
    sources = []
    if asked.works:
        fields = list(category.fields) or None
        sources.append(feeds.Source("works", lambda _: True, lambda s, _: feeds.works(s, asked.works, since, until, fields=fields, with_abstract=False, retracted=True)))
    if asked.feed:
        sources.append(feeds.Source("arxiv", lambda _: True, lambda s, _: feeds.atom(s, asked.feed, since, until, areas=list(category.areas) or None)))
    client = None
    if asked.client:
        module, _, name = asked.client.partition(":")
        client = getattr(importlib.import_module(module), name)()
    result = day.run_day(spark, config, asked.root, sources, client, today=today, domains=domains or {}, dry_run=asked.dry_run, force=asked.force, skip_if_published=asked.skip_if_published, discover_only=asked.discover_only or client is None)
    print(summary(result))
    return result.exit_code


def summary(result: day.Result) -> str:
    """A run in one line."""
    line = result.line
    parts = [f"{line['run_id']} {line['category']}: {result.outcome}"]
    if line.get("fetched") is not None:
        parts.append("fetched " + ", ".join(f"{k} {v}" for k, v in sorted(line["fetched"].items())))
    if line.get("reasons"):
        parts.append("left out " + ", ".join(f"{k} {v}" for k, v in sorted(line["reasons"].items())))
    if line.get("selected") is not None:
        parts.append(f"selected {len(line['selected'])}")
    return "; ".join(parts)


if __name__ == "__main__":
    sys.exit(main())
