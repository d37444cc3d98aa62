"""Writing the chosen rows' summaries through a callable, within budgets, and deciding whether a day is published.

A day has a handful of rows, so this is a loop on the driver over rows that a ranking has limited; the corpus stays in DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOP_UPS = 2


class Client(Protocol):
    """What writes summaries. `complete` raises if there is none to be had."""

    def complete(self, row: dict[str, Any], corrections: Sequence[str]) -> dict[str, Any]: ...

    def calls(self) -> int: ...


@dataclass
class Written:
    summary: dict[str, Any] | None
    findings: list[str] = field(default_factory=list)
    error: str | None = None


def write(client: Client, row: dict[str, Any], check: Callable[[dict[str, Any]], list[str]], regenerations: int = 2) -> Written:
    """The attempt with the fewest hard findings, the first of equals. A failure ends the loop once there is a usable attempt."""
    best, error = Written(None), None
    corrections: list[str] = []
    for _ in range(regenerations + 1):
        try:
            summary = client.complete(row, corrections)
        except Exception as e:  # whatever the client raises is its failure to write
            error = str(e) or type(e).__name__
            if best.summary is not None:
                break
            continue
        corrections = check(summary)
        if best.summary is None or len(corrections) < len(best.findings):
            best = Written(summary, corrections)
        if not corrections:
            break
    return best if best.summary is not None else Written(None, error=error or "no attempts")


@dataclass
class Day:
    entries: list[tuple[dict[str, Any], Written]]
    dropped: list[tuple[Any, str]]
    degradations: list[tuple[str, str]]
    outcome: str
    exit_code: int
    shortfall: str | None


def produce(
    client: Client, selected: Sequence[dict[str, Any]], remainder: Sequence[dict[str, Any]], check: Callable[[dict[str, Any]], list[str]], *, wanted: int = 5, least: int = 3, cap: int = 2, gate: float = 0.35,
    max_calls: int = 60, regenerations: int = 2, shortfall: str = "candidate-shortage", degradations: Sequence[tuple[str, str]] = (),
) -> Day:
    """Summaries of the selected rows; a row that can't be written is replaced, MAX_TOP_UPS times at most, by the first of the remainder that
    passes the gate and leaves its subfield within the cap. The call budget is looked at before each row. Too few rows: nothing is published."""
    queue, reserve, day = list(selected), list(remainder), Day([], [], list(degradations), "published", 0, None)
    top_ups = 0
    while queue and len(day.entries) < wanted:
        if client.calls() >= max_calls:
            day.degradations.append(("budget", f"hit {max_calls} calls"))
            break
        row = queue.pop(0)
        written = write(client, row, check, regenerations)
        if written.summary is not None:
            day.entries.append((row, written))
            continue
        day.dropped.append((row["id"], "summarisation_failed"))
        day.degradations.append(("generation", written.error or ""))
        used = Counter(r["subfield"] for r in [*(r for r, _ in day.entries), *queue])
        fits = [r for r in reserve if r["explainability"] >= gate and used[r["subfield"]] < cap]
        if top_ups < MAX_TOP_UPS and fits:
            top_ups += 1
            reserve.remove(fits[0])
            queue.append(fits[0])
    if len(day.entries) < wanted:
        day.shortfall = "diversity-cap" if shortfall == "diversity-cap" else "candidate-shortage"
    if len(day.entries) < least:
        day.outcome, day.exit_code = "aborted", 1
    elif day.degradations or day.shortfall or any(w.findings for _, w in day.entries):
        day.outcome = "published_degraded"
    return day


def by_source(degradations: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """One for each source, in the order they came, the details joined."""
    joined: dict[str, list[str]] = {}
    for source, detail in degradations:
        joined.setdefault(source, []).append(detail)
    return [(s, "; ".join(d)) for s, d in joined.items()]


def cost(tokens_in: int, tokens_out: int, cache_read: int, cache_write: int, price: tuple[float, float] | None) -> float | None:
    """Price of a run, given those of a million tokens in and out; cached tokens cost 0.1 to read and 1.25 to write. Null without a price."""
    if price is None:
        return None
    return ((tokens_in + 0.1 * cache_read + 1.25 * cache_write) * price[0] + tokens_out * price[1]) / 1e6


def costs(usage: DataFrame, model: str, prices: dict[str, tuple[float, float]], by: str) -> DataFrame:
    """(by, tokens_in, tokens_out, cost) of calls with tokens_in, tokens_out, cache_read and cache_write; a model without a price costs null, which sums leave out."""
    per_call = None
    for name, (price_in, price_out) in prices.items():
        one = (F.col("tokens_in") + 0.1 * F.col("cache_read") + 1.25 * F.col("cache_write")) * price_in + F.col("tokens_out") * price_out
        per_call = F.when(F.col(model) == name, one) if per_call is None else per_call.when(F.col(model) == name, one)
    priced = usage.withColumn("price_", F.lit(None).cast("double") if per_call is None else per_call)
    return priced.groupBy(by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum(F.col("price_").cast("decimal(28,6)")).cast("double") / 1e6).alias("cost"))


def joined(rows: DataFrame, by: str, order: str, message: str, detail: str) -> DataFrame:
    """One row for each source: its first message, and its details in order."""
    return rows.groupBy(by).agg(F.min_by(message, order).alias(message), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, detail))), lambda x: x[detail]), "; ").alias("details"))
