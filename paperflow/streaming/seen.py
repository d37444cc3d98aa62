"""The ledger's window as a stateful stream: whether a key was published within a number of days, and the state after it.

For each key the state is the last day it was published; it only moves forward. Keys are dealt by hash into groups, which
hold the days of their keys, so that Python is called for a group and not for each key. A timer lets a day go once the
watermark has passed its horizon, so state does not grow with the ledger's age. A row that comes with a day ahead of
the last one, or with none that can be read before it, is judged as `operators.ledger.within_window` does: what is dated
ahead blocks too.

Rows of one key are told in the order of (day, id) within a micro-batch. If days come in order, however micro-batches
cut them, the stream says what `seen_before` says of all rows at once. Rows later than the watermark are left out, as by
any stateful operator of Spark. Rows without key or day are passed by: they are never seen and leave no state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "id long, key string, day date, seen boolean"
#: What the state is kept in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Into how many groups keys are dealt.
GROUPS = 4096
DAY_MS = 86_400_000


def _judged(days: int) -> Callable[[tuple[int], Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What becomes of a group's rows (id, key, number of the day) in a micro-batch, and of the days it holds."""

    def of_group(_: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["key", "day", "id"])
            key, day = rows["key"].to_numpy(), rows["day"].to_numpy()
            held = np.array([last.get(k, np.nan) for k in key], "float64")
            before = np.full(len(day), np.nan)
            before[1:] = np.where(key[1:] == key[:-1], day[:-1], np.nan)
            out = pd.DataFrame({"id": rows["id"], "key": key, "day": day, "seen": day - np.fmax(before, held) <= days})
            for k, d in zip(key.tolist(), day.tolist(), strict=True):
                last[k] = max(last.get(k, d), d)
        now = state.getCurrentWatermarkMs()
        kept = {k: d for k, d in last.items() if (d + days + 1) * DAY_MS > now}
        if kept:
            state.update((list(kept), list(kept.values())))
            state.setTimeoutTimestamp((min(kept.values()) + days + 1) * DAY_MS)
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    return of_group


def seen_within(stream: DataFrame, days: int = 180, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """(id, key, day, seen) of a stream of (id long, key string, day date)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    epoch = F.lit("1970-01-01").cast("date")
    rows = stream.where(F.col("key").isNotNull() & F.col("day").isNotNull()).withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", late)
    dealt = rows.select("id", "key", F.date_diff("day", epoch).alias("day"), "at", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("part"))
    told = dealt.groupBy("part").applyInPandasWithState(_judged(days), "id long, key string, day int, seen boolean", "keys array<string>, days array<int>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("id", "key", F.date_add(epoch, F.col("day")).alias("day"), "seen")


def seen_before(rows: DataFrame, days: int = 180) -> DataFrame:
    """The same of all rows at once."""
    before = Window.partitionBy("key").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where(F.col("key").isNotNull() & F.col("day").isNotNull()).select("id", "key", "day", F.coalesce(F.date_diff("day", F.max("day").over(before)) <= days, F.lit(False)).alias("seen"))
