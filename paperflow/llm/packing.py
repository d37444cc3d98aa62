"""Best-fit packing into sequences of several permitted lengths.

Lengths are counted in the JVM. Texts longer than the longest sequence are cut into pieces of that length and a
rest. Pieces are dealt by hash into shards of about `shard_tokens`, each packed on its own: pieces in falling
length; a piece goes to the open bin that it leaves fullest, and if none takes it, a bin is opened. Which length it
gets is decided by what the pieces still to come can put in it: each permitted length is filled on trial, longest
fitting piece first, and shrunk to its contents, and the one that costs least a token is opened. At the end every bin
shrinks to the shortest permitted length that holds its contents. A shard is packed so for every mix of the
permitted lengths that holds its longest piece, and the mix that costs least stays (of equal ones, the one with fewer
sequences). A shard's memory is bounded by `shard_tokens` and its bins are the same whenever it is computed again.

Defined cases: a text without tokens (null, empty, blank) gets one row without bin; equal lengths go by id and piece;
repeated rows are packed each, and are dealt into different shards where there are many; a row without id is packed
like any other; a table without rows gives none. The result has columns of its own, so input columns may have any names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperflow.llm.common import durable

LENGTHS = (1024, 2048, 4096, 8192)


def sequence_cost(length: int) -> float:
    """What a sequence costs in tokens: a fixed part, its tokens, and attention that grows with the square."""
    return 256 + length + length * length / 65536


class Lengths:
    """How many pieces of each length are still to come."""

    def __init__(self, lengths: np.ndarray):
        sizes, counts = np.unique(lengths, return_counts=True)
        self.sizes, self.counts = sizes.tolist(), dict(zip(sizes.tolist(), counts.tolist(), strict=True))

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
            self.sizes.pop(bisect.bisect_left(self.sizes, n))

    def fill(self, room: int) -> int:
        """How much of `room` the pieces still to come fill, longest fitting piece first."""
        used, at = 0, bisect.bisect_right(self.sizes, room) - 1
        while at >= 0:
            n = self.sizes[at]
            used += n * min(self.counts[n], (room - used) // n)
            at = min(at - 1, bisect.bisect_right(self.sizes, room - used) - 1)
        return used


def pack(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it, length of each bin) for pieces given in falling length, with bins of all the permitted lengths."""
    sizes = sorted(permitted)
    price = {c: cost(c) for c in sizes}
    shrunk = lambda used: price[sizes[bisect.bisect_left(sizes, used)]]
    coming = Lengths(lengths)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used, room, by_room = [], [], {}
    rooms: list[int] = []  # distinct rooms of open bins, rising
    for k, n in enumerate(lengths.tolist()):
        coming.take(n)
        i = bisect.bisect_left(rooms, n)
        if i < len(rooms):
            b = by_room[rooms[i]].pop()
            if not by_room[rooms[i]]:
                del by_room[rooms[i]]
                rooms.pop(i)
        else:
            trial = {c: n + coming.fill(c - n) for c in sizes if c >= n}
            c = min(trial, key=lambda c: (shrunk(trial[c]) / trial[c], c))
            b = len(used)
            used.append(0)
            room.append(c)
        where[k], offset[k] = b, used[b]
        used[b] += n
        room[b] -= n
        if room[b]:
            if room[b] not in by_room:
                by_room[room[b]] = []
                bisect.insort(rooms, room[b])
            by_room[room[b]].append(b)
    return where, offset, np.array(sizes)[np.searchsorted(sizes, np.array(used, dtype=np.int64))]


def pack_jointly(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`pack` with the mix of permitted lengths that costs least. Bins shrink to any permitted length."""
    sizes, best = np.array(sorted(permitted)), None
    longest = int(lengths.max()) if len(lengths) else 0
    for n in range(1, len(sizes) + 1):
        for mix in combinations(sizes.tolist(), n):
            if mix[-1] >= longest:
                where, offset, _ = pack(lengths, mix, cost)
                used = np.bincount(where, weights=lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
                got = sizes[np.searchsorted(sizes, used)]
                total = (round(float(sum(cost(c) * k for c, k in zip(*(x.tolist() for x in np.unique(got, return_counts=True)), strict=True))), 6), len(got))
                if best is None or total < best[0]:
                    best = (total, (where, offset, got))
    return best[1]


def best_fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", permitted: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, shard_tokens: int = 1 << 22) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, offset, sequence_length): where each piece of each text goes. Tokens are blank-separated words."""
    longest = max(permitted)
    tokens = F.coalesce(F.size(F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")
    # equal rows are one row with a count, so that many of them spread over shards by their number
    counted = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.when(F.col(f"`{text}`").isNull(), 0).otherwise(tokens).alias("total"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    counted = durable(counted.groupBy("doc_id", "total", "body").agg(F.count(F.lit(1)).alias("times")))
    shards = int((counted.agg(F.sum(F.col("total") * F.col("times")).alias("n")).first()["n"] or 0) // shard_tokens) + 1
    each = counted.select("doc_id", "total", "body", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    pieces = each.where("total > 0").select("doc_id", "total", "body", "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / longest))).alias("piece"))
    pieces = pieces.select(F.pmod(F.xxhash64("doc_id", "piece", "total", "body", "copy"), F.lit(shards)).alias("shard"), "doc_id", "body", "copy", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("total") - F.col("piece") * longest).alias("n_tokens"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "body", "copy"))])
        where, offset, sizes = pack_jointly(t.column("n_tokens").to_numpy(), permitted, cost)
        shard = t.column("shard")[0].as_py()
        return pa.table({"doc_id": t.column("doc_id"), "piece": t.column("piece"), "start": t.column("start"), "n_tokens": t.column("n_tokens"), "bin": pa.array((shard << 32) + where), "offset": pa.array(offset), "sequence_length": pa.array(sizes[where])})

    kind = counted.schema["doc_id"].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, bin bigint, offset bigint, sequence_length bigint")
    none = F.lit(None).cast("bigint")
    return packed.unionByName(each.where("total = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), "total", none.alias("bin"), none.alias("offset"), none.alias("sequence_length")).withColumnRenamed("total", "n_tokens"))
