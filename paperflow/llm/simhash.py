"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints come from an Arrow pass over the text. Distinct fingerprints go down a vantage-point tree whose upper
levels are fitted on a bounded sample (`SAMPLE_A_SHARD` fingerprints a shard): a fingerprint's home is one leaf, and
it also asks every leaf that the triangle bound |d(q, vantage) - radius| <= `distance` does not exclude. Inside a
leaf the tree goes on, for all queries at once, down to small blocks that are compared exactly. The sample decides
how even the leaves are, never which links are found: every fingerprint is indexed and each link within `distance`
is seen. A leaf that the sample shows to be dense is split by hash on either side, so no task holds more than about
`LEAF` fingerprints. Each task returns a spanning forest of its links instead of all pairs, and the forests are
joined into components.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer than
`shingle` words is one shingle; equal texts share a fingerprint and so a component; a row without doc_id belongs to
a component but cannot name it; a table without rows gives none; input columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import BLANK_LOWER, blocks, buffers, durable, free_name, word_spans
from paperflow.llm.components import components

LEAF, SAMPLE_A_SHARD, MOST_SHARDS, CHUNK_BYTES = 1 << 16, 64, 1 << 12, 1 << 20


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is set if more than half of the shingles' XXH64 set it."""
    raw, offsets = buffers(texts)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in blocks(offsets, CHUNK_BYTES):
        counted, starts, ends, first = word_spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_LOWER)
        if not len(starts):
            continue
        keep = counted != 0x20
        keep[1:] |= keep[:-1]  # one separator after each word
        to = np.cumsum(keep) - 1
        begin, end, line = to[starts], to[ends - 1] + 1, counted[keep].tobytes()
        words = np.diff(first)
        n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        have = np.flatnonzero(n)
        at = np.concatenate([[0], np.cumsum(n[have])])
        here = np.repeat(first[:-1][have] - at[:-1], n[have]) + np.arange(at[-1])
        last = here + np.repeat(np.minimum(words[have], shingle), n[have]) - 1
        hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(begin[here].tolist(), end[last].tolist(), strict=True)), dtype=np.uint64, count=len(here))
        set_ = np.zeros((len(have), 64), dtype=np.int32)
        for x in range(0, len(hashes), 1 << 16):
            y = min(len(hashes), x + (1 << 16))
            d0, d1 = np.searchsorted(at, x, "right") - 1, np.searchsorted(at, y - 1, "right")
            bits = np.unpackbits(hashes[x:y].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_[d0:d1] += np.add.reduceat(bits, np.maximum(at[d0:d1], x) - x, axis=0, dtype=np.int32)
        out[a + have] = np.packbits(2 * set_ > n[have][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprints(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, shingle: int = 3, seed: int = 42) -> tuple[DataFrame, str]:
    """The columns `carry` (all, if not given) with a bigint column of fingerprints; also that column's name."""
    carry = list(docs.columns) if carry is None else carry
    into, whole = free_name(carry, "fingerprint"), free_name(docs.columns, "whole_text")
    df = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(len(carry)), shingle, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(found.view(np.int64))], [*carry, into])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carry), T.StructField(into, T.LongType())])), into


def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(points: np.ndarray, distance: int, tries: int = 8) -> tuple[np.uint64, int]:
    """Of some evenly taken points and all radii, those which leave the least work: queries times homes on both sides."""
    best = (math.inf, points[0], 0)
    for v in points[:: max(1, len(points) // tries)][:tries]:
        below = np.cumsum(np.bincount(away(points, v), minlength=65)) / len(points)
        for r in range(64):
            inner = below[r]
            work = below[min(64, r + distance)] * inner + (1 - (below[r - distance] if r >= distance else 0)) * (1 - inner)
            if 0 < inner < 1 and work < best[0]:
                best = (work, v, r)
    return best[1], best[2]


class Shards:
    """The upper levels of the tree; leaves have numbers, and `parts` tells how many ways a leaf's homes and queries are split."""

    def __init__(self, sample: np.ndarray, total: int, distance: int, leaf: int = LEAF):
        self.distance, self.nodes, self.parts = distance, {}, []
        self.root = self._grow(sample, sample, max(1.0, total / max(1, len(sample))), leaf)

    def _grow(self, homes: np.ndarray, queries: np.ndarray, each: float, leaf: int) -> int:
        if len(homes) * each > leaf and len(homes) > 8 and len(self.parts) < MOST_SHARDS:
            v, r = vantage(homes, self.distance)
            d, q = away(homes, v), away(queries, v)
            near, far = q <= r + self.distance, q > r - self.distance
            if near.mean() * (d <= r).mean() + far.mean() * (d > r).mean() < 0.95:
                k = len(self.nodes) + 1
                self.nodes[k] = None
                self.nodes[k] = (v, r, self._grow(homes[d <= r], queries[near], each, leaf), self._grow(homes[d > r], queries[far], each, leaf))
                return k
        self.parts.append((max(1, math.ceil(len(homes) * each / (2 * leaf))), max(1, math.ceil(len(queries) * each / (8 * leaf)))))
        return -len(self.parts)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, index of a point, whether it is at home) for all groups that a point goes to."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node > 0:
                v, r, inner, outer = self.nodes[node]
                d = away(points[at], v)
                near, far = d <= r + self.distance, d > r - self.distance
                todo += [(inner, at[near], (home & (d <= r))[near]), (outer, at[far], (home & (d > r))[far])]
                continue
            rows, cols = self.parts[-node - 1]
            salt = (points[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            mine, ask = (salt % np.uint64(rows)).astype(np.int64), ((salt >> np.uint64(7)) % np.uint64(cols)).astype(np.int64)
            for x in range(rows):
                for y in range(cols):
                    there = home & (mine == x)
                    goes = there | (ask == y)
                    # 0: only asks, 1: only at home here, 2: both
                    out.append((np.full(goes.sum(), ((-node) << 32) | (x << 16) | y), at[goes], (there.astype(np.int64) + (there & (ask == y)))[goes]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def forest(homes: np.ndarray, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links between queries and homes, found by a vantage-point tree over the homes."""
    points = np.unique(np.concatenate([homes, queries]))
    label = np.arange(len(points))
    todo = [(np.searchsorted(points, np.unique(homes)), np.searchsorted(points, np.unique(queries)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > 64 and len(h) * len(q) > 1 << 14:
            v, r = vantage(points[h] if len(h) < 4096 else points[h[:: len(h) // 2048]], distance)
            d, e = away(points[h], v), away(points[q], v)
            near, far = e <= r + distance, e > r - distance
            if 0 < (d <= r).sum() < len(h) and near.mean() * (d <= r).mean() + far.mean() * (d > r).mean() < 0.95:
                todo += [(h[d <= r], q[near]), (h[d > r], q[far])]
                continue
        step = max(1, (1 << 20) // len(h))
        for x in range(0, len(q), step):
            part = q[x : x + step]
            linked = np.bitwise_count(points[part][:, None] ^ points[h][None, :]) <= distance
            i, j = np.nonzero(linked & (label[part][:, None] != label[h][None, :]))
            while len(i):
                a, b = label[part[i]], label[h[j]]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                if not len(i):
                    break
                to = np.arange(len(points))
                np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
                while (to != to[to]).any():
                    to = to[to]
                label = to[label]
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def links(points: DataFrame, column: str, distance: int = 3, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) between distinct bigint fingerprints whose components are those of all links within `distance`."""
    total = points.count()
    wanted = min(MOST_SHARDS, max(1, math.ceil(total / leaf))) * SAMPLE_A_SHARD
    sample = points.select(column).orderBy(F.xxhash64(column, F.lit("sample")), column).limit(wanted) if total > leaf else points.limit(0).select(column)
    tree = Shards(np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64), total, distance, leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                group, at, role = tree.route(found)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(found[at].view(np.int64)), pa.array(role.astype(np.int32))], ["g", "p", "role"])

    def search(t: pa.Table) -> pa.Table:
        found, role = t.column("p").to_numpy().view(np.uint64), t.column("role").to_numpy()
        u, v = forest(found[role > 0], found[role != 1], distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    routed = points.select(column).mapInArrow(route, "g bigint, p bigint, role int")
    return routed.groupBy("g").applyInArrow(search, "u bigint, v bigint")


def labelled(docs: DataFrame, *, doc_id: str, text: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, body hash) of every row, and (fp, component_id, keeper: the fp and body that stay) of every fingerprint."""
    spare = free_name(docs.columns, "body_hash")
    printed, fp = with_fingerprints(docs.withColumn(spare, F.xxhash64(F.col(f"`{text}`"))), text=text, carry=[doc_id, spare])
    printed = durable(printed.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(fp).alias("fp"), F.col(spare).alias("body")))
    classes = printed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "body")).alias("least"))
    label = components(links(classes, "fp", distance))
    known = classes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = known.groupBy("label").agg(F.min("least").alias("keeper"))
    return printed, known.join(named, "label").select("fp", F.col("keeper")["doc_id"].alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, fp bigint, component_id) of every row."""
    printed, of = labelled(docs, doc_id=doc_id, text=text, distance=distance)
    return printed.join(of.drop("keeper"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`docs` with one document of each component: that with the smallest doc_id; of rows that share it, the one of least
    fingerprint, then of least text hash, then (where even texts are equal) of the least other columns, written as JSON.

    Only the keys of rows that go, or that stand there more than once, are joined to the documents: broadcast up to
    `broadcast_rows` of them (a row has two numbers and a flag), by a shuffle beyond."""
    printed, of = labelled(docs, doc_id=doc_id, text=text, distance=distance)
    rows = printed.groupBy("doc_id", "fp", "body").agg(F.count(F.lit(1)).alias("times")).join(of, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper")["doc_id"]) & (F.col("fp") == F.col("keeper")["fp"]) & (F.col("body") == F.col("keeper")["body"])
    names = {k: free_name(docs.columns, k) for k in ("marked_id", "marked_body", "mark")}
    marks = durable(rows.where(~stays | (F.col("times") > 1)).select(F.col("doc_id").alias(names["marked_id"]), F.col("body").alias(names["marked_body"]), F.when(stays, "twice").otherwise("gone").alias(names["mark"])))
    n = marks.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col(names["mark"]) == "twice").alias("twice")).first()
    if n["all"] <= broadcast_rows:
        marks = F.broadcast(marks)
    found = docs.join(marks, F.col(f"`{doc_id}`").eqNullSafe(F.col(names["marked_id"])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names["marked_body"])), "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = found.where(F.col(names["mark"]).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    if not n["twice"]:
        return once
    several = found.where(F.col(names["mark"]) == "twice").groupBy(names["marked_id"], names["marked_body"]).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(several.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
