"""Removal of passages that a document with a smaller id has, by level-wise doubling of repeated windows.

Each level has windows twice as long as the one before it: by default 25 and then 50 words (`levels`). A window
chooses, of the windows of the level below that it covers, the one of least hash; that choice depends on its words
alone, so equal windows choose equal ones, and only windows whose choice is repeated in another document are
candidates. A shard of which no candidate survives is not looked at again. Doubling ends at `window` words: a longer
repeat is covered by its windows of that length, so further levels would remove no other word.

Documents are dealt by id and text into shards of about `shard_bytes` of text, and hashes into buckets. A shard first
combines what it has itself - one entry a hash with the smallest id, however many documents share it - so a window
that a third of all documents has makes as many entries as there are shards. Buckets answer to shards. The text is
shuffled once, by an exchange that all passes share, with one partition a shard.

What decides on a removal is a hash of two lanes of 64 bits, with keys drawn anew for each run (`Hasher`): two windows
that differ agree with a probability below 2^-100, whatever the texts, and lower levels only pick candidates.

Defined cases: a null text has no words; texts of fewer than `window` words lose nothing; a row without id is no
source and loses nothing; rows that repeat an id are not smaller than each other; a word goes once however many
windows cover it, and windows are judged on the input; an empty table gives none. Ids are whole numbers. Input
columns may have any names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import BLANK, Hasher, blocks, buffers, free_name, word_spans

CHUNK_BYTES = 4 << 20
NOWHERE = np.iinfo(np.int64).max


class Words:
    """The words of a shard's rows, chunk by chunk: their hashes (a row for each lane) and where rows begin."""

    def __init__(self, texts: pa.Array, hasher: Hasher):
        self.raw, self.offsets = buffers(texts)
        self.hasher = hasher

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, bytes, offsets, hashes, first word of each row)"""
        for a, b in blocks(self.offsets, CHUNK_BYTES):
            at = self.offsets[a : b + 1] - self.offsets[a]
            counted, starts, ends, first = word_spans(self.raw[self.offsets[a] : self.offsets[b]], at, BLANK)
            yield a, b, counted, at, self.hasher.words(counted, starts, ends), first


def whole(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows of n words that lie in one row, their rows)."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()), row


def least_halves(halves: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the leftmost place of the least of `reach` consecutive hashes there."""
    best, span = np.arange(len(halves)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(halves[b] < halves[a], b, a)

    while span * 2 <= reach:
        best = better(best[: len(best) - span], best[span:])
        span *= 2
    return better(best[starts], best[starts + reach - span])


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by key, where each key begins in it)."""
    order = np.lexsort(keys.T[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new)


def deal(bucket: np.ndarray, n_buckets: int, shard: int, *columns: np.ndarray) -> pa.Table:
    """One row for each bucket: the shard and the columns' bytes of that bucket's entries."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    have = np.flatnonzero(np.diff(cuts))
    blobs = [[np.ascontiguousarray(c[order[cuts[b] : cuts[b + 1]]]).tobytes() for b in have] for c in columns]
    return pa.table({"bucket": pa.array(have, pa.int64()), "shard": pa.array([shard] * len(have), pa.int64())} | {f"c{k}": pa.array(x, pa.binary()) for k, x in enumerate(blobs)})


def gathered(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(all entries of the blobs, how many each blob had)."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], dtype=np.int64)


def found_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


class Passes:
    """The steps between exchanges; lengths: the windows of each level, rising; n: how many buckets there are."""

    def __init__(self, lengths: list[int], n: int, seed: int):
        self.lengths, self.window, self.n = lengths, lengths[-1], n
        self.screen, self.exact = Hasher(seed), Hasher(seed, 2)

    def ids(self, t: pa.Table) -> np.ndarray:
        return t.column("id").combine_chunks().fill_null(NOWHERE).to_numpy(zero_copy_only=False)

    def choices(self, words: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of windows of the level, their rows, hash of the window one level below that each chooses)."""
        n, below = self.lengths[level], self.lengths[level - 1]
        starts, row = whole(first, n)
        if not len(starts):
            return starts, row, np.zeros(0, np.uint64)
        hashes = self.screen.runs(words[:1], below)[0]
        return starts, row, hashes[least_halves(hashes, starts, n - below + 1)]

    @staticmethod
    def fresh(chosen: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether a window chooses another half than the one before it in its row."""
        new = np.ones(len(chosen), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
        return new

    def candidates(self, key: tuple, t: pa.Table, told: pa.Table | None, level: int) -> pa.Table:
        """What a shard's windows of a level choose below it, as far as their own parts are repeated, and whether two of its documents have it."""
        ids, keys, owners = self.ids(t), [], []
        good = None if told is None else np.sort(gathered(told.column("c0"), np.uint64)[0])
        for a, _, _, _, words, first in Words(t.column("text"), self.screen).chunks() if t.num_rows and (good is None or len(good)) else ():
            _, row, chosen = self.choices(words, first, level)
            new = self.fresh(chosen, row) & (ids[a + row] != NOWHERE)
            if good is not None:
                starts, _, parts = self.choices(words, first, level - 1)
                alive = np.zeros(words.shape[1], dtype=bool)
                alive[starts[found_in(parts, good)]] = True
                below = self.screen.runs(words[:1], self.lengths[level - 1])[0]
                at = least_halves(below, whole(first, self.lengths[level])[0], self.lengths[level] - self.lengths[level - 1] + 1)
                new &= alive[at]
            keys.append(chosen[new])
            owners.append(ids[a + row[new]])
        keys, owners = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, owners = keys[order], owners[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at) if len(at) else np.zeros(0, bool)
        return deal((keys[at] % np.uint64(self.n)).astype(np.int64), self.n, key[0].as_py(), keys[at], several)

    def repeated(self, t: pa.Table) -> pa.Table:
        keys, counts = gathered(t.column("c0"), np.uint64)
        several, _ = gathered(t.column("c1"), bool)
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        more = (np.diff(np.append(at, len(keys))) > 1) | np.logical_or.reduceat(several[order], at)
        good = np.zeros(len(keys), dtype=bool)
        good[order] = np.repeat(more, np.diff(np.append(at, len(keys))))
        return self.answer(t, counts, good, keys)

    def answer(self, t: pa.Table, counts: np.ndarray, good: np.ndarray, keys: np.ndarray) -> pa.Table:
        cuts = np.concatenate([[0], np.cumsum(counts)])
        blobs = [np.ascontiguousarray(keys[a:b][good[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        have = [k for k, x in enumerate(blobs) if x]
        return pa.table({"shard": t.column("shard").take(pa.array(have, pa.int64())), "c0": pa.array([blobs[k] for k in have], pa.binary())})

    def survivors(self, key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        """A shard's windows of full length whose choice is repeated, each once with its smallest id."""
        good, ids = np.sort(gathered(told.column("c0"), np.uint64)[0]), self.ids(t)
        keys, owners = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for a, _, _, _, words, first in Words(t.column("text"), self.exact).chunks() if t.num_rows and len(good) else ():
            starts, row, chosen = self.choices(words, first, len(self.lengths) - 1)
            stay = found_in(chosen, good) & (ids[a + row] != NOWHERE)
            if stay.any():
                keys.append(self.exact.runs(words, self.window).T[starts[stay]])
                owners.append(ids[a + row[stay]])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order, at = groups(keys)
        least = np.minimum.reduceat(owners[order], at) if len(at) else owners
        keys = keys[order[at]]
        return deal((keys[:, 0] % np.uint64(self.n)).astype(np.int64), self.n, key[0].as_py(), keys, least)

    def smaller_elsewhere(self, t: pa.Table) -> pa.Table:
        keys, counts = gathered(t.column("c0"), np.uint64)
        keys, counts = keys.reshape(-1, 2), counts // 2
        least, _ = gathered(t.column("c1"), np.int64)
        order, at = groups(keys)
        all_least = np.empty(len(keys), dtype=np.int64)
        all_least[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(keys))))
        return self.answer(t, counts, least > all_least, keys)

    def removed(self, t: pa.Table, told: pa.Table) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """(row, which of its words go, its bytes) for each row of a shard."""
        ids = self.ids(t)
        seen = gathered(told.column("c0"), np.uint64)[0].reshape(-1, 2) if told.num_rows else np.zeros((0, 2), np.uint64)
        parts = list(Words(t.column("text"), self.exact).chunks())
        # a shard's own windows that two of its documents choose alike, or that a bucket has told of
        chosen = [self.choices(words, first, len(self.lengths) - 1) for _, _, _, _, words, first in parts]
        ordered = np.sort(np.concatenate([*(c[self.fresh(c, row)] for _, row, c in chosen), np.zeros(0, np.uint64)]))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        stay = [found_in(c[2], twice) for c in chosen]
        told_of = np.sort(seen[:, 0])
        keys, owner = [], []
        for (a, _, _, _, words, _), (starts, row, _), ok in zip(parts, chosen, stay, strict=True):
            if len(starts) and (len(told_of) or ok.any()):
                hashes = self.exact.runs(words, self.window)
                if len(told_of):
                    ok |= found_in(hashes[0][starts], told_of)
                ok &= ids[a + row] != NOWHERE
                keys.append(hashes.T[starts[ok]])
            owner.append(ids[a + row[ok]])
        keys, owner = np.concatenate([*keys, np.zeros((0, 2), np.uint64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        everything, who = np.concatenate([keys, seen]), np.concatenate([owner, np.full(len(seen), np.iinfo(np.int64).min)])
        order, at = groups(everything)
        least = np.empty(len(everything), dtype=np.int64)
        if len(at):
            least[order] = np.repeat(np.minimum.reduceat(who[order], at), np.diff(np.append(at, len(everything))))
        gone, used = least[: len(keys)] < owner, 0
        for (a, b, counted, at_, words, first), (starts, _, _), ok in zip(parts, chosen, stay, strict=True):
            mark = np.zeros(words.shape[1] + 1, dtype=np.int64)
            hit = starts[ok][gone[used : used + ok.sum()]]
            used += int(ok.sum())
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + self.window, -1)
            out = np.cumsum(mark[:-1]) > 0
            for r in range(b - a):
                yield a + r, out[first[r] : first[r + 1]], counted[at_[r] : at_[r + 1]].tobytes()


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, levels: int = 2, shard_bytes: int = 12 << 20, carry: list[str] | None = None, hashed: bool = False, seed: int | None = None) -> tuple[DataFrame, str]:
    """The columns `carry` (all, if not given) with a struct of n_words, n_removed and kept (the words left, joined by spaces, or their SHA-256); also its name.

    The levels are `window` halved `levels` - 1 times (as long as that leaves two words) and back. `seed` draws the hashes' keys; a new one if not given."""
    carry = list(docs.columns) if carry is None else carry
    into = free_name(carry, "passages")
    lengths = [window]
    while len(lengths) < max(2, levels) and (lengths[0] >= 4 or len(lengths) < 2):
        lengths.insert(0, max(1, lengths[0] // 2))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    n = int(size // shard_bytes) + 1
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("long").alias("shard"), "id", "text", "row").repartition(n, "shard")
    p = Passes(lengths, n, secrets.randbits(63) if seed is None else seed)
    blobs = "bucket bigint, shard bigint, c0 binary, c1 binary"

    def at_level(level: int):
        return lambda key, t, good: p.candidates(key, t, good, level)

    found = rows.groupBy("shard").applyInArrow(lambda key, t: p.candidates(key, t, None, 1), blobs)
    told = found.groupBy("bucket").applyInArrow(lambda t: p.repeated(t), "shard bigint, c0 binary")
    for level in range(2, len(lengths)):
        found = rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(at_level(level), blobs)
        told = found.groupBy("bucket").applyInArrow(lambda t: p.repeated(t), "shard bigint, c0 binary")
    last = rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(lambda key, t, good: p.survivors(key, t, good), blobs)
    known = last.groupBy("bucket").applyInArrow(lambda t: p.smaller_elsewhere(t), "shard bigint, c0 binary")
    kind = rows.schema["row"].dataType
    result = T.StructType([*kind.fields, T.StructField(into, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))])

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        found = []
        for _, gone, line in p.removed(t, told):
            words = line.split()
            kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            found.append({"n_words": len(gone), "n_removed": int(gone.sum()), "kept": hashlib.sha256(kept).hexdigest() if hashed else kept.decode()})
        row = t.column("row").combine_chunks()
        column = pa.array(found, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))
        return pa.Table.from_arrays([*(row.field(k) for k in range(len(carry))), column], names=[*carry, into])

    return rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(finish, result), into
