"""Shared parts: word spans and word hashes over Arrow text buffers; tables, free names and durable cuts come from the library."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperflow.tables import durable, free_name, spread, table

__all__ = ["ALNUM_LOWER", "BLANK", "BLANK_LOWER", "Hasher", "blocks", "buffers", "durable", "free_name", "join_totals", "mix", "spread", "table", "word_spans"]

#: Rows of a table of totals that are broadcast at most, and the keys over which a row of a larger one is repeated.
TOTALS, SALTS = 100_000, 16

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def separators(*ranges: tuple[int, int], lower: bool) -> np.ndarray:
    """A table from a byte to the byte that it counts as: 0x20 for separators (the ranges, ends inclusive), A-Z lower-cased if asked."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[ord("A") : ord("Z") + 1] += 32
    for first, last in ranges:
        out[first : last + 1] = 0x20
    return out


#: Words are runs of anything but space and 0x09-0x0D.
BLANK = separators((0x09, 0x0D), lower=False)
BLANK_LOWER = separators((0x09, 0x0D), lower=True)
#: Words are runs of digits, letters and all that is not ASCII; A-Z count as a-z.
ALNUM_LOWER = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), lower=True)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as they count, start and end of each word, first word of each row and one past the last). `offsets` begin at 0."""
    counted = classes[raw]
    inside = np.zeros(len(counted) + 2, dtype=bool)
    inside[1:-1] = counted != 0x20
    cut = np.unique(offsets)
    begins = inside[1:-1] & ~inside[:-2]
    at = cut[cut < len(counted)]
    begins[at] = inside[1:-1][at]
    ends = inside[1:-1] & ~inside[2:]
    at = cut[cut > 0] - 1
    ends[at] = inside[1:-1][at]
    starts = np.flatnonzero(begins)
    return counted, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class Hasher:
    """Hashes of words and of runs of words in lanes of 64 bits, each a row of the result.

    A word's hash is the sum of its bytes times keys that depend on the byte's place in the word; runs join two by two
    with further keys. Lanes have keys of their own, all drawn from `seed`: for any two different words or runs, chosen
    before the seed, a lane collides with a probability of about 2^-56. The same words hash alike wherever they stand."""

    seed: int = 0
    lanes: int = 1

    def _keys(self, lane: int, at: np.ndarray) -> np.ndarray:
        return mix(mix(at.astype(np.uint64) * GOLDEN + np.uint64((self.seed + lane * 0x632BE59BD9B4E019) % (1 << 64))) + GOLDEN)

    def words(self, counted: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((self.lanes, 0), dtype=np.uint64)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        total, narrow = int(lengths.sum()), np.int32 if len(counted) < 1 << 31 else np.int64
        at = np.arange(total, dtype=narrow)
        place = at - np.repeat(first.astype(narrow), lengths)
        at += np.repeat((starts - first).astype(narrow), lengths)
        byte, places, tail = counted[at] + np.uint64(1), np.arange(int(lengths.max())), mix(lengths.astype(np.uint64))
        return np.stack([mix(np.add.reduceat(self._keys(k, places)[place] * byte, first) + tail) for k in range(self.lanes)])

    def runs(self, words: np.ndarray, n: int) -> np.ndarray:
        """Of each run of n words, one for each start that leaves n words. Runs of 1, 2, 4 ... words join to n, the last two overlapping."""
        if words.shape[1] < n:
            return np.zeros((self.lanes, 0), dtype=np.uint64)
        size = 1
        while size < n:
            by = min(size, n - size)
            left, right = (self._keys(k, np.array([1 << 40, 2 << 40]) + size) | np.uint64(1) for k in range(self.lanes)), words[:, by:]
            words = np.stack([mix(a * key[0] + b * key[1]) for a, b, key in zip(words[:, : words.shape[1] - by], right, left, strict=True)])
            size += by
        return words


def join_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """`rows` with what `totals` has for them: its first column, one row each, equals `key` (nulls equal nulls), the others follow.

    A table of totals is broadcast if a count says that it is small; a larger one is repeated for each of `SALTS` parts of the rows, so that rows of a frequent key lie in as many tasks."""
    match = totals.columns[0]
    if totals.limit(TOTALS + 1).count() <= TOTALS:
        return rows.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col(match)), "left").drop(match)
    salt, other = free_name([*rows.columns, *totals.columns], "salt"), free_name([*rows.columns, *totals.columns], "other_salt")
    spread_out = totals.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SALTS)).cast("int"))
    return dealt.join(spread_out, F.col(key).eqNullSafe(F.col(match)) & (F.col(salt) == F.col(other)), "left").drop(match, salt, other)
