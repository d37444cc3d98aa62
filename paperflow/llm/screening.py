"""Exact nearest neighbours among a few integer entries: a float32 matrix product screens, int64 decides.

The squared distance of row a and entry b is |a|² - 2 a·b + |b|²; |a|² is the same for all entries, so s = |b|² - 2 a·b
orders them. The products of a whole block come from one float32 matrix product. Whatever the order in which it adds
its n terms, and with both factors rounded to float32 first, a product is off by at most g |a| |b|, where
g = k u / (1 - k u), k = n + 2 and u = 2^-24 (the usual bound on inner products, with the sum of |a_i b_i| bounded by the
norms). With what float64 loses afterwards that gives an interval for each s, which holds the true value. Entries whose
interval lies above the upper end of another's cannot be nearest; where more than one is left, all that are left are
compared in int64, ties going to the lower index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components below this size keep every squared distance of up to 64 components, and what the screen sums, within int64.
LARGEST = 1 << 27
#: Rows that are screened at once.
BLOCK = 1024


def intervals(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of |b|² - 2 a·b for each row a and entry b, both int64."""
    product = (rows.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    norms = lambda x: np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)) * (1 + 1e-12)
    k, u = rows.shape[1] + 2, 2.0**-24
    scale, own = np.outer(norms(rows), norms(entries)), np.square(entries).sum(axis=1).astype(np.float64)
    centre = own - 2 * product
    reach = 2 * (k * u / (1 - k * u)) * (1 + 1e-6) * scale + 2.0**-50 * (own + 3 * scale)
    return centre - reach, centre + reach


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, pair by pair, in int64."""
    return np.square(rows - entries).sum(axis=1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of each row's nearest entry, the lowest of equally near ones."""
    out = np.zeros(len(rows), dtype=np.int64)
    for a in range(0, len(rows), BLOCK):
        block = rows[a : a + BLOCK]
        low, high = intervals(block, entries)
        left = low <= high.min(axis=1, keepdims=True)
        at = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            row, entry = np.nonzero(left[open_rows])
            d = distances(block[open_rows[row]], entries[entry])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.flatnonzero(d == np.minimum.reduceat(d, first)[row])  # in order of row, then entry
            at[open_rows] = entry[best[np.flatnonzero(np.diff(row[best], prepend=-1))]]
        out[a : a + BLOCK] = at
    return out


def whole(rows: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """The rows whose vector has `dims` components, none null or not finite or, times `scale`, of `LARGEST` or more."""
    most = LARGEST / scale
    fine: Column = F.forall(F.col(vector), lambda x: F.coalesce((x.cast("double") < most) & (x.cast("double") > -most), F.lit(False)))
    return rows.where((F.size(F.col(vector)) == dims) & fine)


def integers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component x as a matrix; `scale` is a power of two, so that the product is exact."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64).reshape(-1, dims)


def totals(rows: DataFrame, vector: str, dims: int, scale: int, assign, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) by group: `assign` gives the group numbers of a block's rows and the vectors to add up there, `shape` is (groups, components).

    Every task adds up its own rows; only numbers by group and component are shuffled, and that many come to the driver."""
    groups, width = shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((groups, width), dtype=np.int64), np.zeros(groups, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, vectors in assign(integers(batch.column(0), dims, scale)):
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                sums[at[order[first]]] += np.add.reduceat(vectors[order], first)
                counts += np.bincount(at, minlength=groups)
        flat = np.concatenate([counts, sums.ravel()])
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], names=["slot", "total"])

    found = whole(rows, vector, dims, scale).select(vector).mapInArrow(added, "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(groups * (width + 1), dtype=np.int64)
    for r in found:
        flat[r["slot"]] = r["total"]
    return flat[groups:].reshape(groups, width), flat[:groups]


def moved(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry that has rows at the floor of their mean; the others where they were."""
    used = counts > 0
    out = entries.copy()
    out[used] = sums[used] // counts[used, None]  # numpy's integer division rounds down
    return out
