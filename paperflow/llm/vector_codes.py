"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, all in integers.

A component x counts as floor(scale * x). Vectors are cut into equal consecutive parts; the codebook of a part position
starts as that part of the vectors with the smallest ids and is improved by `rounds` of assigning every part to its
nearest entry and moving each used entry to the floor of its parts' mean. The nearest entry is found as `screening` says:
a float32 matrix product with rigorous error intervals, int64 for entries whose intervals overlap the best, ties to the
lower index.

A round reads the vectors once. Its tasks add up what they assign; the driver gets as many numbers as the codebooks
have. Nothing else is gathered: the error of a label is a grouped sum, joined back by `join_totals`.

Defined cases: a vector that is null, has not `dims` components, or has a component that is null, not finite or of
`LARGEST` / scale or more (whose errors no long could hold) is left out; rows without id are coded, but start no
entry; of rows with the same id the one with the smaller vector comes first; fewer vectors than entries give fewer
entries; null labels count as one label; an empty table gives an empty result; sums beyond a long are null; input
columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import durable, free_name, join_totals
from paperflow.llm.screening import distances, integers, moved, nearest, totals, whole


@dataclass(frozen=True)
class Codebooks:
    """Entries by (part, entry, component), and how components become integers."""

    entries: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components as decimal integers, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The entry index of each part of each row."""
        parts, _, width = self.entries.shape
        return np.stack([nearest(rows[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)], axis=1)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes stand for."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(codes.shape[1])], axis=1)


def fit(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks after `rounds` over all vectors; None if no vector with an id is kept."""
    if dims % parts or scale & (scale - 1):
        raise ValueError("parts must divide the components, and the scale be a power of two")
    first = whole(rows, vector, dims, scale).where(F.col(vec_id).isNotNull()).select(vec_id, vector).orderBy(vec_id, vector).limit(entries).collect()
    if not first:
        return None
    start = integers(pa.array([r[1] for r in first], pa.list_(pa.float64())), dims, scale)
    width, n = dims // parts, len(first)
    books = Codebooks(start.reshape(n, parts, width).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):

        def assign(block: np.ndarray, books: Codebooks = books) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            codes = books.codes(block)
            for p in range(parts):
                yield p * n + codes[:, p], block[:, p * width : (p + 1) * width]

        sums, counts = totals(rows, vector, dims, scale, assign, (parts * n, width))
        books = Codebooks(moved(books.entries.reshape(parts * n, width), sums, counts).reshape(parts, n, width), scale)
    return books


def encode(rows: DataFrame, books: Codebooks, *, vector: str = "embedding", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns `carry` (all if None) of every kept row with a column of (code: one byte or more a part, error), and that column's name."""
    carry = rows.columns if carry is None else carry
    into, body = free_name([*carry, *rows.columns], "encoded"), free_name([*carry, *rows.columns], "encoded_vector")
    size = 1 if books.entries.shape[1] <= 256 else 4

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = integers(batch.column(batch.num_columns - 1), books.dims, books.scale)
            codes = books.codes(block)
            raw = codes.astype(f">u{size}").tobytes()
            step = codes.shape[1] * size
            code = pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.binary())
            both = pa.StructArray.from_arrays([code, pa.array(distances(block, books.vectors(codes)))], names=["code", "error"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names=[*batch.schema.names[:-1], into])

    schema = T.StructType([*rows.select(*carry).schema.fields, T.StructField(into, T.StructType([T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))])
    return whole(rows, vector, books.dims, books.scale).select(*carry, F.col(vector).alias(body)).mapInArrow(coded, schema), into


def compress(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **settings) -> DataFrame:
    """(vec_id, code in hexadecimal, error, label_error, codebooks_sha256) of every kept row, with codebooks fitted on all of them."""
    books = fit(rows, vec_id=vec_id, vector=vector, **settings)
    if books is None:
        nothing = np.zeros((settings.get("parts", 8), 1, settings.get("dims", 64) // settings.get("parts", 8)), dtype=np.int64)
        books = Codebooks(nothing, settings.get("scale", 4096))
    plain = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    found, into = encode(plain, books, vector="vector", carry=["vec_id", "label"])
    coded = durable(found.select("vec_id", "label", F.lower(F.hex(F.col(into)["code"])).alias("code"), F.col(into)["error"].alias("error")))
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    return join_totals(coded, by_label, "label").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
