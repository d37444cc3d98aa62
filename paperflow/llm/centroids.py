"""Centroid clustering in integers: every vector at its nearest centroid, centroids at the floor of their vectors' mean.

A component x counts as floor(scale * x). The first centroids are the kept vectors with the smallest SHA-256 of
"<seed>:<id>", in that order. Each round assigns every vector to the nearest centroid as `screening` says (a float32
matrix product with rigorous error intervals makes a short list, exact integers choose from it, ties to the lowest
number) and moves the centroids that have vectors; then vectors are assigned once more.

A round reads the vectors once; its tasks add up what they assign, and the driver gets as many numbers as the centroids
have. Sums over clusters are grouped sums of one row a cluster.

Defined cases: a vector that is null, has not `dims` components, or has a component that is null, not finite or of
`LARGEST` / scale or more is left out; rows without id are assigned, but start no centroid; rows with the same id all
count, the smaller vector first; fewer vectors than centroids give fewer centroids; an empty table gives an empty
result; sums beyond a long are null; input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import durable, free_name
from paperflow.llm.screening import distances, integers, moved, nearest, totals, whole


def fit(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> np.ndarray | None:
    """Centroids by (number, component) after `rounds` over all vectors; None if no vector with an id is kept."""
    if scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    drawn = free_name(rows.columns, "drawn")
    first = whole(rows, vector, dims, scale).where(F.col(vec_id).isNotNull()).select(rank.alias(drawn), vector).orderBy(drawn, vector).limit(clusters).collect()
    if not first:
        return None
    centroids = integers(pa.array([r[1] for r in first], pa.list_(pa.float64())), dims, scale)
    for _ in range(rounds):

        def assign(block: np.ndarray, centroids: np.ndarray = centroids) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield nearest(block, centroids), block

        centroids = moved(centroids, *totals(rows, vector, dims, scale, assign, centroids.shape))
    return centroids


def assign_all(rows: DataFrame, centroids: np.ndarray, *, vector: str = "embedding", scale: int = 256, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns `carry` (all if None) of every kept row with a column of (cluster, distance), and that column's name."""
    carry = rows.columns if carry is None else carry
    into, body, dims = free_name([*carry, *rows.columns], "assigned"), free_name([*carry, *rows.columns], "assigned_vector"), centroids.shape[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = integers(batch.column(batch.num_columns - 1), dims, scale)
            at = nearest(block, centroids)
            both = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(distances(block, centroids[at]))], names=["cluster", "distance"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names=[*batch.schema.names[:-1], into])

    schema = T.StructType([*rows.select(*carry).schema.fields, T.StructField(into, T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))])
    return whole(rows, vector, dims, scale).select(*carry, F.col(vector).alias(body)).mapInArrow(found, schema), into


def cluster(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row, with centroids fitted on all of them."""
    centroids = fit(rows, vec_id=vec_id, vector=vector, **settings)
    if centroids is None:
        centroids = np.zeros((1, settings.get("dims", 64)), dtype=np.int64)
    found, into = assign_all(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), centroids, vector="vector", scale=settings.get("scale", 256), carry=["vec_id"])
    placed = durable(found.select("vec_id", F.col(into)["cluster"].alias("cluster"), F.col(into)["distance"].alias("distance")))
    by_cluster = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}  # one number a centroid
    every = None if None in by_cluster.values() or sum(by_cluster.values()) >= 1 << 63 else sum(by_cluster.values())
    known = [(k, by_cluster.get(k), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(known, "of_cluster int, cluster_inertia long, centroid_sha256 string")
    joined = placed.join(F.broadcast(table), F.col("cluster") == F.col("of_cluster"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")
