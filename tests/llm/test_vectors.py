"""Vector codes and centroids against plain versions in Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperflow.llm import centroids, screening, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, salt string, of_label int, code string"


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(row, entries):
    return min(range(len(entries)), key=lambda k: (d2(row, entries[k]), k))


def kept(rows, scale, dims):
    out = []
    for r in rows:
        v = r[1]
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            v32 = [float(np.float32(x)) for x in v]
            if all(-screening.LARGEST / scale < x < screening.LARGEST / scale for x in v32):
                out.append((r[0], tuple(math.floor(scale * x) for x in v32), r[2], v32))
    return out


def means(entries, groups):
    return [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if groups[k] else e for k, e in enumerate(entries)]


def plain_codes(rows, dims, parts, entries, rounds, scale):
    rows, width = kept(rows, scale, dims), dims // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[3]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in rows:
                groups[closest(cut(r[1])[p], books[p])].append(cut(r[1])[p])
            books[p] = means(books[p], groups)
    out, by_label = [], defaultdict(int)
    for r in rows:
        code = [closest(x, books[p]) for p, x in enumerate(cut(r[1]))]
        error = sum(d2(x, books[p][c]) for p, (x, c) in enumerate(zip(cut(r[1]), code, strict=True)))
        by_label[r[2]] += error
        out.append((r[0], "".join(f"{c:02x}" for c in code), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def plain_clusters(rows, dims, clusters, rounds, scale):
    rows = kept(rows, scale, dims)
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[3]))[:clusters]
    centres = [r[1] for r in first]
    for _ in range(rounds):
        groups = defaultdict(list)
        for r in rows:
            groups[closest(r[1], centres)].append(r[1])
        centres = means(centres, groups)
    at = [closest(r[1], centres) for r in rows]
    d = [d2(r[1], centres[k]) for r, k in zip(rows, at, strict=True)]
    inertia = defaultdict(int)
    for k, x in zip(at, d, strict=True):
        inertia[k] += x
    sha = lambda k: hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()
    return sorted(((r[0], k, x, inertia[k], sum(d), sha(k)) for r, k, x in zip(rows, at, d, strict=True)), key=str)


def odd_vectors(n=160, dims=8, seed=3):
    """Nulls, missing and infinite components, other lengths, copies, repeated ids, rows without id or label, values at and beyond the largest, and many ties."""
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.3, rng.gauss(0, 0.2)]) for _ in range(dims)], rng.choice([1, 2, None]), "s", 0, "x") for k in range(n)]
    bad = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] + [0.1] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e30] * dims, [-32768.0] * dims]
    rows += [(1000 + k, v, 1, "s", 0, "x") for k, v in enumerate(bad)]
    rows += [(None, rows[5][1], None, None, None, None), (7, rows[9][1], 1, "s", 0, "x"), rows[11], rows[11], (2000, [30000.0] * dims, 2, "s", 0, "x"), (2001, [0.0] * dims, 2, "s", 0, "x")]
    return rows


@pytest.mark.parametrize("spread,n,k", [(3, 3000, 40), (1 << 10, 2000, 16), (1 << 26, 1500, 16)])
def test_nearest_is_exact_where_float32_is_not(spread, n, k):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, size=(k, 16)).astype(np.int64)
    entries[k // 2 :] = entries[: k - k // 2] + rng.integers(-1, 2, size=(k - k // 2, 16))  # neighbours one apart
    entries[3] = entries[0]
    rows = entries[rng.integers(0, k, n)] + rng.integers(-2, 3, size=(n, 16))
    exact = np.stack([np.square(rows - e).sum(axis=1) for e in entries], axis=1)
    assert (screening.nearest(rows, entries) == exact.argmin(axis=1)).all()
    low, high = screening.intervals(rows, entries)
    true = exact - np.square(rows).sum(axis=1)[:, None]
    assert all(float(a) <= int(t) <= float(b) for a, t, b in zip(low[:50].ravel(), true[:50].ravel(), high[:50].ravel(), strict=True))
    if spread > 1 << 20:
        single = np.square(entries.astype(np.float32)).sum(axis=1) - 2 * (rows.astype(np.float32) @ entries.astype(np.float32).T)
        assert (single.argmin(axis=1) != exact.argmin(axis=1)).any()


def test_screen_leaves_little_to_int64():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 0.13, size=(2000, 64)) * 256).astype(np.int64)
    low, high = screening.intervals(rows, rows[:40])
    assert (low <= high.min(axis=1, keepdims=True)).sum() < 1.01 * len(rows)


def test_codes_against_plain_version(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    settings = dict(dims=8, parts=4, entries=6, rounds=4, scale=4096)
    got = sorted((tuple(r) for r in vector_codes.compress(df, **settings).collect()), key=str)
    assert got == plain_codes(rows, **settings)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert sorted((tuple(r) for r in vector_codes.compress(few, **settings).collect()), key=str) == plain_codes(rows[:3], **settings)


def test_codes_stand_for_their_vectors(spark):
    rows = odd_vectors(60)
    df = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.fit(df, dims=8, parts=2, entries=300, rounds=2)
    found, into = vector_codes.encode(df, books)
    assert found.columns == [*df.columns, into]
    for r in found.collect():
        codes = np.frombuffer(r[into]["code"], dtype=">u1" if books.entries.shape[1] <= 256 else ">u4").astype(np.int64)[None]
        vector = np.floor(np.array(r["embedding"], dtype=np.float64) * 4096).astype(np.int64)[None]
        assert screening.distances(vector, books.vectors(codes))[0] == r[into]["error"]


def test_clusters_against_plain_version(spark):
    rows = odd_vectors(seed=5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    settings = dict(dims=8, clusters=7, rounds=3, scale=256)
    got = sorted((tuple(r) for r in centroids.cluster(df, **settings).collect()), key=str)
    assert got == plain_clusters(rows, **settings)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1, "", 1, "")], SCHEMA)
    for table in (df, df.where("false"), spark.createDataFrame([(None, [0.5] * 64, None, "", 1, "")], SCHEMA)):
        n = table.where(F.col("embedding").isNotNull()).count()
        assert vector_codes.compress(table).count() == centroids.cluster(table).count() == n
    with pytest.raises(ValueError):
        vector_codes.fit(df, parts=7)
