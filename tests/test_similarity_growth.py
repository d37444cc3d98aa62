"""The similarity join against all pairs, and how many rows its join makes on titles of few words."""

import random

import pytest
from pyspark.sql import functions as F

from paperflow.functions.identity import trigrams
from paperflow.operators import collapse, similarity

WORDS = "the and ation her inge con est ter ver lich keit heit der und ein aux les ent oue tion cion mente".split()


def titles(n, seed, copies=0.1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(WORDS) for _ in range(rng.randint(2, 60))) for _ in range(n)]
    for k in range(int(n * copies)):
        t = list(out[k])
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz9")
        out.append("".join(t))
    return sorted({*out, "", "ab", "abc", "the" * 300, "the" * 301, "the" * 302 + "x"})


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def grams(k):
    return {k[i : i + 3] for i in range(len(k) - 2)}


@pytest.mark.parametrize("tenths", [6, 9, 10])
def test_all_pairs(spark, tenths):
    keys = titles(150, tenths)
    g = {k: grams(k) for k in keys}
    want = {(a, b) for a in keys for b in keys if a < b and g[a] and g[b] and len(g[a] & g[b]) * 10 >= tenths * len(g[a] | g[b])}
    got = [tuple(r) for r in similarity.similar_keys(frame(spark, keys), tenths=tenths).collect()]
    assert len(want) > 0 and len(got) == len(set(got)) and set(got) == want


def test_few_rows_are_joined(spark):
    sets = frame(spark, titles(3000, 5)).select("key", trigrams(F.col("key")).alias("g")).where(F.size("g") > 0).select(F.monotonically_increasing_id().alias("id"), F.size("g").alias("n"), "g").localCheckpoint()
    order = similarity.by_rarity(sets.select(F.explode("g").alias("gram"))).localCheckpoint()
    found = similarity.signatures(sets, order, 9).localCheckpoint()
    made = similarity.sided(found, "a", "sig").join(similarity.sided(found, "b", "sig"), "sig").where((F.col("a") < F.col("b")) & similarity.fits(9))
    assert made.select("a", "b").distinct().count() < 2 * sets.count()


def test_collapse_of_long_titles(spark):
    rows = [(1, 5, "the" * 300), (2, 1, "the" * 301), (3, 0, None), (4, 0, ""), (5, 2, "hedgesalongcyclepathsandfinedust"), (6, 1, "hedgesalongcyclepathsandfinedusts"), (7, 9, "ab"), (8, 3, "ab")]
    out = collapse.collapse(spark.createDataFrame(rows, "id int, rank int, key string"), "id", "rank")
    assert {r.id: r.kept for r in out.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True}
