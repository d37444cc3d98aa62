"""Exact set-similarity join on trigrams.

Two sets of at most R grams with a Jaccard similarity of t or more differ in d = 2R (1 - t) / (1 + t) grams at most. So, of d + 1
parts that all grams are dealt to, one holds the same grams of both. A set's hash of each of its parts, the empty ones too, is what it is
found by; a part has some eight grams, of common and rare ones alike, so that few unlike sets agree on one, however many sets there are.
Those that agree are told apart by sketches, the parities of 256 groups of grams: sets differ in as many grams as their sketches do, at least.
Sizes fall into classes, each reaching 1 / t times as far as its first size, so that similar sets are of one class or of neighbours: a set is
dealt for its own class's R and for the next one's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.functions.identity import every_trigram, trigrams
from paperflow.tables import durable, free_name, let, spread

#: Trigrams of 36 characters, and of what may fill a gap.
MOST_GRAMS = 37**3
#: No set is larger.
MOST = 10**9
#: Words of a sketch.
SKETCH = 4
SKETCHES = [f"s{j}" for j in range(SKETCH)]


def class_ends(tenths: int) -> list[int]:
    """The largest size of each class. Equal sets alone are similar at ten tenths, so there is one class then."""
    ends, first = [], 1
    while first <= MOST and tenths < 10:
        ends.append(first * 10 // tenths)
        first = ends[-1] + 1
    return [*ends, max(first, MOST), 2 * MOST]


def sketched(sets: DataFrame, grams: Column) -> DataFrame:
    """`sets` with s0 to s3: bits that each gram of one of 256 groups turns over. All four come from one reading of the grams."""
    word = lambda h, j: F.aggregate(F.filter(h, lambda x: x.bitwiseAND(F.lit(3)) == j), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))))
    words = let(F.transform(grams, lambda g: F.xxhash64(g)), lambda h: F.array(*[word(h, j) for j in range(SKETCH)]))
    drawn = sets.withColumn(bits := free_name(sets.columns, "bits"), words)
    return drawn.select(*sets.columns, *[F.get(bits, F.lit(j)).alias(c) for j, c in enumerate(SKETCHES)])


def sided(found: DataFrame, side: str, *columns: str) -> DataFrame:
    """`found` with its id, size and sketch named for one side of a pair."""
    return found.select(*columns, F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *SKETCHES)])


def fits(tenths: int) -> Column:
    """Whether two sets, sides a and b, can be similar by their sizes and sketches."""
    near = (F.col("n_a") * 10 >= F.col("n_b") * tenths) & (F.col("n_b") * 10 >= F.col("n_a") * tenths)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCHES])
    return near & (apart * (10 + tenths) <= (F.col("n_a") + F.col("n_b")) * (10 - tenths))


def by_rarity(grams: DataFrame) -> DataFrame:
    """(gram, df, place) of all `grams`; places follow the number of rows with a gram, and are fixed only once they are written down."""
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "gram").withColumn("place", F.monotonically_increasing_id())


def hinted(order: DataFrame) -> DataFrame:
    return F.broadcast(order) if order.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS else order


def signatures(sets: DataFrame, order: DataFrame, tenths: int) -> DataFrame:
    """(id, n, sketch, sig) of `sets` (id, n, g): the hash of each part's grams. Grams are dealt by their place in `order`, unknown ones by their hash."""
    ends = F.array(*[F.lit(e) for e in class_ends(tenths)])
    reaches = F.slice(ends, F.size(F.filter(ends, lambda e: e < F.col("n"))) + 1, F.lit(2))
    parts = F.floor(F.col("reach") * (2 * (10 - tenths)) / (10 + tenths)) + 1
    sized = sets.select("id", "n", reaches.alias("reaches"), "g")
    rows = sized.select("id", "reaches", F.explode("g").alias("gram")).join(order.select("gram", "place"), "gram", "left").select("id", F.coalesce("place", F.xxhash64("gram")).alias("place"), F.xxhash64("gram").alias("x"), F.explode("reaches").alias("reach"))
    held = rows.select("id", "reach", F.pmod("place", parts).alias("part"), "x", F.lit(None).cast("int").alias("n"), *[F.lit(None).cast("long").alias(c) for c in SKETCHES])
    # the empty parts too; these rows tell the size and the sketch
    drawn = sketched(sets.select("id", "n", "g", reaches.alias("reaches")), F.col("g")).select("id", "n", *SKETCHES, F.explode("reaches").alias("reach"))
    every = drawn.select("id", "reach", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).cast("long").alias("x"), "n", *SKETCHES)
    told = held.unionByName(every).groupBy("id", "reach", "part").agg(F.bit_xor("x").alias("x"), *[F.max(c).alias(c) for c in ("n", *SKETCHES)])
    return told.select("id", "n", *SKETCHES, F.xxhash64("reach", "part", "x").alias("sig"))


def sized(keys: DataFrame) -> DataFrame:
    """`keys`, written down and with a key k each, with the number n of its trigrams; those that have some.

    A table of keys is small and so comes in few partitions, but what is made of each key is not: they are dealt over all cores. n is written down, as it is asked for at each end of a class."""
    return durable(spread(keys).where(F.length("k") >= 3).withColumn("n", F.size(trigrams(F.col("k")))))


def numbered(keys: DataFrame, key: str, others: DataFrame | None) -> DataFrame:
    """(id, k, l, r, n) of the distinct keys that have trigrams, here (l) and there (r), written down."""
    left = keys.select(F.col(key).alias("k"), F.lit(True).alias("l"), F.lit(others is None).alias("r"))
    both_sides = left if others is None else left.union(others.select(F.col(key), F.lit(False), F.lit(True)))
    return sized(durable(both_sides.groupBy("k").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r")).withColumn("id", F.monotonically_increasing_id())))


def similar_sets(sets: DataFrame, tenths: int = 9, mirrored: bool = False) -> DataFrame:
    """Pairs (a, b, ka, kb) of ids and keys of `sets` (id, k, n) of similar keys, a < b. If `mirrored`, in any order, a of those with l and b of those with r."""
    grams = sets.select("id", "n", trigrams(F.col("k")).alias("g"))
    order = durable(by_rarity(grams.select(F.explode("g").alias("gram"))))
    found = signatures(grams, hinted(order), tenths)
    found = durable(found.join(sets.select("id", "l", "r"), "id") if mirrored else found.withColumns({"l": F.lit(True), "r": F.lit(True)}))
    either = F.col("a") != F.col("b") if mirrored else F.col("a") < F.col("b")
    pairs = sided(found.where("l"), "a", "sig").join(sided(found.where("r"), "b", "sig"), "sig").where(either & fits(tenths)).select("a", "b", "n_a", "n_b").distinct()
    keyed = lambda side: sets.select(F.col("id").alias(side), F.col("k").alias(f"k{side}"))
    # a condition is pushed to where its columns come from, so it has each key cut once; an intersection has no gram twice
    both = F.size(F.array_intersect(every_trigram(F.col("ka")), every_trigram(F.col("kb"))))
    alike = let(both, lambda n: n * 10 >= (F.col("n_a") + F.col("n_b") - n) * tenths)
    return pairs.join(keyed("a"), "a").join(keyed("b"), "b").where(alike).select("a", "b", "ka", "kb")


def similar_keys(keys: DataFrame, key: str = "key", tenths: int = 9, others: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct keys whose trigram sets have Jaccard similarity of tenths/10 or more.

    With `others`, the pairs are of a key here (a) and a different one there (b), in any order."""
    pairs = similar_sets(numbered(keys, key, others), tenths, others is not None)
    if others is None:
        return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def keys_like(keys: DataFrame, others: DataFrame, key: str = "key", tenths: int = 9) -> DataFrame:
    """(key): the distinct keys here that are similar to a different one there."""
    sets = numbered(keys, key, others)
    return similar_sets(sets, tenths, True).select(F.col("a").alias("id")).distinct().join(sets, "id").select(F.col("k").alias(key))
