"""A persisted index of title keys by the parts of their trigrams, so that a day's titles are held against the ledger without reading it.

Of two keys whose trigram sets have a Jaccard similarity of tenths/10 or more, one of the parts that all trigrams are dealt to
holds the same trigrams of both (see `similarity`). How they are dealt is fixed when the index is made: by how many keys had a
trigram then, unknown ones by their hash. The order has at most 37^3 rows, as keys have a-z and 0-9 alone. Postings (gram: a hash of a
part's trigrams, id, size, sketch) lie in folders by a hash of it, the keys themselves in folders by their id, an MD5. A lookup reads the folders of its
own parts, and of the candidates that these give, and no others; candidates are compared by the sets made from the keys.
Adding keys appends files to the folders of their parts; `compacted` writes them anew as few files, sorted by part.

A key that is there already is not added again; empty keys and keys shorter than a trigram have no postings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperflow.functions.identity import trigrams
from paperflow.operators.similarity import SKETCHES, by_rarity, fits, hinted, sided, signatures
from paperflow.tables import durable

BUCKETS = 64
POSTING, KEYS = "gram bigint, id binary, n int, " + "".join(f"{c} bigint, " for c in SKETCHES) + "bucket int", "id binary, key string, bucket int"


def _order(spark: SparkSession, path: str) -> DataFrame:
    return hinted(spark.read.schema("gram string, df bigint, place bigint").parquet(f"{path}/order"))


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = POSTING if kind == "grams" else KEYS
    try:
        return spark.read.schema(schema).parquet(f"{path}/{kind}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def _sets(keys: DataFrame, key: str) -> DataFrame:
    """(id, key, g, n) of the distinct keys that have trigrams."""
    every = keys.select(F.col(key).alias("key")).where(F.col("key") != "").distinct()
    return every.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("id"), "key", trigrams(F.col("key")).alias("g")).where(F.size("g") > 0).withColumn("n", F.size("g"))


def _prefixes(sets: DataFrame, order: DataFrame, tenths: int) -> DataFrame:
    """(id, n, sketch, gram, bucket): the hash of each part of each key, dealt by the index's order."""
    return signatures(sets, order, tenths).select("id", "n", *SKETCHES, F.col("sig").alias("gram"), _bucket("sig"))


def create(spark: SparkSession, path: str, keys: DataFrame, key: str = "key", tenths: int = 9) -> None:
    """An index of `keys` for similarities of tenths/10 and more."""
    sets = durable(_sets(keys, key))
    by_rarity(sets.select(F.explode("g").alias("gram"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/order")
    _write(_prefixes(sets, _order(spark, path), tenths), sets, path, "overwrite")


def _write(prefixes: DataFrame, sets: DataFrame, path: str, mode: str) -> None:
    prefixes.select("gram", "id", "n", *SKETCHES, "bucket").repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(f"{path}/grams")
    sets.select("id", "key", _bucket("id")).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{path}/keys")


def touched(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is stored in the buckets of `wanted`; the numbers of buckets, `BUCKETS` at most, come to the driver so that folders are pruned."""
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    return stored.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))


def append(spark: SparkSession, path: str, keys: DataFrame, key: str = "key", tenths: int = 9) -> None:
    """Adds the keys that are not there yet, for which the buckets of their ids are read."""
    sets = durable(_sets(keys, key))
    there = touched(_stored(spark, path, "keys"), sets.select(_bucket("id"))).select("id")
    fresh = durable(sets.join(there, "id", "left_anti"))
    _write(_prefixes(fresh, _order(spark, path), tenths), fresh, path, "append")


def similar(spark: SparkSession, path: str, asked: DataFrame, key: str = "key", tenths: int = 9) -> DataFrame:
    """Pairs (a, b) of an asked key and a different indexed one with a similarity of tenths/10 or more."""
    sets = durable(_sets(asked, key))
    mine = durable(_prefixes(sets, _order(spark, path), tenths))
    there = touched(_stored(spark, path, "grams"), mine)
    alike = sided(mine, "a", "bucket", "gram").join(sided(there, "b", "bucket", "gram"), ["bucket", "gram"]).where((F.col("a") != F.col("b")) & fits(tenths))
    pairs = durable(alike.select("a", "b").distinct().select("a", "b", _bucket("b")))
    found = touched(_stored(spark, path, "keys"), pairs).select(F.col("id").alias("b"), F.col("key").alias("kb"))
    both = pairs.select("a", "b").join(found, "b").join(sets.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("g").alias("ga")), "a").select("ka", "kb", "ga", trigrams(F.col("kb")).alias("gb"))
    sized = both.select("ka", "kb", F.size(F.array_intersect("ga", "gb")).alias("both"), (F.size("ga") + F.size("gb")).alias("all"))
    return sized.where(F.col("both") * 10 >= (F.col("all") - F.col("both")) * tenths).select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """The index written anew under another path, one file a bucket, sorted by gram."""
    spark.read.parquet(f"{path}/order").coalesce(1).write.mode("overwrite").parquet(f"{into}/order")
    _write(_stored(spark, path, "grams").dropDuplicates(["bucket", "gram", "id"]), _stored(spark, path, "keys").dropDuplicates(["id"]), into, "overwrite")
