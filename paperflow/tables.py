"""Reading tables, spreading few partitions over all cores, and cutting lineage where every executor can read it again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if its scan has fewer splits than cores, as a file of one row group has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation of what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> None:
    """Names the folder of `spark.checkpoint.dir` to Spark; one machine may do without."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paperflow-checkpoint-"))  # all in one machine


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once a row wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(columns: list[str], base: str) -> str:
    """`base`, with underscores added until no column has that name (names compare without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def scanned(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind>: what `step` gives for one value after the other.

    `step` takes what is carried and a value, and returns a struct of `carry` and `out`; a null `out` adds nothing. Appending to an array copies it, so values go in
    blocks of the root of their number, and the arrays of the blocks are joined at the end."""
    none = lambda of: F.expr(f"cast(array() as array<{of}>)")

    def block(b: Column, carry: Column) -> Column:
        grown = lambda s, r: F.struct(r["carry"].alias("carry"), F.when(r["out"].isNull(), s["out"]).otherwise(F.array_append(s["out"], r["out"])).alias("out"))
        return F.aggregate(b, F.struct(carry.alias("carry"), none(kind).alias("out")), lambda s, x: let(step(s["carry"], x), lambda r: grown(s, r)))

    def in_blocks(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.size(a), width), lambda k: F.slice(a, k, width))
        add = lambda s, b: let(block(b, s["carry"]), lambda r: F.struct(r["carry"].alias("carry"), F.array_append(s["out"], r["out"]).alias("out")))
        return F.aggregate(blocks, F.struct(start.alias("carry"), none(f"array<{kind}>").alias("out")), add, lambda s: F.flatten(s["out"]))

    return let(values, lambda a: F.when(F.size(a) > 0, in_blocks(a)).otherwise(none(kind)))


def running(sizes: Column) -> Column:
    """array<int>: for each of `sizes` (array<int>) the sum of those before it.

    Sums go in blocks of the root of their number; a block ends with the sum that the next begins with."""

    def block(b: Column, before: Column) -> Column:
        return F.aggregate(b, F.array(before), lambda s, x: F.array_append(s, (F.element_at(s, -1) + x).cast("int")))

    def in_blocks(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.size(a), width), lambda k: F.slice(a, k, width))
        add = lambda s, b: let(block(b, s["carry"]), lambda r: F.struct(F.element_at(r, -1).alias("carry"), F.array_append(s["out"], F.slice(r, 1, F.size(b))).alias("out")))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("carry"), F.expr("cast(array() as array<array<int>>)").alias("out")), add, lambda s: F.flatten(s["out"]))

    return let(sizes, lambda a: F.when(F.size(a) > 0, in_blocks(a)).otherwise(F.expr("cast(array() as array<int>)")))


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`; both are arrays of structs with start and end, in code points, end exclusive.

    All are sorted by start once. A span is met by one before it if the greatest end so far lies beyond its start, and by one after it if the next start lies before its end."""
    def sweep(found: Column, at: Callable[[Column], Column], pick) -> Column:
        """For each of `found` the best `at` of others before it."""
        step = lambda best, x: F.struct(F.when(x["mine"] == 0, pick(best, at(x))).otherwise(best).alias("carry"), best.alias("out"))
        return scanned(found, F.lit(-1) if pick is F.greatest else F.lit(2147483647), step, "int")

    def picked(mine: Column, rest: Column) -> Column:
        ends = F.concat(
            F.transform(rest, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("mine"), s["end"].alias("end"), F.lit(None).cast("int").alias("k"))),
            F.transform(mine, lambda s, k: F.struct(s["start"].alias("start"), F.lit(1).alias("mine"), s["end"].alias("end"), k.alias("k"))),
        )

        def kept(found: Column) -> Column:
            both = F.struct(sweep(found, lambda x: x["end"], F.greatest).alias("reach"), F.reverse(sweep(F.reverse(found), lambda x: x["start"], F.least)).alias("next"))
            free = lambda b: F.transform(F.arrays_zip(found.alias("x"), b["reach"].alias("reach"), b["next"].alias("next")), lambda z: F.when((z["x"]["mine"] == 1) & (z["reach"] <= z["x"]["start"]) & (z["next"] >= z["x"]["end"]), z["x"]["k"]))
            return F.transform(F.array_compact(let(both, free)), lambda k: F.get(mine, k))

        return F.when((F.size(mine) > 0) & (F.size(rest) > 0), let(F.array_sort(ends), kept)).otherwise(mine)

    # both are computed once a row
    return let(spans, lambda mine: let(others, lambda rest: picked(mine, rest)))


def match_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, found>> of all matches in code points, end exclusive. `pattern` must not match the empty string."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")

    def placed(x: Column) -> Column:
        sizes = F.zip_with(x["before"], x["found"], lambda b, f: F.length(b) + F.length(f))
        starts = F.zip_with(running(sizes), x["before"], lambda at, b: at + F.length(b))
        return F.zip_with(starts, x["found"], lambda at, f: F.struct(at.alias("start"), (at + F.length(f)).alias("end"), f.alias("found")))

    def parted(t: Column) -> Column:
        return let(F.regexp_extract_all(t, rx, F.lit(0)), lambda f: let(F.struct(F.slice(F.split(t, rx, -1), 1, F.size(f)).alias("before"), f.alias("found")), placed))

    return let(text, lambda t: F.when(F.regexp_like(t, rx), parted(t)).otherwise(none))
