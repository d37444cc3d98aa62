"""Greedy choice among similar titles: a row goes if a better-ranked row that stays is like it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperflow.operators.similarity import similar_sets, sized
from paperflow.tables import durable, free_name

#: Steps of the walk in one job.
STEPS = 3


def collapse(ranked: DataFrame, ident: str, order: str, key: str = "key", tenths: int = 9) -> DataFrame:
    """`ranked` with `kept`. Rows are walked by (order, ident); a row whose key is like that of an earlier kept row is dropped.

    The walk is a fixpoint over the pairs of similar keys alone: a key goes if some earlier neighbour stays, and stays once all of
    them have gone. Each step is one join and one grouped aggregate over pairs; a job takes `STEPS` steps, and there are as many jobs as the
    longest chain of such decisions asks for. Blank and null keys are like no other. Of equal keys only the first row can stay."""
    ranked = durable(ranked)
    place = F.struct(order, ident)
    keyed = ranked.where(F.coalesce(F.col(key), F.lit("")) != "")
    # numbers stand for keys, which may be long
    first = durable(keyed.groupBy(F.col(key).alias("k")).agg(F.min(place).alias("place")).withColumn("id", F.monotonically_increasing_id()))
    pairs = similar_sets(sized(first.select("id", "k")), tenths).select("a", "b")
    here, there = first.select(F.col("id").alias("a"), F.col("place").alias("pa")), first.select(F.col("id").alias("b"), F.col("place").alias("pb"))
    a_first = F.col("pa") < F.col("pb")
    edges = durable(pairs.join(here, "a").join(there, "b").select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late")))
    late = edges.select(F.col("late").alias("k")).distinct()
    roots = edges.select(F.col("early").alias("k")).distinct().join(late, "k", "left_anti")
    # stays: true or false once it is decided
    state = durable(late.withColumn("stays", F.lit(None).cast("boolean")).unionByName(roots.withColumn("stays", F.lit(True))))
    while state.where(F.col("stays").isNull()).limit(1).count():
        for _ in range(STEPS):
            told = edges.join(state.withColumnRenamed("k", "early"), "early").groupBy(F.col("late").alias("k")).agg(F.bool_or(F.coalesce("stays", F.lit(False))).alias("beaten"), F.bool_and(F.coalesce(~F.col("stays"), F.lit(False))).alias("free"))
            state = state.join(told, "k", "left").select("k", F.when(F.col("stays").isNotNull(), F.col("stays")).when(F.col("beaten"), False).when(F.col("free"), True).alias("stays"))
        state = durable(state)
    lost = state.where(~F.col("stays")).select(F.col("k").alias("id"))
    stay = first.join(lost, "id", "left_anti").select(F.col("k").alias(blank := free_name(ranked.columns, "of")), "place")
    out = ranked.join(stay, F.col(key) == F.col(blank), "left")
    return out.withColumn("kept", (F.coalesce(F.col(key), F.lit("")) == "") | F.coalesce(F.col("place") == place, F.lit(False))).drop(blank, "place")
