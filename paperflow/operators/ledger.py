"""The ledger of what was published: lookups within a window of days, and the state after another day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperflow.operators import gram_index
from paperflow.operators.similarity import keys_like, similar_keys
from paperflow.tables import durable

#: The kinds of match, in the order in which one entry is asked for them.
KINDS = ("work_id", "doi", "preprint_id")


def within_window(published: Column, today: Column, days: int) -> Column:
    """No lower bound: what is dated ahead blocks too, and so does what has no readable date."""
    return F.coalesce(F.date_diff(today, published) <= days, F.lit(True))


def seen(candidates: DataFrame, ledger: DataFrame, today: Column, days: int = 180) -> DataFrame:
    """`candidates` with seen_kind: of the earliest ledger entry that matches by an identifier, the first kind of KINDS.

    Each identifier is a join of its own, so each is an equality; an entry's number decides between them."""
    live = ledger.where(within_window(F.col("published_on"), today, days))
    found = None
    for n, kind in enumerate(KINDS):
        side = live.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.min("entry_idx").alias("entry_idx"))
        part = candidates.join(side, kind).select("id", F.struct("entry_idx", F.lit(n).alias("order"), F.lit(kind).alias("kind")).alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min("m")["kind"].alias("seen_kind"))
    return candidates.join(best, "id", "left")


def seen_or_similar(candidates: DataFrame, ledger: DataFrame, today: Column, days: int = 180, key: str = "key", index: str | None = None) -> DataFrame:
    """`seen`, and for those without an identifier in the ledger, 'title' where a title key there is theirs or 0.9 like it.

    `index` is the path of a `gram_index` of the ledger's title keys; without one the ledger's keys are cut into trigrams."""
    exact = seen(candidates, ledger, today, days)
    asked = exact.where(F.col("seen_kind").isNull() & (F.col(key) != "")).select(key).distinct()
    there = ledger.where(within_window(F.col("published_on"), today, days) & (F.col(key) != "")).select(key).distinct()
    if index is None:
        alike = keys_like(asked, there, key)
    else:
        alike = gram_index.similar(candidates.sparkSession, index, asked, key).join(there.withColumnRenamed(key, "b"), "b", "left_semi").select(F.col("a").alias(key))
    known = alike.union(asked.join(there, key, "left_semi")).distinct().withColumn("like", F.lit(True))
    return exact.join(known, key, "left").withColumn("seen_kind", F.coalesce("seen_kind", F.when(F.col("like"), "title"))).drop("like")


def latest(ledger: DataFrame, key: str) -> DataFrame:
    """One row for each key of an append-only ledger: the last date, and of the rest the earliest entry's values that are there."""
    rest = [c for c in ledger.columns if c not in (key, "published_on", "entry_idx")]
    return ledger.groupBy(key).agg(F.max("published_on").alias("published_on"), F.min("entry_idx").alias("entry_idx"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("entry_idx"))).alias(c) for c in rest])


def numbers_in_order(rows: DataFrame, by: str) -> DataFrame:
    """(by, place) of distinct values: 0, 1, ... in their order. They are sorted by range over all tasks and numbered within each, after as many as the tasks before it have."""
    ordered = durable(rows.select(by).orderBy(by).select(by, F.spark_partition_id().alias("part")))
    within = ordered.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(by)))
    sizes = [(r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]  # one row a task
    before = [(part, sum(n for p, n in sizes if p < part)) for part, _ in sizes]
    return within.join(F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long")), "part").select(by, (F.col("before") + F.col("n") - 1).alias("place"))


def record_published(ledger: DataFrame, entries: DataFrame, day: Column, index: str | None = None) -> DataFrame:
    """The ledger after a day: an entry goes to the first ledger row that has one of its identifiers or a similar title, whatever its age.

    That row's date only moves forward and its gaps are filled, by the earliest entry that can. What matches no row is a row of its own; of
    new entries that share an identifier or the title key, the first is that row and the others fill its gaps.
    `entries` have id (their order), the identifiers of KINDS, title_key and category; `ledger` has those, published_on and entry_idx."""
    fields = [*KINDS, "title_key", "category"]
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    pairs = None
    for kind in KINDS:
        side = ledger.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.min("entry_idx").alias("entry_idx"))
        part = entries.join(side, kind).select("id", "entry_idx")
        pairs = part if pairs is None else pairs.unionByName(part)
    titles = ledger.where(F.col("title_key") != "").groupBy("title_key").agg(F.min("entry_idx").alias("entry_idx"))
    asked = entries.where(F.col("title_key") != "").select("title_key").distinct()
    like = similar_keys(asked, "title_key", others=titles.select("title_key")) if index is None else gram_index.similar(entries.sparkSession, index, asked, "title_key")
    same = entries.join(titles, "title_key").select("id", "entry_idx")
    alike = entries.join(like.withColumnsRenamed({"a": "title_key", "b": "other"}), "title_key").join(titles.withColumnRenamed("title_key", "other"), "other").select("id", "entry_idx")
    at = pairs.unionByName(same).unionByName(alike).groupBy("id").agg(F.min("entry_idx").alias("entry_idx"))
    placed = entries.join(at, "id", "left")
    news = placed.where(F.col("entry_idx").isNull())
    first = news.withColumn("first", F.col("id"))
    for key in (*KINDS, "title_key"):
        least = news.where(filled(key).isNotNull()).groupBy(key).agg(F.min("id").alias("least"))
        first = first.join(least, key, "left").withColumn("first", F.least("first", "least")).drop("least")
    base = ledger.agg(F.coalesce(F.max("entry_idx"), F.lit(-1)).alias("base"))
    numbered = numbers_in_order(first.select("first").distinct(), "first").crossJoin(F.broadcast(base)).select("first", (F.col("base") + F.col("place") + 1).cast("long").alias("new_idx"))
    added = first.drop("entry_idx").join(numbered, "first").withColumnRenamed("new_idx", "entry_idx").drop("first")
    known = placed.where(F.col("entry_idx").isNotNull())
    rows = ledger.select("entry_idx", *fields, "published_on", F.lit(None).cast("long").alias("by")).unionByName(added.unionByName(known.select(added.columns)).select("entry_idx", *fields, day.alias("published_on"), F.col("id").cast("long").alias("by")))
    order = F.struct(F.col("by").isNotNull().alias("late"), F.coalesce("by", F.lit(-1)).alias("by"))
    return rows.groupBy("entry_idx").agg(F.max("published_on").alias("published_on"), *[F.min_by(c, F.when(filled(c).isNotNull(), order)).alias(c) for c in fields])
