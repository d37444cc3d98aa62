"""The index of title keys against the join that reads all of them."""

import random
import re

from pyspark.sql import functions as F

from paperflow.operators import gram_index, ledger, similarity


def keys(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh0123") for _ in range(rng.randint(3, 70))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        k = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k[rng.randrange(len(k))] = rng.choice("xyz9")
        out.append("".join(k))
    return [*out, "", "ab", "abc"]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookups_equal_the_full_join(spark, tmp_path):
    path, rows = str(tmp_path / "index"), keys(240, 1)
    there, asked = rows[:160], rows[100:]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    gram_index.create(spark, path, frame(there[:60]))
    for day in range(3):  # days that overlap
        gram_index.append(spark, path, frame(there[50 + day * 30 : 100 + day * 30]))
    want = pairs(similarity.similar_keys(frame(asked), others=frame(there)))
    assert want and pairs(gram_index.similar(spark, path, frame(asked))) == want
    assert gram_index._stored(spark, path, "grams").groupBy("bucket", "gram", "id").count().where("count > 1").count() == 0
    gram_index.compacted(spark, path, path + "2")
    assert pairs(gram_index.similar(spark, path + "2", frame(asked))) == want
    assert pairs(gram_index.similar(spark, path, frame([]))) == []
    gram_index.create(spark, path + "3", frame([]))
    gram_index.append(spark, path + "3", frame(there))
    assert pairs(gram_index.similar(spark, path + "3", frame(asked))) == want


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    gram_index.create(spark, path, spark.createDataFrame([(k,) for k in keys(300, 2)], "key string"))
    asked = spark.createDataFrame([("abcdefgh0123abcd",)], "key string")
    mine = gram_index._prefixes(gram_index._sets(asked, "key"), gram_index._order(spark, path), 9)
    touched = gram_index.touched(gram_index._stored(spark, path, "grams"), mine)
    buckets = {r[0] for r in mine.select("bucket").distinct().collect()}
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(buckets) <= 8 and re.search(r"PartitionFilters: \[.*bucket", plan)
    files = {re.search(r"bucket=(\d+)", r[0])[1] for r in touched.select(F.input_file_name()).distinct().collect()}
    assert {int(f) for f in files} <= buckets


def test_ledger_by_index(spark, tmp_path):
    kinds = "work_id string, doi string, preprint_id string, key string"
    none = (None, None, None)
    title = "hedgesalongcyclepathsandfinedustinacity"
    mine = spark.createDataFrame([(1, *none, title), (2, *none, title + "s"), (3, *none, "anotherpaper"), (4, *none, "")], "id int, " + kinds)
    theirs = spark.createDataFrame([(*none, title, "2026-08-01", 0), (*none, "anotherpaper", "2020-01-01", 1)], kinds + ", day string, entry_idx int").withColumn("published_on", F.to_date("day"))
    path = str(tmp_path / "titles")
    gram_index.create(spark, path, theirs)
    today = F.lit("2026-08-19").cast("date")
    want = {r.id: r.seen_kind for r in ledger.seen_or_similar(mine, theirs, today).collect()}
    assert want == {1: "title", 2: "title", 3: None, 4: None} == {r.id: r.seen_kind for r in ledger.seen_or_similar(mine, theirs, today, index=path).collect()}


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    assert [r.place for r in ledger.numbers_in_order(rows, "v").orderBy("v").collect()] == list(range(1000))
    assert ledger.numbers_in_order(rows.limit(0), "v").collect() == []
