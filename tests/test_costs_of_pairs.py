"""A title's trigrams are cut a fixed number of times, over all cores, however many classes of sizes there are."""

from pyspark.sql import functions as F

from paperflow.operators import collapse, similarity


def cuts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_collapse_writes_sizes_down_and_deals_titles(spark, monkeypatch):
    given = []
    monkeypatch.setattr(collapse, "similar_sets", lambda sets, tenths: given.append(sets) or similarity.similar_sets(sets, tenths))
    rows = [(k, k % 7, f"hedges along cycle paths and fine dust {k // 2}") for k in range(40)] + [(90, 0, "ab"), (91, 0, None)]
    out = collapse.collapse(spark.createDataFrame(rows, "id int, rank int, key string").coalesce(1), "id", "rank")
    assert out.count() == 42 and {r.id for r in out.where("kept").collect()} >= {90, 91}
    assert cuts(given[0]) == 0 and given[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(given[0].columns) == ["id", "k", "n"] and given[0].where(F.length("k") < 3).count() == 0


def test_keys_of_a_pair_are_cut_once(spark):
    sets = similarity.numbered(spark.createDataFrame([(f"hedgesalongcyclepaths{k}",) for k in range(9)], "key string"), "key", None)
    assert cuts(sets) == 0 and cuts(similarity.similar_sets(sets)) == 2


def test_sketches_come_from_one_reading(spark):
    sets = spark.createDataFrame([(1, ["abc", "bcd"]), (2, []), (3, ["abc"])], "id int, g array<string>")
    drawn = similarity.sketched(sets, F.col("g"))
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    bits = {r.id: sum(bin(r[c] & (2**64 - 1)).count("1") for c in similarity.SKETCHES) for r in drawn.collect()}
    assert bits == {1: 2, 2: 0, 3: 1}
