"""Steps whose cost is to stay close to linear in the text, held against their plain meaning."""

from pyspark.sql import functions as F

import __spark_entry__
from paperflow.functions import identity


def test_index_is_made_in_the_row(spark):
    plan = __spark_entry__.queries()["inverted_index_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_index_of_words_that_share_a_hash(spark):
    same = spark.range(400000).select(F.col("id").cast("string").alias("w")).groupBy(F.hash("w")).agg(F.sort_array(F.collect_list("w")).alias("w")).where(F.size("w") > 1).first()["w"]
    a, b = same[:2]
    rows = spark.createDataFrame([([a, b, a, "x", b],), (["x"],), ([],), (None,)], "w array<string>")
    found = [r[0] for r in rows.select(identity.inverted_index(F.col("w"))).collect()]
    assert found == [{a: [0, 2], b: [1, 4], "x": [3]}, {"x": [0]}, None, None]


def test_squeeze(spark):
    rows = spark.createDataFrame([(" a  b \t c d e  ",), ("a b",), (" \n ",)], "t string")
    assert [r[0] for r in rows.select(identity.squeeze(F.col("t"))).collect()] == ["a b c d e", "a b", ""]
