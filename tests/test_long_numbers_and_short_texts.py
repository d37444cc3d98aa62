"""Numbers of cases of more than nine characters, and shares of texts of fewer than four."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from paperflow.functions import scoring


def test_sample_sizes_are_read_to_their_end(spark):
    texts = ["n=100000,000 and 9 adults", "n = 1000000,000.", "Of 1234567890 patients and 12 mice", "n = 40, and 12 patients", "n=123 45678, 12", "n=123456789 1", "n=" + "9" * 30, "no one"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scoring.sample_size(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [100000000, 1000000000, 1234567890, 40, 12345678, 123456789, None, None]


def against_sql(spark, tmp_path, name, rows):
    path = str(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'web', 0)", rows)
    con.execute(f"COPY documents TO '{path}' (FORMAT parquet)")
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == want
    return want


def test_large_ids_in_sample_sizes(spark, tmp_path):
    assert (999903, 1000003000) in against_sql(spark, tmp_path, "sample_size", [(k, "x") for k in (99899, 99899 + 4, 999903, 9999901, 99999998)])


def test_shares_of_short_texts(spark, tmp_path):
    against_sql(spark, tmp_path, "covered_share", list(enumerate([None, "", "a", "ab", "abc", "a c", " bc", "abcd", "ab cd efg", " \n "])))
