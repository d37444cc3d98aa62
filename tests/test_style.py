import datetime as dt

from pyspark.sql import functions as F

from paperflow.operators import findings, style
from paperflow.streaming import dedup

PLAIN = "Děti stavěly na louce dřevěný domek."


def test_five_checks_and_their_blocks(spark):
    rows = [
        (1, "souhrn", "Převratný domek. Cena klesla o 9 %.", None), (1, "podrobneVysvetleni", "The keys of this house are hidden under the stone.", None), (1, "procJeToDulezite", PLAIN + " slovo" * 40 + ".", None), (1, "poznamkaKOmezenim", "Převratný dům za 9 %.", None),
        (2, "souhrn", PLAIN, None), (2, "podrobneVysvetleni", "Kohorta jedla.", None), (2, "procJeToDulezite", None, None), (2, "poznamkaKOmezenim", "Kohorta.", None), (3, "souhrn", PLAIN, None),
    ]
    blocks = spark.createDataFrame(rows, "doc int, block string, text string, title string")
    found = style.findings(blocks)
    got = {(r.doc, r.check, r.block) for r in found.collect()}
    assert got >= {(1, "overstatement", 0), (1, "overstatement", 3), (1, "number", 0), (1, "english", 1), (1, "readability", 2), (2, "gloss", 1)}
    assert not {(1, "number", 3), (1, "readability", 3), (2, "gloss", 3)} & got and not any(d == 3 for d, _, _ in got)
    assert {r.doc: r.status for r in style.statuses(blocks, found).collect()} == {1: "fail", 2: "fail", 3: "pass"}
    assert {r.doc for r in findings.instructions(found).collect()} == {1, 2}
    assert style.findings(blocks.limit(0)).count() == 0
    echoed = style.findings(blocks.withColumn("title", F.lit("keys of this house")))
    assert [(r.doc, r.block, r.start, r.end) for r in echoed.where("rule = 'title_echo'").collect()] == [(1, 1, 4, 22)]
    long = found.where("rule = 'R2'").first()
    assert (long.doc, long.block, long.start, long.end) == (1, 2, 0, 37 + 6 * 40)
    assert {r.block for r in found.where("check = 'readability' AND rule <> 'R2'").collect()} <= {style.ALL}


def test_rolling_counts_of_a_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 10)
    rows = [(k % 2, day + dt.timedelta(days=k)) for k in range(10)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "s"))
    q = dedup.counts(stream, "ts", "1 day", "7 days", "1 day", "k").writeStream.format("memory").queryName("rolling").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.window.start, r.k): r.n for r in spark.table("rolling").collect()}
    want = {}
    for k, at in rows:
        for back in range(7):
            key = (at - dt.timedelta(days=back), k)
            want[key] = want.get(key, 0) + 1
    assert got == want
