"""The scores' patterns begin with what is cheap to look at, and say the same."""

from pyspark.sql import functions as F

from paperflow.functions import scoring, text


def test_quantified_and_tokens_as_the_patterns_say(spark):
    cases = ["5 %", "a p < .05", "xp<.1", "OR = 2", "HR:1", "95%ci", "n = 12", "in=12", "2-fold", "3.5 tımeſ higher", "1 times lowers", "İncrease of 5", "reduction of 7", "Cohen's d =", "no one", "", "P=0.1 of", "a+. b'_- x86 ..c-d-"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    plain = F.array_max(F.array(*[F.col("t").rlike(p) for p in scoring.QUANTIFIED]))
    assert rows.where(scoring.quantified(F.col("t")) != plain).count() == 0
    assert all(p.startswith(("(?=", "(?i)(?=", "(?iu)(?=")) for p, first in zip(map(scoring.begun, scoring.QUANTIFIED, scoring._BEGINS), scoring._BEGINS, strict=True) if first)
    assert rows.select(text.tokens(F.col("t"))).collect()[-1][0] == ["a+", "b", "x86", "c-d"]
