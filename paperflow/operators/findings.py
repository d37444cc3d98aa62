"""Tables of findings (doc, block, start, end, severity, rule, ord): the strongest at a place, their order, what a writer is told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(findings: DataFrame) -> DataFrame:
    """One finding for each place where one begins: hard before warn, then the longest, then the first entry."""
    best = Window.partitionBy("doc", "block", "start").orderBy((F.col("severity") == "hard").desc(), F.col("end").desc(), "ord")
    return findings.withColumn("place_", F.row_number().over(best)).where("place_ = 1").drop("place_")


def in_order(findings: DataFrame) -> DataFrame:
    """(doc, findings): by block, start and rule."""
    one = F.struct("block", "start", "rule", "end", "severity")
    return findings.groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("findings"))


def instructions(findings: DataFrame) -> DataFrame:
    """(doc, text): one line for each hard finding, in order, for a writer who tries again."""
    told = F.transform("findings", lambda f: F.concat(f["rule"], F.lit(" at "), f["start"].cast("string")))
    return in_order(findings.where("severity = 'hard'")).select("doc", F.array_join(told, "\n").alias("text"))


def runs(words: Column, plain: Callable[[Column], Column]) -> Column:
    """array<int>: lengths of the runs of consecutive words that are plain."""
    flags = F.array_join(F.transform(words, lambda w: F.when(plain(w), "a").otherwise("x")), "")
    return F.transform(F.regexp_extract_all(flags, F.lit("a+"), F.lit(0)), lambda r: F.length(r))
