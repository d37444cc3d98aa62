"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Each rule rejects texts whose statistic is above a cutoff of a stated grid. The labelled good documents are dealt by
a hash of their ids into a part to tune on and a holdout. On the tuning part each stratum takes for each rule the strictest
cutoff that rejects no more of its good documents than an even share of `permitted`: its strictest set of cutoffs.
The holdout then tests nested sets, from the base rules alone over this set relaxed by several steps of the grid to
the set itself, each as a whole with the base rules: with n good documents of which k are not kept, a set is safe if
the exact binomial probability of k or fewer at the rate `permitted` is at most delta over the number of strata
tested. Sets are tested in that fixed sequence and the last one before the first that is not safe is taken, so with
probability 1 - delta no stratum keeps out more of its good documents than permitted by a set that was taken. Strata
with too few holdout documents to pass even without a rejection are tested together, as one; the promise then is to
that pool. A stratum whose base rules alone are not safe has no further rule.

Defined cases: a null text has no words and fails; a null stratum is a stratum; several labels of a document count
as good if all are; rows without id count as unlabelled; rows that repeat an id and their statistics count once; repeated
rows are judged alike; without labels only the base rules reject; a table without rows gives none; input columns may
have any names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.llm.common import durable
from paperflow.llm.native import BLANKS, let, words_of

SYMBOLS = "#*$%&|<>"
#: Strata up to which their tables, a few numbers a row, are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 10_000
#: A rule's statistic and its cutoffs, from strict to loose.
RULES: dict[str, tuple[Column, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "few_words": ("1 / greatest(n_words, 1)", (1 / 100, 1 / 60, 1 / 50, 1 / 40, 1 / 30, 1 / 20, 1 / 15, 1 / 12)),
}


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that stand in a run of `window` words which the text has twice or more. Hashes find texts that may have such runs; the runs themselves are compared."""

    def grams(w: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: make(*[F.get(w, i + j) for j in range(window)]))

    def exact(w: Column) -> Column:
        runs = F.array_sort(F.transform(grams(w, lambda *x: F.concat_ws(" ", *x)), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.sequence(x["i"], x["i"] + (window - 1))))))

        return let(runs, twice)

    def screened(w: Column) -> Column:
        return let(grams(w, F.xxhash64), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(w)))

    return let(words, lambda w: F.when(F.size(w) > window, screened(w)).otherwise(0))


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{stratum}`").alias("stratum"),
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    ).select("doc_id", "stratum", F.col("w")["n"].alias("n_words"), "word_chars", "n_symbols", F.col("l")["n"].alias("n_lines"), F.col("l")["d"].alias("n_dup_lines"), F.col("w")["r"].alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """ln P(X <= k) for X binomial (n, rate), summed term by term in logarithms."""
    odds = math.log(rate / (1 - rate))
    start = F.struct((n * math.log1p(-rate)).alias("term"), F.lit(-1e300).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        top = F.greatest(s["sum"], s["term"])
        total = top + F.log(F.exp(s["sum"] - top) + F.exp(s["term"] - top))
        return F.struct((s["term"] + F.log(F.greatest(n - i, F.lit(1)) / (i + 1.0)) + odds).alias("term"), total.alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["sum"])


def cutoff(name: str, at: Column) -> Column:
    """The rule's cutoff number `at`, from strict to loose; infinite beyond the grid."""
    return F.coalesce(F.get(F.array(*[F.lit(float(c)) for c in RULES[name][1]]), at), F.lit(float("inf")))


def rejects(relaxed: Column | int) -> Column:
    """Whether some rule rejects by the cutoffs numbered in the columns `at_<rule>`, relaxed by so many steps."""
    tests = [F.expr(x) > cutoff(name, F.col(f"at_{name}") + relaxed) for name, (x, _) in RULES.items()]
    return reduce(lambda a, b: a | b, tests)


def thresholds(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", permitted: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, n_good of the holdout behind it, pooled, one column of the chosen cutoff for each rule, infinite where it does not reject)."""
    good = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("labelled_id")).agg(F.min(label).alias("good")).where("good = 1").select("labelled_id")
    known = stats.join(good, F.col("doc_id") == F.col("labelled_id"), "left_semi").distinct()
    known = durable(known.withColumn("tuning", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8").withColumn("failed", base_failed()))
    per_rule, grid = permitted / len(RULES), max(len(cuts) for _, cuts in RULES.values())
    held = known.where("not tuning").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # with this many, no rejection at all is proof enough, however many strata are tested
    least = math.ceil(math.log(delta / (held.count() + 1)) / math.log1p(-permitted))
    strata = stats.select("stratum").distinct().join(held.withColumnRenamed("stratum", "held_stratum"), F.col("stratum").eqNullSafe(F.col("held_stratum")), "left")
    strata = durable(strata.select("stratum", (F.coalesce("n", F.lit(0)) < least).alias("pooled")))
    tested = max(1, strata.where("not pooled").count() + 1)
    group = strata.select(F.col("stratum").alias("of"), "pooled", F.when(F.col("pooled"), F.lit(None).cast("string")).otherwise(F.col("stratum").cast("string")).alias("name"))
    if group.count() <= BROADCAST_STRATA:
        group = F.broadcast(group)
    known = known.join(group, F.col("stratum").eqNullSafe(F.col("of")))

    tuned = known.where("tuning and not failed").groupBy("pooled", "name").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(x) > c).alias(f"{name}_{k}") for name, (x, cuts) in RULES.items() for k, c in enumerate(cuts)])

    def strictest(name: str) -> Column:
        cuts = RULES[name][1]
        return F.coalesce(*[F.when(F.col(f"{name}_{k}") <= per_rule * F.col("n"), F.lit(k)) for k in range(len(cuts))], F.lit(len(cuts))).alias(f"at_{name}")

    tuned = tuned.select(F.col("pooled").alias("pooled2"), F.col("name").alias("name2"), *[strictest(name) for name in RULES])
    same = F.col("pooled").eqNullSafe(F.col("pooled2")) & F.col("name").eqNullSafe(F.col("name2"))
    proof = known.where("not tuning").join(tuned, same).groupBy("pooled", "name", *[f"at_{name}" for name in RULES]).agg(F.count(F.lit(1)).alias("n_good"), *[F.count_if(F.col("failed") | rejects(r)).alias(f"out_{r}") for r in range(grid + 1)])
    limit = math.log(delta / tested)
    safe = lambda k: (k < permitted * F.col("n_good")) & (log_binomial_cdf(F.least(k, F.floor(permitted * F.col("n_good"))), F.col("n_good"), permitted) <= limit)
    # from the base rules alone (all rules relaxed beyond the grid) to the strictest set, as far as all before are safe
    relaxed = F.aggregate(F.sequence(F.lit(0), F.lit(grid)), F.struct(F.lit(grid + 1).alias("at"), F.lit(True).alias("on")), lambda s, i: F.when(s["on"] & safe(F.get(F.array(*[F.col(f"out_{grid - r}") for r in range(grid + 1)]), i)), F.struct((grid - i).alias("at"), F.lit(True).alias("on"))).otherwise(F.struct(s["at"].alias("at"), F.lit(False).alias("on"))), lambda s: s["at"])
    found = proof.withColumn("relaxed", relaxed).select(F.col("pooled").alias("pooled2"), F.col("name").alias("name2"), "n_good", *[cutoff(name, F.col(f"at_{name}") + F.col("relaxed")).alias(name) for name in RULES])
    return group.join(found, same, "left").select(F.col("of").alias("stratum"), F.coalesce("n_good", F.lit(0)).alias("n_good"), "pooled", *[F.coalesce(name, F.lit(float("inf"))).alias(name) for name in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """The statistics of every row with base_failed, the rules that reject it, and kept."""
    stats = durable(statistics(docs, doc_id=doc_id, text=text, stratum=stratum))
    cuts = durable(thresholds(stats, labels, doc_id=doc_id, **options).withColumnRenamed("stratum", "stratum_"))
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("stratum_")), "left")
    rejecting = F.filter(F.array(*[F.when(F.expr(x) > F.col(name), F.lit(name)) for name, (x, _) in RULES.items()]), lambda r: r.isNotNull())
    return joined.select(*stats.columns, base_failed().alias("base_failed"), rejecting.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
