"""Quality by hierarchical empirical Bayes: a document classifier's evidence with the posteriors of its host and path.

The classifier is a logistic regression on counts that one JVM pass takes of each text, fitted to at most `max_train`
labelled rows outside the held-out fold. Its probabilities (for labelled training rows, their labels) add up by host
and by path; each level is a beta prior for the next, with strengths estimated from the spread between groups by the
method of moments, so a site with few documents stays near the level above it and at last near the global mean. A
document leaves its own part out of its site's sums. Score: logit of the evidence + logit of the path posterior -
logit of the global mean.

Defined cases: a null text counts as empty; a null host or path is a group of its own; rows without id have no label
and are not held out; of several labels of a document the smaller counts; without labels of both kinds the evidence
is the prior mean; repeated rows score alike; a table without rows gives none; input columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.llm.common import durable
from paperflow.llm.native import BLANKS, let, words_of
from paperflow.llm.toxicity import held_out

FEATURES = ("log_words", "log_line", "word_length", "distinct", "upper", "digits", "symbols", "punctuation", "repeated_lines", "one_character")


def features(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    share = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    body = F.length(F.translate(t, BLANKS, ""))
    by_word = let(words_of(F.lower(t)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.size(F.filter(w, lambda x: F.length(x) == 1)).alias("c")))
    by_line = let(F.filter(F.split(t, "\n"), lambda x: x != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÇÈÉÊËÎÏÔÙÛÜÄÖÁÍÓÚÑ", ""))
    return [
        by_word.alias("w"), by_line.alias("l"), body.alias("b"), share(upper, body).alias("upper"), share(gone("0123456789"), body).alias("digits"),
        share(gone("#*$%&|<>{}[]=_\\/~^@"), body).alias("symbols"), share(gone(".,;:!?"), body).alias("punctuation"),
    ]


def measured(docs: DataFrame, *, doc_id: str, text: str, host: str, path: str) -> DataFrame:
    w, n = F.col("w"), F.greatest(F.col("w")["n"], F.lit(1))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), *features(F.col(f"`{text}`")))
    return rows.select(
        "doc_id", "host", "path",
        F.array(
            F.log1p(w["n"].cast("double")), F.log1p(w["n"] / F.greatest(F.col("l")["n"], F.lit(1))), F.log1p(F.col("b") / n), w["d"] / n, "upper", "digits", "symbols", "punctuation",
            1 - F.col("l")["d"] / F.greatest(F.col("l")["n"], F.lit(1)), w["c"] / n,
        ).cast("array<double>").alias("x"),
    )


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights with the intercept last) of a ridge logistic regression on the features and their squares."""
    x = np.column_stack([x, x * x])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, w = np.column_stack([(x - centre) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: Column) -> float:
    """The beta prior's strength from the spread of group means about `mean`, by moments; between 1 and 10,000."""
    rate = F.col("k") / F.col("n")
    r = groups.where("n >= 2").agg(F.sum(F.col("n") * (rate - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.avg(mean * (1 - mean)).alias("v")).first()
    if not r["g"] or not r["v"]:
        return 10_000.0
    extra = max(0.0, (r["between"] - r["within"]) / r["n"])
    return float(min(10_000.0, max(1.0, r["v"] / extra - 1))) if extra > 0 else 10_000.0


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", max_train: int = 20_000) -> DataFrame:
    """(doc_id, held_out, evidence, host_posterior, path_posterior, score, kept) for every row."""
    rows = durable(measured(docs, doc_id=doc_id, text=text, host=host, path=path))
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("known_id")).agg(F.min(label).cast("double").alias("y"))
    joined = rows.join(known, F.col("doc_id") == F.col("known_id"), "left")
    sample = joined.where(F.col("y").isNotNull()).select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()
    ys = np.array([r["y"] for r in sample])
    if len(set(ys.tolist())) == 2:
        centre, scale, weights = fit(np.array([r["x"] for r in sample]), ys)
        parts = [F.lit(float(weights[-1]))]
        for k in range(len(FEATURES)):
            v = F.get(F.col("x"), k)
            parts += [(v - float(centre[k])) * float(weights[k] / scale[k]), (v * v - float(centre[k + len(FEATURES)])) * float(weights[k + len(FEATURES)] / scale[k + len(FEATURES)])]
        total = parts[0]
        for x in parts[1:]:
            total = total + x
        evidence = 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))
    else:
        evidence = F.lit(float(ys.mean()) if len(ys) else 0.5)
    scored = durable(joined.select("doc_id", "host", "path", evidence.alias("evidence"), F.coalesce("y", evidence).alias("part")))
    by_path = durable(scored.groupBy("host", "path").agg(F.sum("part").alias("k"), F.count(F.lit(1)).alias("n")))
    by_host = by_path.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = by_path.agg((F.sum("k") / F.sum("n")).alias("p"), F.count(F.lit(1)).alias("g")).first()
    if total["p"] is None:
        total = {"p": 0.5, "g": 0}
    mean = F.lit(float(total["p"]))
    s_host = strength(by_host, mean)
    host_mean = (F.col("hk") + s_host * mean) / (F.col("hn") + s_host)
    sites = by_path.join(by_host.select(F.col("host").alias("h2"), F.col("k").alias("hk"), F.col("n").alias("hn")), F.col("host").eqNullSafe(F.col("h2"))).select("host", "path", "k", "n", "hk", "hn")
    s_path = strength(sites, host_mean)
    sites = sites.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "k", "n", "hk", "hn")
    if total["g"] <= 10_000:  # a row has two names and four numbers
        sites = F.broadcast(sites)
    both = scored.join(sites, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")))
    at_host = (F.col("hk") - F.col("part") + s_host * mean) / (F.col("hn") - 1 + s_host)
    at_path = (F.col("k") - F.col("part") + s_path * F.col("host_posterior")) / (F.col("n") - 1 + s_path)
    out = both.withColumn("host_posterior", at_host).withColumn("path_posterior", at_path)
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_posterior")) - logit(mean))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "evidence", "host_posterior", "path_posterior", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)
