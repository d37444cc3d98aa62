"""Rows that are odd in every way, for operators whose other tests have none; the classifier against a plain version."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from odd import SCHEMA, WORDS, documents, save
from pyspark.sql import functions as F

from paperflow.llm import decontamination, packing, pii, quality_classifier, quality_rules, simhash, toxicity, warc

CLASHES = "whole_text string, toxicity double, fingerprint string, body_hash string, marked_id string, mark string, stay_id int, stay_fp int, decontamination string, before_ int, shard int, x double, y int, host string, path string, spans string, told string, stratum string, at_symbols int"


def clashing(spark, rows=40):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return spark.createDataFrame(documents(n=rows), SCHEMA).select("doc_id", "text", "lang", "source", *[F.lit(None).cast(c.split()[1]).alias(n) for n, c in zip(names, CLASHES.split(", "), strict=True)])


def test_extra_columns_with_clashing_names(spark):
    docs = clashing(spark)
    n = docs.count()
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit("z").alias("y"))
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen", "z")], "item_id long, text string, i string")
    scored, into = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.columns == [*docs.columns, into] and scored.count() == n
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= n
    found, into = decontamination.scan(docs, items)
    assert found.columns == [*docs.columns, into] and found.count() == n
    assert quality_classifier.classify(docs, labels).count() == quality_rules.judge(docs, labels).count() == pii.digest(docs).count() == n
    assert {r["doc_id"] for r in packing.best_fit(docs).collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).collect() == [] and simhash.deduplicate(docs).collect() == [] and simhash.near_duplicates(docs).collect() == []
    assert toxicity.score(docs, toxicity.train(docs, labels))[0].collect() == quality_classifier.classify(docs, labels).collect() == quality_rules.judge(docs, labels).collect() == []
    assert decontamination.scan(docs, spark.createDataFrame([], "item_id long, text string"))[0].collect() == pii.digest(docs).collect() == []


def test_ties_and_repeats_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "same words here", "b"), (1, "same words here", "a"), (1, "same  words here", "c"), (2, "same words here", "d"), (None, "same words here", "e"), (None, None, "f"), (None, "", "g"), (3, "", "h"), (4, "quite other words than those", "i")]
    docs = "doc_id long, text string, tag string"
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = sorted((r.doc_id, r.text, r.tag) for r in simhash.deduplicate(spark.createDataFrame(rows, docs).repartition(3)).collect())
        want = want or got
        assert got == want
    assert [g[0] for g in got] == [1, 3, 4] and got[0][2] in "abc"


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"word{k % 5000}" for k in range(300_000))
    rows = [(1, long), (1, long), (2, long + " idiot"), (3, "you idiot"), (3, "you idiot")] + [(10 + k, "plain words alone" if k % 2 else "you are an idiot") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    labels = spark.createDataFrame([(10 + k, 1 - k % 2, k % 2) for k in range(40)], "doc_id long, toxic int, quality int")
    found, into = toxicity.score(docs, toxicity.train(docs, labels), carry=["doc_id"])
    got = defaultdict(set)
    for r in found.collect():
        got[r["doc_id"]].add(r[into])
    assert all(len(x) == 1 for x in got.values()) and min(got[3]) > 0.5 > max(got[1])
    by = Counter((r["doc_id"], round(r["score"], 9)) for r in quality_classifier.classify(docs, labels).where("doc_id in (1, 3)").collect())
    assert sorted(by.values()) == [2, 2]
    assert len({r["component_id"] for r in simhash.near_duplicates(docs.where("doc_id < 3")).collect()}) == 1


def test_archives_with_clashing_columns_and_odd_pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", None), (2, None, ""), (3, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (3, "v", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 50), (6, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"raw": F.lit(1), "digest": F.lit(2), "response": F.lit(3), "id2": F.lit(4)})
    got = Counter((int(r.page_id), r.payload_bytes, r.record_type, r.refers_to and int(r.refers_to)) for r in warc.round_trip(pages).collect())
    assert got == Counter({(1, 0, "response", None): 1, (2, 0, "revisit", 1): 1, (3, 10 - 1, "response", None): 2, (4, 9, "revisit", 3): 1, (5, len(rows[5][2].encode()), "response", None): 1, (6, 3_000_000, "response", None): 1})


def plain_features(text):
    t = text or ""
    w = WORDS.findall(t.lower())
    lines = [x for x in t.split("\n") if x]
    body = sum(c not in " \t\n\x0b\x0c\r" for c in t)
    share = lambda chars: sum(c in chars for c in t) / max(body, 1)
    return [
        math.log1p(len(w)), math.log1p(len(w) / max(len(lines), 1)), math.log1p(body / max(len(w), 1)), len(set(w)) / max(len(w), 1), share("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÇÈÉÊËÎÏÔÙÛÜÄÖÁÍÓÚÑ"), share("0123456789"),
        share("#*$%&|<>{}[]=_\\/~^@"), share(".,;:!?"), 1 - len(set(lines)) / max(len(lines), 1), sum(len(x) == 1 for x in w) / max(len(w), 1),
    ]


def plain_strength(groups):
    """groups: (k, n, mean of the level above)"""
    big = [(k, n, m) for k, n, m in groups if n >= 2]
    v = sum(m * (1 - m) for _, _, m in big) / len(big) if big else 0
    if not v:
        return 10_000.0
    extra = max(0.0, (sum(n * (k / n - m) ** 2 for k, n, m in big) - sum(m * (1 - m) for _, _, m in big)) / sum(n for _, n, _ in big))
    return min(10_000.0, max(1.0, v / extra - 1)) if extra > 0 else 10_000.0


def plain_classify(rows, labels):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    known = {}
    for i, y in labels:
        if i is not None and y is not None and not held(i):
            known[i] = min(known.get(i, 1), y)
    x = [plain_features(t) for _, t, _, _ in rows]
    train = [k for k, r in enumerate(rows) if r[0] in known]
    centre, scale, w = quality_classifier.fit(np.array([x[k] for k in train]), np.array([float(known[rows[k][0]]) for k in train]))
    z = (np.column_stack([np.array(x), np.array(x) ** 2]) - centre) / scale
    evidence = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
    part = [float(known.get(r[0], e)) for r, e in zip(rows, evidence, strict=True)]
    host, path = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for (_, _, p, h), value in zip(rows, part, strict=True):
        for group, key in ((host, h), (path, (h, p))):
            group[key][0] += value
            group[key][1] += 1
    mean = sum(part) / len(part)
    s_host = plain_strength([(k, n, mean) for k, n in host.values()])
    above = {h: (k + s_host * mean) / (n + s_host) for h, (k, n) in host.items()}
    s_path = plain_strength([(k, n, above[h]) for (h, _), (k, n) in path.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for (i, _, p, h), e, value in zip(rows, evidence, part, strict=True):
        at_host = (host[h][0] - value + s_host * mean) / (host[h][1] - 1 + s_host)
        at_path = (path[h, p][0] - value + s_path * at_host) / (path[h, p][1] - 1 + s_path)
        out.append((i, held(i), float(e), at_host, at_path, 1 / (1 + math.exp(-(logit(e) + logit(at_path) - logit(mean))))))
    return out


def test_quality_classifier_against_plain_version(spark):
    rng = random.Random(6)
    rows = []
    for k in range(260):
        good = rng.random() < (0.9 if k % 5 == 0 else 0.4)
        words = [rng.choice(["plain", "words", "of", "prose", f"w{rng.randrange(400)}"]) if good or rng.random() < 0.6 else rng.choice(["###", "BUY", "1234", "x"]) for _ in range(rng.randint(5, 60))]
        rows.append((k, "\n".join([" ".join(words[:9]), " ".join(words[9:])]), ("en", "de", None)[k % 3], f"site{k % 5}" if k % 7 else None))
    rows += [(900, None, "en", "lonely"), (901, "", None, None), (None, "no id", "en", "site1"), rows[3]]
    labels = [(k, int(rows[k][1].count("#") == 0)) for k in range(0, 260, 2)] + [(4, 0), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=order), sorted(plain_classify(rows, labels), key=order), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6), (a, b)


def test_pipeline_stages_on_odd_rows_and_none(spark, tmp_path):
    docs = documents(n=40)
    docs += [(None, "no id at all", None, None, None, None), (None, None, None, None, None, None), docs[15], docs[15]]
    labels, items = [(d[0], 1, 0) for d in docs], [(1, "some words of a test item"), (None, None)]
    for n, rows in enumerate((docs, [])):
        folder = save(spark, tmp_path / str(n), documents=(rows, SCHEMA), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(items, "item_id long, text string"))
        now = spark.read.parquet(f"{folder}/documents.parquet")
        columns = now.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == columns
                path = str(tmp_path / f"{n}-{k}")
                now.write.parquet(path)
                now = spark.read.parquet(path)
        assert (now.count() > 0) == bool(rows)
