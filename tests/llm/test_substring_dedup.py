from collections import Counter

import pytest
from odd import SCHEMA, WORDS, documents, save, sha

from paperflow.llm import substring_dedup
from paperflow.llm.queries import queries


def plain(docs, window=50):
    first = {}
    lines = [(d[0], WORDS.findall(d[1] or "")) for d in docs]
    for i, words in lines:
        for k in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, words in lines:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[(i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))] += 1
    return out


def test_query(spark, tmp_path):
    docs = documents(n=120)
    want = plain(docs)
    assert sum(k[2] > 0 for k in want) > 10
    folder = save(spark, tmp_path, documents=(docs, SCHEMA))
    assert Counter(tuple(r) for r in queries()["op4_substring_dedup"](spark, folder).collect()) == want


@pytest.mark.parametrize("window", [7, 50])
def test_many_shards(spark, window):
    docs = spark.createDataFrame(documents(seed=8, n=150), SCHEMA)
    found, into = substring_dedup.dedup_substrings(docs, window=window, shard_bytes=9000)
    got = Counter((r["doc_id"], r[into]["n_words"], r[into]["n_removed"], sha(r[into]["kept"])) for r in found.collect())
    assert found.columns == [*docs.columns, into]
    assert got == plain(documents(seed=8, n=150), window)


def test_no_rows(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA))[0].collect() == []


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_levels_agree(spark, levels):
    docs = documents(seed=5, n=120)
    found, into = substring_dedup.dedup_substrings(spark.createDataFrame(docs, SCHEMA), levels=levels, shard_bytes=20_000, seed=levels)
    assert Counter((r["doc_id"], r[into]["n_words"], r[into]["n_removed"], sha(r[into]["kept"])) for r in found.collect()) == plain(docs)


def test_words_that_collide_in_polynomial_hashes(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b, common = a.translate(str.maketrans("ab", "ba")), " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{common} {a}")], "doc_id long, text string")
    found, into = substring_dedup.dedup_substrings(docs)
    assert {r["doc_id"]: r[into]["n_removed"] for r in found.collect()} == {1: 0, 2: 0, 3: 50}


def test_one_id_and_no_id_in_many_rows(spark):
    text = [" ".join(f"w{k}" for k in range(s, s + 60)) for s in range(0, 400, 5)]
    docs = [(None, t) for t in text] + [(7, t) for t in text] + [(9, text[3])]
    found, into = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=3000)
    assert Counter((r["doc_id"], r[into]["n_words"], r[into]["n_removed"], sha(r[into]["kept"])) for r in found.collect()) == plain(docs)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, shard int, id int, row int, passages int")
    found, into = substring_dedup.dedup_substrings(docs)
    assert found.columns == [*docs.columns, into] and found.first()["shard"] == 5 and found.first()[into]["kept"] == "a b"
