import random
import re

import numpy as np
import xxhash

from paperflow.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = WORDS.findall(lowered(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"W{k}é" for k in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 90))) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "One two", "one\ttwo ", *base, *base[:6]]
    for b in base[:12]:
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append("  ".join(words))
    texts.append(" ".join(rng.choices(vocabulary, k=30000)))
    return texts


def test_query_against_all_pairs(spark, tmp_path):
    from paperflow.llm.queries import queries

    texts = corpus()
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries()["op2_simhash"](spark, str(tmp_path)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], prints)
    assert got == {(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want)}


def test_one_of_each_group_stays(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(6, texts[6], "x")], "doc_id long, text string, fingerprint string")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    want = sorted(set(plain_components(list(range(len(texts))), [plain_fingerprint(t) for t in texts])))
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4)])
    near = np.concatenate([near, near[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    points = np.unique(near)
    linked = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    label = np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    for leaf in (1 << 16, 200):
        from paperflow.llm.components import components

        found = {r["node"]: r["label"] for r in components(simhash.links(df, "fp", 3, leaf)).collect()}
        groups = {}
        for p, true in zip(points.view(np.int64).tolist(), label.tolist()):
            groups.setdefault(true, set()).add(found.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.deduplicate(docs).collect() == []
