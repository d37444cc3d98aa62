"""Stages against plain versions on a small corpus; packing by its invariants; models by held-out accuracy."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from odd import ITEM_WORDS, SCHEMA, WORDS, documents, lowered, passages, save
from test_line_dedup import plain_chunks
from test_simhash import plain_components, plain_fingerprint

from paperflow.llm import packing, quality_classifier, toxicity, transducers
from paperflow.llm.common import table


def corpus():
    rng = random.Random(7)
    docs = [d for d in documents(n=50) if d[0] is not None]
    docs = list({d[0]: d for d in docs}.values())
    for k in range(60):
        line = [f"v{rng.randrange(3000)}" for _ in range(40)]
        line.insert(5, "you idiot" if k % 3 == 0 else "and so")
        docs.append((1000 + k, " ".join(line) + ".\nsecond line " + str(k), "en", "s", 0, "clash"))
    return docs


def check_packed(rows, words, permitted=packing.LENGTHS):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["bin"] is None:
            assert words[r["doc_id"]] == 0
            continue
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        bins[r["bin"]].append((r["offset"], r["n_tokens"], r["sequence_length"]))
    for doc, n in words.items():
        at = 0
        for start, size in sorted(pieces[doc]):
            assert start == at
            at += size
        assert at == n
    for placed in bins.values():
        at = 0
        for offset, size, _ in sorted(placed):
            assert offset == at
            at += size
        (length,) = {x[2] for x in placed}
        assert length == min(c for c in permitted if c >= at)


def test_stages(spark, tmp_path):
    docs = corpus()
    labels = [(d[0], 1, int("idiot" in (d[1] or ""))) for d in docs]
    items = [(k, " ".join(p[:40])) for k, p in enumerate(passages()[:4])]
    folder = save(spark, tmp_path, documents=(docs, SCHEMA), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(items, "item_id long, text string"))
    now, texts = table(spark, folder, "documents"), {d[0]: d[1] for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if name == "toxicity":
            texts = {i: t for i, t in texts.items() if "idiot" not in (t or "")}
        elif name == "line_dedup":
            first, cut = {}, {}
            for i in sorted(texts):
                if texts[i] is not None:
                    kept = []
                    for n, c in enumerate(plain_chunks(texts[i])):
                        body = "\n".join(c)
                        if sum(bool(WORDS.search(x)) for x in c) < 2 or first.setdefault(body, (i, n)) == (i, n):
                            kept.append(body)
                    cut[i] = "\n".join(kept)
                else:
                    cut[i] = None
            texts = cut
        elif name == "near_dedup":
            ids = sorted(texts)
            of = plain_components(ids, [plain_fingerprint(texts[i]) for i in ids])
            texts = {i: texts[i] for i, c in zip(ids, of, strict=True) if i == c}
        elif name == "decontamination":
            windows = {tuple(w[i : i + 13]) for _, t in items for w in [ITEM_WORDS.findall(lowered(t))] for i in range(len(w) - 12)}

            def dirty(t):
                words, hit = ITEM_WORDS.findall(lowered(t)), set()
                for i in range(len(words) - 12):
                    if tuple(words[i : i + 13]) in windows:
                        hit.update(range(i, i + 13))
                return bool(hit) and 20 * len(hit) >= len(words)

            texts = {i: t for i, t in texts.items() if not dirty(t)}
        if k == len(corpus_pipeline.STAGES) - 1:
            check_packed(out.collect(), {i: len(WORDS.findall(t or "")) for i, t in texts.items()})
            break
        assert out.columns == now.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == texts, name
        now = out
    run = corpus_pipeline.run(spark, folder)
    check_packed(run.collect(), {i: len(WORDS.findall(t or "")) for i, t in texts.items()})


def test_packing(spark):
    docs = spark.createDataFrame([*documents(n=80), (7, "w " * 9000, "en", "s", 0, "")], SCHEMA).where("doc_id is not null").dropDuplicates(["doc_id"])
    words = {r["doc_id"]: len(WORDS.findall(r["text"] or "")) for r in docs.collect()}
    for shard in (1 << 22, 3000):
        check_packed(packing.best_fit(docs, permitted=(64, 256, 1000), shard_tokens=shard).collect(), words, (64, 256, 1000))
    assert packing.best_fit(docs.limit(0)).collect() == []


def plain_cost(rows, cost=packing.sequence_cost):
    return sum(cost(c) for c in {r["bin"]: r["sequence_length"] for r in rows if r["bin"] is not None}.values())


def test_packing_without_and_with_repeated_ids(spark):
    docs = [(None, "a b c"), (None, "a b c"), (None, "d " * 70), (4, "e " * 300), (4, "e " * 300), (4, "f"), (5, None), (5, None)]
    for shard in (1 << 22, 100):
        got = packing.best_fit(spark.createDataFrame(docs, "doc_id long, text string"), permitted=(64, 256), shard_tokens=shard).collect()
        want = Counter()
        for i, t in docs:
            n = len((t or "").split())
            want.update([(i, 0, 0)] if not n else [(i, a, min(256, n - a)) for a in range(0, n, 256)])
        assert Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in got) == want
        used = Counter()
        for r in got:
            if r["bin"] is not None:
                used[r["bin"], r["sequence_length"]] += r["n_tokens"]
        assert all(n <= c and c == min(x for x in (64, 256) if x >= n) for (_, c), n in used.items())


def cheapest(pieces, permitted, cost):
    """By trial of all ways to share pieces out."""
    best = [float("inf")]

    def put(k, bins):
        now = sum(cost(min(c for c in permitted if c >= b)) for b in bins)
        if now >= best[0]:
            return
        if k == len(pieces):
            best[0] = now
            return
        for j in range(len(bins)):
            if bins[j] + pieces[k] <= max(permitted):
                put(k + 1, [*bins[:j], bins[j] + pieces[k], *bins[j + 1 :]])
        put(k + 1, [*bins, pieces[k]])

    put(0, [])
    return best[0]


def total_cost(lengths, permitted, cost, how):
    where, _, sizes = how(np.array(lengths), permitted, cost)
    used = np.bincount(where, weights=lengths)
    assert (used <= sizes).all()
    return sum(cost(int(c)) for c in sizes)


def test_packing_costs_near_the_least_and_no_more_than_any_mix():
    rng, permitted, cost = random.Random(1), (16, 32, 64, 128), lambda c: 4 + c + c * c / 1024
    ratios = []
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randint(1, 128), rng.randint(1, 30)]) for _ in range(7)), reverse=True)
        ratios.append(total_cost(lengths, permitted, cost, packing.pack_jointly) / cheapest(lengths, permitted, cost))
    assert max(ratios) < 1.2 and sum(ratios) / len(ratios) < 1.03
    for low, high in ((1, 128), (60, 70), (43, 44), (30, 34), (20, 25), (65, 128)):
        lengths = sorted((rng.randint(low, high) for _ in range(300)), reverse=True)
        got = total_cost(lengths, permitted, cost, packing.pack_jointly)
        for mix in ((128,), (64, 128), (16, 128), (32, 64, 128), permitted):
            assert got <= total_cost(lengths, mix, cost, packing.pack) + 1e-6
    # pieces of 1,500 tokens: two waste a quarter of 4,096, five fill 8,192
    assert set(packing.pack_jointly(np.full(50, 1500))[2].tolist()) == {8192}
    assert set(packing.pack_jointly(np.full(3, 900))[2].tolist()) <= {1024, 2048, 4096}


def plain_events(symbols, negated=toxicity.NEGATION_REACH, reach=toxicity.TARGET_REACH):
    out = Counter()
    for k, s in enumerate(symbols):
        if s in "IJT":
            if "R" in symbols[:k]:
                out[s + "r"] += 1
            elif "N" in symbols[max(0, k - negated) : k]:
                out[s + "n"] += 1
            elif "Y" in symbols[max(0, k - reach) : k + reach + 1]:
                out[s + "t"] += 1
            else:
                out[s] += 1
    return out


def test_composed_transducers_against_their_definition():
    rng = random.Random(2)
    machine = transducers.Machine(transducers.grammar(toxicity.NEGATION_REACH, toxicity.TARGET_REACH))
    for _ in range(4000):
        symbols = rng.choices("IJTYNR-", weights=[3, 2, 2, 2, 1, 0.3, 6], k=rng.randint(0, 14))
        assert Counter(machine.run(symbols)) == plain_events("".join(symbols)), symbols


def test_toxicity_grammar_and_held_out(spark):
    grammar = toxicity.Grammar(toxicity.lexicon(), tuple(toxicity.PRIOR))
    kinds = {"you are an idiot": ["It"], "what an idiot": ["I"], "he is not an idiot": ["In"], "this is no idiot": ["In"], "they said idiot": ["Ir"], "kill it": ["T"], "i will kill you": ["Tt"], "clean words": []}
    for clause, want in kinds.items():
        assert grammar.events(clause) == want, clause
    # matched clauses, wherever in a text
    text = "Nothing here. " * 50 + "You are an idiot; they said so\nnot an idiot! stupid"
    counts = np.round(2 ** grammar.features(pa.array([text, None, ""])) - 1, 6)
    assert {e: c for e, c in zip(toxicity.EVENTS, counts[0]) if c} == {"It": 1, "In": 1, "I": 1} and not counts[1:].any()
    docs = [d for d in corpus() if d[0] >= 1000]
    df = spark.createDataFrame([*docs, (1, None, "en", "s", 0, ""), (2, "", "en", "s", 0, "")], SCHEMA)
    labels = spark.createDataFrame([(d[0], int("idiot" in d[1])) for d in docs], "doc_id long, toxic int")
    found, into = toxicity.score(df, toxicity.train(df, labels))
    got = {r["doc_id"]: r[into] for r in found.collect()}
    assert all((got[d[0]] >= 0.5) == ("idiot" in d[1]) for d in docs) and got[1] == got[2] < 0.5
    none = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df.limit(0), none)[0].collect() == []


def test_quality_classifier(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(60)) if k % 4 else "###$$$ " * 20, "en" if k % 5 else None, f"s{k % 3}", 0, "") for k in range(200)] + [(999, None, None, None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 200, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == 201 and all(got[k]["kept"] == (k % 4 > 0) for k in range(200))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []
    assert quality_classifier.classify(docs, labels.limit(0)).count() == 201
