"""Texts longer than a suffix array can place get the results that a larger one gives."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from paperflow.llm import decontamination


@pytest.mark.parametrize("window", [1, 4, 13])
def test_long_texts_and_blocks(monkeypatch, window):
    rng = random.Random(window)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))) for k, n in enumerate([60, 90, 2, 13, 1, 200])]
    body = []
    while len(body) < 3000:
        words = rng.choice(items)[1].split()
        a = rng.randrange(len(words))
        body += words[a:] + [f"u{rng.randrange(500)}" for _ in range(rng.randrange(9))]
    texts = pa.array([" ".join(body), "a", " ".join(body[:70]), None, *[" ".join(body[k : k + 25]) for k in range(9)], " ".join(body[::-1] + body[:400])])
    index = decontamination.Suffixes.of(items, window)
    want = decontamination.scan_batch(index, texts, 20).to_pylist()
    assert max(len(r["matches"]) for r in want) > 50
    monkeypatch.setattr(decontamination, "PLACE_BITS", 6)
    monkeypatch.setattr(decontamination, "PLACE", 63)
    got = decontamination.scan_batch(index, texts, 20).to_pylist()
    order = lambda rows: [r | {"matches": sorted(tuple(m.values()) for m in r["matches"])} for r in rows]
    assert order(got) == order(want)
    summary = [{"n_words": r["n_words"], "n_hit": r["n_hit"], "n_items": len(r["items"]), "items_sha256": hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), "contaminated": r["contaminated"]} for r in want]
    assert decontamination.summarise_batch(index, texts, 20).to_pylist() == summary
    half = [decontamination.Suffixes.of(items[k::2], window) for k in range(2)]
    before = decontamination.kept_batch(half[1], texts).to_pylist()
    assert decontamination.summarise_batch(half[0], texts, 20, before).to_pylist() == summary


def test_many_items_with_one_window():
    """5,000 items open with the same 13 words, as do 20,000 documents; a further item is one common word."""
    opening = "choose the correct answer to each of the following questions about the text"
    items = [(k, f"{opening} item{k}") for k in range(5000)] + [(9999, "the")]
    index = decontamination.Suffixes.of(items, 13)
    assert len(index.ids) == 1 + 5000 + 1
    texts = pa.array([f"{opening} and so on {k}" for k in range(20_000)] + ["the " * 1000, "nothing here"])
    tracemalloc.start()
    got = decontamination.summarise_batch(index, texts, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20 and got.nbytes < 4 << 20
    rows = got.to_pylist()
    every = ",".join(sorted(str(k) for k in [*range(5000), 9999]))
    assert rows[0] == rows[777] | {"n_words": rows[0]["n_words"]} and rows[0]["n_items"] == 5001 and rows[0]["items_sha256"] == hashlib.sha256(every.encode()).hexdigest()
    assert (rows[0]["n_hit"], rows[20_000]["n_hit"], rows[20_000]["n_items"], rows[20_001]["n_items"]) == (13, 1000, 1, 0)
