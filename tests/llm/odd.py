"""Small tables with every case that the operators define, and plain versions of what they compute."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(seed=1, n=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["été", "Straße", "ñu", "😀x", "don't", "a,b"]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(n)]


def documents(seed=2, n=60):
    """(doc_id, text, lang, source, n_chars, fingerprint): nulls, blanks, copies, shared passages, one very long text, and a clashing column."""
    rng, shared = random.Random(seed), passages()
    texts = [None, "", " \t\n\r ", "one", "Word " * 12, "\n\n\n", "x" * 5000]
    while len(texts) < n:
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.randrange(max(1, len(p) - 60))
                parts.append(" ".join(p[a : a + rng.randint(5, 110)]))
            else:
                parts.append(" ".join(f"u{rng.randrange(4000)}" for _ in range(rng.randint(3, 80))))
        texts.append(rng.choice(["\n", " ", "\t \n"]).join(parts))
    texts += texts[7:15]
    texts.append("\n".join(" ".join(rng.choice(shared)) for _ in range(400)))
    rows = [(k if k != 9 else None, t, rng.choice(["en", "de", None]), f"s{k % 4}", 0, "clash") for k, t in enumerate(texts)]
    return [*rows, rows[20], rows[20]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
