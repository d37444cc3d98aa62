"""Texts with very many matches, lines and windows: time and memory that grow with the text alone."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from paperflow.llm import line_dedup, packing, pii, quality_rules, substring_dedup


def test_many_matches_in_one_text(spark):
    text = "".join(f"write to user{k}@example.org, or 10.0.{k % 256}.{k // 256 % 256};\n" for k in range(16_000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.cd"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert time.time() - began < 60
    assert (got[1].n_email, got[1].n_ip, got[2].n_email, got[3].n_email) == (16_000, 16_000, 1, 0)
    spans = sorted([(m.start(), 0, m.end()) for m in re.finditer(r"[a-z0-9]+@example\.org", text)] + [(m.start(), 1, m.end()) for m in re.finditer(r"(?<= )10\.[0-9.]+", text)])
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{('email', 'ip')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs.where("doc_id <> 3")).collect()}
    assert clean[2] == "[EMAIL]" and clean[1].count("[EMAIL]") == clean[1].count("[IP]") == 16_000


def test_many_lines_in_one_text(spark):
    text = "\n".join(f"line number {k} of this text" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nand one more line")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, removed="removed").collect()}
    assert time.time() - began < 90
    assert got[1].text == text and got[2].text == "" and got[2].removed["lines"] == 100_000 and 0 < got[3].removed["lines"] <= 100_000


def test_one_very_long_text(spark):
    text = " ".join(f"word{k % 50_000}" for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    found, into = substring_dedup.dedup_substrings(docs, carry=["doc_id"], hashed=True)
    got = {r.doc_id: (r[into]["n_words"], r[into]["n_removed"]) for r in found.collect()}
    assert got == {1: (200_000, 0), 2: (100_000, 100_000)}
    assert packing.best_fit(docs).count() > 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs, labels).collect()} == {1: 200_000, 2: 100_000}
