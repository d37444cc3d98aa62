"""Token counts against the tokenizer on whole texts, with chunks so small that junctions abound."""

import random

import public_tokenizers
import pytest
import sentencepiece
from odd import SCHEMA, documents
from pyspark.sql import functions as F

from paperflow.llm import token_counts


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def odd_texts(seed=4):
    rng = random.Random(seed)
    pieces = ["the ", "  ", "\n", "▁", "ﬁ½", "👩‍👧", "𐍈𐍉", "<s>", "</s>", "<0x41>", "é", "é", "\x00", "internationalisation", "aaaaaaaa", "12345", "— ", "ab", "日本語"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 700))) for _ in range(60)]


@pytest.mark.parametrize("chunk,overlap", [(64, 2), (97, 24), (1024, 128)])
def test_counts_are_the_tokenizers(spark, model, chunk, overlap):
    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = documents(n=30) + [(500 + k, t, None, None, None, None) for k, t in enumerate(odd_texts())]
    rows += [(900, "a" * 5000, None, None, None, None), (901, " " * 3000, None, None, None, None), (902, "é" * 2999 + "x" * 40, None, None, None, None), (None, rows[-1][1], None, None, None, None), rows[-2], rows[-2]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("key", "n", "counted", "counted_text", "total", "salt")}).repartition(4)
    found, into = token_counts.count_tokens(docs, model, chunk=chunk, overlap=overlap)
    assert found.columns == [*docs.columns, into] and into == "counted_"
    got = found.collect()
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        text = r["text"] or ""
        assert (r[into]["n_bytes"], r[into]["n_tokens"]) == (len(text.encode()), len(whole.encode(text))), text[:60]


def test_overlaps_widen_only_where_alignment_fails(spark, model):
    shared = spark.sparkContext.broadcast(model)
    rng = random.Random(1)
    words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(800))
    texts = spark.createDataFrame([("words", words), ("letters", "a" * 4000)], "key string, text string")
    first = {r["key"]: r["open"] for r in token_counts.joined_counts(texts, shared, 253, 32).collect()}
    assert first == {"words": False, "letters": True}
    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    done = {r["key"]: r["n"] for r in token_counts.long_counts(texts, shared, 253, 32).collect()}
    assert done == {"words": len(whole.encode(words)), "letters": len(whole.encode("a" * 4000))}


def test_copies_of_a_long_text_are_encoded_once(spark, model):
    long = " ".join(f"word{k}" for k in range(3000))
    docs = spark.createDataFrame([(k, long) for k in range(200)] + [(k, "short") for k in range(200, 220)], "doc_id long, text string")
    found, into = token_counts.count_tokens(docs, model, carry=["doc_id"], chunk=2048)
    n = len(sentencepiece.SentencePieceProcessor(model_proto=model).encode(long))
    assert {r[into]["n_tokens"] for r in found.where("doc_id < 200").collect()} == {n} and found.count() == 220


def test_no_rows_and_bad_settings(spark, model):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(docs, model)[0].collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, model, chunk=10, overlap=6)
