"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most `chunk` bytes is counted by the tokenizer as it is. A longer one is cut into chunks of `chunk` code
points, each reaching `overlap` code points into the next, and dealt over all tasks; each chunk is encoded with
offsets. Of two neighbouring chunks the left one is kept up to a boundary and the right one from there on, if the
boundary is proven stable; where the overlap has none, the text is cut anew with four times the overlap, until it has
one or the text is a single chunk.

What is proven: byte-pair merging takes the best of all adjacent pairs (by score, then leftmost) until none is in the
vocabulary. Seen from a span that no merge has crossed, the merges within it come in the order in which they come if
the span stands alone. So if a text's tokens have a boundary between u and v, then u and v side by side do not merge
across it, and neither do a text that ends in token u and one that begins with token v when joined, since up to a
first merge across the boundary both sides run as they would alone. A boundary is taken where both chunks have the
same token v, with a token u before it in the left one: the left tokens up to v and the right ones from v on are then
the tokens of the joined text. The beginning that the tokenizer puts before a chunk is part of what stands left of v
in the right chunk, which is dropped. This holds for sentencepiece's BPE models that do not normalise (checked by
`require_plain`), characters that fall back to bytes being one symbol.

Copies of a long text are counted once. Chunks have bounded size, are told from copies by (digest, number) and spread
by both, so that neither a huge text nor a group of copies lies in one task.

Defined cases: a null text has no bytes and no tokens, as has an empty one; repeated rows, and rows without id, are
counted like any other; an empty table gives an empty result; input columns may have any names. A text without any
stable boundary (one letter repeated, say) ends as a single chunk, which is what the tokenizer alone would take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import durable, free_name, join_totals

CHUNK, OVERLAP, WIDEN = 1 << 15, 256, 4
#: Bytes of text that go to the tokenizer in one call.
CALL = 1 << 22
_LOADED: dict[int, sentencepiece.SentencePieceProcessor] = {}


def tokenizer(model: Broadcast | bytes) -> sentencepiece.SentencePieceProcessor:
    """The tokenizer of a model file's bytes, loaded once in a worker."""
    proto = model if isinstance(model, bytes) else model.value
    key = hash(proto)
    if key not in _LOADED:
        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return _LOADED[key]


def require_plain(model: bytes) -> None:
    """ValueError if the model changes more of a text than blanks."""
    probe = "  ﬁ½é　\t x\n​ A"
    if tokenizer(model).normalize(probe).lstrip("▁") != probe.replace(" ", "▁").lstrip("▁"):
        raise ValueError("only models that do not normalise texts can be counted in chunks")


def units(encoded: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of tokens before) of each symbol run with a place of its own: a token, or the bytes of one character."""
    begins = np.array([b for b, _ in encoded["offsets"]], dtype=np.int64)
    first = np.flatnonzero(np.diff(begins, prepend=-1))
    starts = begins[first]
    ends = np.append(starts[1:], encoded["offsets"][-1][1] if len(begins) else 0)[: len(starts)]
    return starts, ends, first


def cut(key: str, text: str, chunk: int, overlap: int) -> Iterator[tuple[str, int, int, bool, str]]:
    """(key, number, place, whether it is the last, chunk) of each chunk of a text."""
    n = max(1, -(-len(text) // chunk))
    for k in range(n):
        yield key, k, k * chunk, k == n - 1, text[k * chunk : (k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk :]


SIDE = "array<struct<start:bigint,end:bigint,beyond:bigint>>"


def summary(key: str, number: int, place: int, last: bool, chunk: str, model: Broadcast | bytes, size: int) -> Iterator[tuple]:
    """(key, junction, tokens, left, right): the tokens of a chunk (junction -1), and what it has in its two overlaps.

    `left` is the left side of the junction after the chunk: each run and the tokens from it on. `right` is the right side of the one before: each run and the tokens before it."""
    encoded = tokenizer(model).encode(chunk, return_type="offset_mapping")
    starts, ends, before = units(encoded)
    total = len(encoded["ids"])
    yield key, -1, total, None, None
    if not last:
        at = np.flatnonzero((starts >= size) & (before > 0))
        yield key, number, None, [(int(starts[k]) + place, int(ends[k]) + place, total - int(before[k])) for k in at], None
    if number:
        at = np.flatnonzero((starts > 0) & (ends <= len(chunk)))
        yield key, number - 1, None, None, [(int(starts[k]) + place, int(ends[k]) + place, int(before[k])) for k in at]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def joined_counts(texts: DataFrame, model: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(key, n, open) for (key, text): the tokens of each text, and whether a junction without a stable boundary is left."""
    pieces_schema, sums_schema = "key string, number int, place bigint, last boolean, chunk string", f"key string, junction int, tokens bigint, left {SIDE}, right {SIDE}"
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("beyond", pa.int64())]))
    pieces_arrow = pa.schema([("key", pa.string()), ("number", pa.int32()), ("place", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())])
    sums_arrow = pa.schema([("key", pa.string()), ("junction", pa.int32()), ("tokens", pa.int64()), ("left", run), ("right", run)])

    def pieces(batches):
        return _batches((piece for key, text in _rows(batches) for piece in cut(key, text, chunk, overlap)), pieces_arrow, 64)

    def sums(batches):
        reach = chunk + 2 * overlap

        def rows():
            for key, number, place, last, text in _rows(batches):
                for row in summary(key, number, place, last, text, model, chunk):
                    # of the right side only what lies in the overlap can meet the left side
                    yield (*row[:4], [r for r in row[4] if r[1] <= place + overlap] if row[4] is not None else None)

        return _batches(rows(), sums_arrow, max(1, (64 << 15) // reach))

    found = texts.mapInArrow(pieces, pieces_schema).dropDuplicates(["key", "number"]).mapInArrow(sums, sums_schema)
    met = found.groupBy("key", "junction").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"), F.max("right").alias("right"))

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"))

    first = F.get(F.array_intersect(F.transform("left", span), F.transform("right", span)), F.lit(0))
    met = met.select("key", "junction", "tokens", "left", "right", first.alias("at"))

    def beyond(side: str) -> Column:
        return F.get(F.filter(side, lambda x: x["start"] == F.col("at.start")), F.lit(0))["beyond"]

    n = F.when(F.col("junction") < 0, F.col("tokens")).otherwise(-(beyond("left") + beyond("right")))
    return met.select("key", n.alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("open"))


def long_counts(texts: DataFrame, model: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(key, n) for (key, text), the overlap widened for the texts that need it."""
    done, rest = None, texts
    while True:
        found = durable(joined_counts(rest, model, chunk, overlap))
        good = found.where(~F.col("open")).select("key", "n")
        done = good if done is None else done.unionByName(good)
        again = found.where("open").select("key")
        if again.isEmpty():
            return done
        rest = texts.join(again, "key", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)


def count_tokens(docs: DataFrame, model: bytes, *, text: str = "text", carry: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, str]:
    """The columns `carry` (all if None) of every row with a column of (n_bytes, n_tokens), and that column's name. `model` is the content of a sentencepiece BPE file."""
    require_plain(model)
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("a chunk must hold two overlaps")
    carry = docs.columns if carry is None else carry
    into, key, body = (free_name([*carry, *docs.columns], c) for c in ("counted", "counted_key", "counted_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, half a megabyte
    rows = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias(body))
    counted = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            tokens, a = np.zeros(len(sizes), dtype=np.int64), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + CALL, "right")))
                tokens[a:b] = [len(x) for x in tokenizer(shared).encode(texts.slice(a, b - a).to_pylist(), num_threads=1, return_type="numpy")]
                a = b
            both = pa.StructArray.from_arrays([pa.array(sizes), pa.array(tokens)], names=["n_bytes", "n_tokens"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names=[*batch.schema.names[:-1], into])

    is_long = F.octet_length(body) > chunk
    schema = T.StructType([*docs.select(*carry).schema.fields, T.StructField(into, counted)])
    plain = rows.where(~is_long).mapInArrow(short, schema)
    digest = F.sha2(F.col(body).cast("binary"), 256)
    totals = long_counts(rows.where(is_long).select(digest.alias("key"), F.col(body).alias("text")), shared, chunk, overlap)
    named = rows.where(is_long).select(*carry, F.octet_length(body).cast("long").alias(body), digest.alias(key))
    found = join_totals(named, totals.select(F.col("key").alias(free_name(named.columns, "total_key")), F.col("n").alias(free_name(named.columns, "total"))), key)
    total = F.col(found.columns[-1])
    return plain.unionByName(found.select(*carry, F.struct(F.col(body).alias("n_bytes"), total.alias("n_tokens")).cast(counted).alias(into))), into
