"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards, builds a word-level suffix array of each shard by prefix doubling, and
looks up every benchmark suffix by binary search, all suffixes at once. The slots found give the places where a
window of an item stands verbatim; neighbouring places on one diagonal join into the longest verbatim matches.
Matches are compared byte by byte before they count. The text is read once and nothing is shuffled. A benchmark of
more than `block_bytes` is broadcast in blocks, each of which is looked for in a pass over the texts; of all passes but
the last only hits and items are kept, and joined to the texts by two hashes.

A window that many items share is one pattern: each place counts it once, a document has a set of patterns, and the
items of equal sets are told once. So work and memory grow with places and with items, not with their product; the
longest matches with each item are listed on request alone.

Defined cases: a null text has no words and no hits; a null item text has no windows; an item without id is left
out; an item of fewer than `window` words is one window; items with one id count once; rows are judged one by one,
so repeated rows get equal results; an empty benchmark leaves everything clean; a text longer than a suffix
array can place is cut into several that overlap by `window` - 1 words, and matches across a cut are joined again. Input columns may have any names: what is added has a name that was free.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import ALNUM_LOWER, Hasher, blocks, buffers, durable, free_name, word_spans

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "n_words")]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
#: The same without pairs of documents and items: what grows with hits alone.
SUMMARY = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
ARROW_SUMMARY = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
#: What is kept of a text's hits in one block of the benchmark while others are looked for.
KEPT = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
ARROW_KEPT = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), ("items", pa.list_(pa.string()))])
#: Sets of patterns whose items are remembered in a worker.
REMEMBERED = 10_000
ARROW_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
        ("contaminated", pa.bool_()),
    ]
)
#: A word's id in a shard has 42 bits and a place 21, so that both sort as one integer.
ID_BITS, PLACE_BITS = 42, 21
PLACE = (1 << PLACE_BITS) - 1
SHARD_WORDS, HASH_BYTES = 1 << 20, 4 << 20
#: Texts with matches up to which they are broadcast when a benchmark has several blocks; beyond, they are joined by a shuffle.
BROADCAST_TEXTS = 20_000


def word_ids(counted: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """42-bit ids of words, above 0, which stands between documents."""
    return np.maximum((Hasher().words(counted, starts, ends)[0] >> np.uint64(64 - ID_BITS)).astype(np.int64), 1)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """The places of `seq` in the order of what follows there, by the first `depth` ids or more (a power of two)."""
    n = len(seq)
    key = np.sort((seq << PLACE_BITS) | np.arange(n))
    order, head = key & PLACE, np.ones(n, dtype=bool)
    head[1:] = (key[1:] >> PLACE_BITS) != (key[:-1] >> PLACE_BITS)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    known = 1
    while known < depth:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        key = np.sort((rank[at] << (2 * PLACE_BITS)) | (after << PLACE_BITS) | at)
        at, new = key & PLACE, np.ones(len(slots), dtype=bool)
        new[1:] = (key[1:] >> PLACE_BITS) != (key[:-1] >> PLACE_BITS)
        order[slots], head[slots] = at, new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        known *= 2
    return order


@dataclass
class Suffixes:
    """The suffixes of a block of benchmark items, each as its window: ids, lengths, and where it comes from."""

    ids: np.ndarray
    lengths: np.ndarray
    items: list[str] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    origins: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), dtype=np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str | None]], window: int) -> Suffixes:
        items, words, patterns, origins, rows_ = [], [], {}, [], []
        for item_id, text in rows:
            if item_id is None or not text:
                continue
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            counted, starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM_LOWER)
            if not len(starts):
                continue
            ids = word_ids(counted, starts, ends)
            line = counted.tobytes().split()
            length = min(window, len(line))
            for at in range(len(line) - length + 1):
                p = patterns.setdefault(b" ".join(line[at : at + length]), len(patterns))
                if p == len(rows_):
                    rows_.append(ids[at : at + length])
                origins.append((p, len(items), at))
            items.append(str(item_id))
            words.append(line)
        out = np.zeros((len(patterns), window), dtype=np.int64)
        for p, own in enumerate(rows_):
            out[p, : len(own)] = own
        lengths = np.array([len(own) for own in rows_], dtype=np.int64)
        by = np.array(sorted(origins), dtype=np.int64).reshape(-1, 3)
        return cls(out, lengths, items, words, by, np.searchsorted(by[:, 0], np.arange(len(patterns) + 1)))

    def pattern(self, p: int) -> list[bytes]:
        _, item, at = self.origins[self.first[p]].tolist()
        return self.words[item][at : at + int(self.lengths[p])]

    def items_of(self, patterns: Iterable[int]) -> list[str]:
        """The items that have one of these patterns, sorted as strings."""
        each = [self.origins[self.first[p] : self.first[p + 1], 1] for p in patterns]
        return sorted({self.items[k] for k in np.unique(np.concatenate(each)).tolist()}) if each else []

    def search(self, seq: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, patterns) of all verbatim windows, by binary search in the suffix array."""
        width = self.ids.shape[1]
        padded = np.concatenate([seq, np.zeros(width, dtype=np.int64)])
        steps, used = np.arange(width), np.arange(width)[None, :] < self.lengths[:, None]

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), dtype=np.int64), np.full(len(self.ids), len(order), dtype=np.int64)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                there, want = padded[order[mid][:, None] + steps], self.ids[open_]
                differs = (there != want) & used[open_]
                at = differs.argmax(axis=1)
                row = np.arange(len(open_))
                equal = ~differs[row, at]
                right = np.where(equal, after, there[row, at] < want[row, at])
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
            return low

        low, high = bound(False), bound(True)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        slots = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return order[slots], np.repeat(found, counts)


@dataclass
class Found:
    """What one document has of a block: the spans (start, words) of its hits, and the numbers of the patterns that stand there."""

    spans: list[tuple[int, int]]
    patterns: set[int]


def hits_of_shard(index: Suffixes, ids: np.ndarray, first: np.ndarray, line: list) -> dict[int, Found]:
    """For documents with hits. Each place of a pattern counts once, however many items have the pattern; `ids`, `first` and `line` as for `scan_shard`."""
    at, pattern, doc, base = places(index, ids, first)
    out: dict[int, Found] = {}
    by = np.lexsort((at, doc))
    at, pattern, doc = at[by], pattern[by], doc[by]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts.tolist(), len(doc)][1:], strict=True):
        d = int(doc[a])
        here, found = line[d](), Found([], set())
        for w, p in zip((at[a:b] - base[d]).tolist(), pattern[a:b].tolist(), strict=True):
            n = int(index.lengths[p])
            if here[w : w + n] == index.pattern(p):  # else two words share an id
                found.spans.append((w, n))
                found.patterns.add(p)
        if found.spans:
            found.spans = joined(found.spans)
            out[d] = found
    return out


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, words), spans that touch made one."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + n - out[-1][0]))
        else:
            out.append((start, n))
    return out


def hits_of_long(index: Suffixes, ids: np.ndarray, line: list[bytes]) -> Found:
    """The same of one document that is longer than a suffix array may be, in pieces that overlap by a window less one word."""
    width, most = index.ids.shape[1], PLACE - 1
    if most < width:
        raise ValueError(f"a window of {width} words is longer than a suffix array of {PLACE}")
    out = Found([], set())
    for at in range(0, len(ids), most - width + 1):
        piece = line[at : at + most]
        got = hits_of_shard(index, ids[at : at + most], np.array([0, len(piece)]), [lambda piece=piece: piece]).get(0)
        if got:
            out.spans = joined([*out.spans, *((w + at, n) for w, n in got.spans)])
            out.patterns |= got.patterns
    return out


def places(index: Suffixes, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, pattern, document) of every window in a shard, and where each document begins."""
    n_docs = len(first) - 1
    base = first[:-1] + np.arange(n_docs)
    if not len(ids) or not len(index.ids):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, base
    seq = np.zeros(len(ids) + n_docs, dtype=np.int64)
    seq[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(first))] = ids
    depth = 1 << (index.ids.shape[1] - 1).bit_length()
    at, pattern = index.search(seq, suffix_array(seq, depth))
    return at, pattern, np.searchsorted(base, at, "right") - 1, base


def scan_shard(index: Suffixes, ids: np.ndarray, first: np.ndarray, line: list) -> dict[int, tuple[list, list]]:
    """For documents with matches: ([(start, words) of hits], [(number of the item, item word, document word, words)]).

    ids: of all words; first: of each document, and one past the last; line[d]() gives a document's words."""
    at, pattern, doc, base = places(index, ids, first)
    if not len(at):
        return {}
    counts = index.first[pattern + 1] - index.first[pattern]
    rows = np.repeat(index.first[pattern] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    item, item_word = index.origins[rows, 1], index.origins[rows, 2]
    doc, at, length = np.repeat(doc, counts), np.repeat(at, counts), np.repeat(index.lengths[pattern], counts)
    word = at - base[doc]
    by = np.lexsort((word, word - item_word, item, doc))
    doc, word, item, item_word, length = doc[by], word[by], item[by], item_word[by], length[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] != word[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1)
    starts = np.flatnonzero(new)
    spans = length[starts] + np.diff(np.append(starts, len(doc))) - 1
    out: dict[int, tuple[list, list]] = {}
    words_of: dict[int, list[bytes]] = {}
    for d, w, i, iw, n, k in zip(*(x[starts].tolist() for x in (doc, word, item, item_word)), spans.tolist(), length[starts].tolist(), strict=True):
        if d not in words_of:
            words_of = {d: line[d]()}
        here, there = words_of[d], index.words[i]
        if here[w : w + n] == there[iw : iw + n]:
            runs = [(w, iw, n)]
        else:  # two words share an id: keep the windows that are equal
            good = [s for s in range(n - k + 1) if here[w + s : w + s + k] == there[iw + s : iw + s + k]]
            runs = [(w + s, iw + s, k) for s in good]
        hits, matches = out.setdefault(d, ([], []))
        for a, b, m in runs:
            hits.append((a, m))
            matches.append((i, b, a, m))
    return {d: x for d, x in out.items() if x[1]}


def covered(spans: list[tuple[int, int]]) -> int:
    """Words under the union of (start, words)."""
    total = end = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def scan_long(index: Suffixes, ids: np.ndarray, line: list[bytes]) -> list[tuple]:
    """The matches of one document, scanned in overlapping pieces; each window of `width` words starts in one piece alone."""
    width, most = index.ids.shape[1], PLACE - 1
    if most < width:
        raise ValueError(f"a window of {width} words is longer than a suffix array of {PLACE}")
    found: dict[tuple, tuple] = {}  # a window shorter than `width` may be seen twice
    cuts = set(range(most - width + 1, len(ids), most - width + 1))
    for at in [0, *sorted(cuts)]:
        piece = line[at : at + most]
        got = scan_shard(index, ids[at : at + most], np.array([0, len(piece)]), [lambda piece=piece: piece])
        for i, iw, w, n in got.get(0, ([], []))[1]:
            found.setdefault((i, w + at - iw, w + at, n), (i, iw, w + at, n))
    out: list[tuple] = []
    for i, iw, w, n in (found[k] for k in sorted(found)):
        if w in cuts and out and (out[-1][0], out[-1][2] - out[-1][1]) == (i, w - iw) and out[-1][2] + out[-1][3] == w + width - 1:
            out[-1] = (*out[-1][:3], w + n - out[-1][2])
        else:
            out.append((i, iw, w, n))
    return out


def each_document(texts: pa.Array, of_shard: Callable, of_long: Callable, put: Callable[[int, object], None]) -> None:
    """Calls `put` with the number of words and the finding (or None) of each text in turn, found in shards of texts or, of a longer text, alone."""
    raw, offsets = buffers(texts)
    ids, first, lines = [], [0], []

    def flush() -> None:
        nonlocal ids, first, lines
        if not lines:
            return
        found = of_shard(np.concatenate(ids), np.array(first), lines)
        for d in range(len(lines)):
            put(first[d + 1] - first[d], found.get(d))
        ids, first, lines = [], [0], []

    for a, b in blocks(offsets, HASH_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        counted, starts, ends, where = word_spans(raw[offsets[a] : offsets[b]], at, ALNUM_LOWER)
        got = word_ids(counted, starts, ends)
        line = [(lambda c=counted, s=at[d], e=at[d + 1]: c[s:e].tobytes().split()) for d in range(b - a)]
        whole = len(got) + (b - a) <= PLACE
        for c, d in [(0, b - a)] if whole else [(k, k + 1) for k in range(b - a)]:
            part = got[where[c] : where[d]]
            if lines and first[-1] + len(part) + len(lines) + (d - c) > min(SHARD_WORDS, PLACE):
                flush()
            if len(part) + (d - c) > PLACE:
                put(len(part), of_long(part, line[c]()))
                continue
            first.extend((where[c + 1 : d + 1] - where[c] + first[-1]).tolist())
            ids.append(part)
            lines.extend(line[c:d])
    flush()


def scan_batch(index: Suffixes, texts: pa.Array, share: int) -> pa.Array:
    """RESULT of each text: every match with every item, so output grows with pairs."""
    out: list[dict] = []

    def put(n: int, found: tuple[list, list] | list | None) -> None:
        matches = [(index.items[m[0]], *m[1:]) for m in (found[1] if isinstance(found, tuple) else found or [])]
        n_hit = covered([(m[2], m[3]) for m in matches])
        out.append({"n_words": n, "n_hit": n_hit, "items": sorted({m[0] for m in matches}), "matches": [dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in matches], "contaminated": n_hit > 0 and share * n_hit >= n})

    each_document(texts, partial(scan_shard, index), lambda ids, line: scan_long(index, ids, line) if len(index.ids) else [], put)
    return pa.array(out, type=ARROW_RESULT)


def summarise_batch(index: Suffixes, texts: pa.Array, share: int, before: list | None = None) -> pa.Array:
    """SUMMARY of each text. `before` has what other blocks of the benchmark found (KEPT or None) for each."""
    out: list[dict] = []
    known: dict[tuple, tuple[int, str]] = {}

    def told(items: list[str]) -> tuple[int, str]:
        return len(items), hashlib.sha256(",".join(items).encode()).hexdigest()

    def of_patterns(patterns: tuple[int, ...]) -> tuple[int, str]:
        if patterns not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[patterns] = told(index.items_of(patterns))
        return known[patterns]

    def put(n: int, found: Found | None) -> None:
        spans, patterns = (found.spans, tuple(sorted(found.patterns))) if found else ([], ())
        earlier = before[len(out)] if before is not None else None
        if earlier:
            spans = joined([*spans, *((x["start"], x["words"]) for x in earlier["spans"])])
            n_items, sha = told(sorted({*index.items_of(patterns), *earlier["items"]}))
        else:
            n_items, sha = of_patterns(patterns)
        n_hit = sum(n for _, n in spans)
        out.append({"n_words": n, "n_hit": n_hit, "n_items": n_items, "items_sha256": sha, "contaminated": n_hit > 0 and share * n_hit >= n})

    each_document(texts, partial(hits_of_shard, index), lambda ids, line: hits_of_long(index, ids, line) if len(index.ids) else None, put)
    return pa.array(out, type=ARROW_SUMMARY)


def kept_batch(index: Suffixes, texts: pa.Array) -> pa.Array:
    """KEPT of each text, null without hits."""
    out: list[dict | None] = []

    def put(n: int, found: Found | None) -> None:
        out.append({"spans": [{"start": a, "words": k} for a, k in found.spans], "items": index.items_of(found.patterns)} if found and found.spans else None)

    each_document(texts, partial(hits_of_shard, index), lambda ids, line: hits_of_long(index, ids, line) if len(index.ids) else None, put)
    return pa.array(out, type=ARROW_KEPT)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, block_bytes: int = 8 << 20, carry: list[str] | None = None, matches: bool = False) -> tuple[DataFrame, str]:
    """`docs` (or its columns `carry`) with one struct column of SUMMARY, or of RESULT if `matches` are asked for; also that column's name.

    A document is contaminated if some word is hit and `share` times the hit words reach all its words. `matches` lists each longest match with each item: its size is that of
    all pairs of matching documents and items, and its benchmark is one block."""
    carry = list(docs.columns) if carry is None else carry
    into = free_name(carry, "decontamination")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    sized = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = 1 if matches else int(sized // block_bytes) + 1
    whole = free_name(docs.columns, "whole_text")
    body = F.col(f"`{text}`")
    sc = docs.sparkSession.sparkContext

    def index(k: int):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k)
        return sc.broadcast(Suffixes.of(((r["i"], r["t"]) for r in block.toLocalIterator()), window))

    def matching(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = kept_batch(shared.value, batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], ["key_", "key2_", "found_"]).filter(pc.is_valid(got))

        return run

    before, df = None, docs.select(*[F.col(f"`{c}`") for c in carry], body.alias(whole))
    if n_blocks > 1:
        # all blocks but one are looked for in texts alone; what is kept of them is their hits and items, by two hashes of the text
        keys = (F.xxhash64(body).alias("key_"), F.xxhash64(F.lit("second"), body).alias("key2_"))
        schema = T.StructType([T.StructField("key_", T.LongType()), T.StructField("key2_", T.LongType()), T.StructField("found_", KEPT)])
        parts = [durable(docs.select(*keys, body.alias(whole)).mapInArrow(matching(index(k)), schema).dropDuplicates(["key_", "key2_"])) for k in range(1, n_blocks)]
        every = reduce(lambda x, y: x.unionByName(y), parts)
        names = [free_name([*docs.columns, whole], n) for n in ("key_", "key2_", "before_")]
        both = F.struct(F.flatten(F.collect_list("found_.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("found_.items"))).alias("items"))
        found = durable(every.groupBy("key_", "key2_").agg(both.alias("m"))).toDF(*names)
        if found.count() <= BROADCAST_TEXTS:
            found = F.broadcast(found)
        on = (F.xxhash64(body) == F.col(names[0])) & (F.xxhash64(F.lit("second"), body) == F.col(names[1]))
        before = free_name([*carry, whole], "before_")
        df = docs.join(found, on, "left").select(*[F.col(f"`{c}`") for c in carry], body.alias(whole), F.col(names[2]).alias(before))
    shared, last = index(0), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if matches:
                got = scan_batch(shared.value, batch.column(last), share)
            else:
                got = summarise_batch(shared.value, batch.column(last), share, batch.column(last + 1).to_pylist() if before else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(last)), got], [*carry, into])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carry), T.StructField(into, RESULT if matches else SUMMARY)])), into


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without those that are contaminated."""
    found, into = scan(docs, benchmark, **options)
    return found.where(~F.col(into)["contaminated"]).drop(into)


def digest(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    found, into = scan(docs, benchmark, carry=[doc_id], **options)
    got = F.col(into)
    return found.select(F.col(doc_id).alias("doc_id"), *[got[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])
