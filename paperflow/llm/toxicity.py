"""Toxicity by a weighted finite-state pattern grammar.

Transducers (`transducers`) are composed over the words of a clause: the lexical one turns words into symbols (strong
or weak insult, threat, target, negation, report), the next carries negation over `NEGATION_REACH` words, the next
reported speech to the end of its clause, and the last joins targets within `TARGET_REACH` words. They write one
event for each matched insult or threat: plain, targeted, negated or reported. A text's score is the logistic of the weights of
its events, damped by their number and held against the text's length, so it is matched clauses that count, not
isolated words.

Weights are fitted by penalised logistic regression about stated prior weights. The insults are those of the seed
list and the words and beginnings of words that labels show to be one, by a lower bound of their likelihood ratio:
strong above `STRONG`, weak above `WEAK`. Both come from at most `max_train` labelled rows outside the held-out fold
(crc32 of the id as text, mod 5, is 0). Every document is scored over its whole text; id, language, source and labels
are no inputs of the score.

Defined cases: null and empty texts have no event and score as the intercept says; rows without id count as not held
out; repeated rows score alike; labels that are null are left out, and of several labels of a document the larger
counts; without labels of both kinds the prior weights stand; input columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperflow.llm.common import durable, free_name
from paperflow.llm.transducers import Machine, grammar

# The seed lexicon.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic scum worthless trash disgusting clown clowns imbecile dumb fool vermin filth".split()
THREATS = "kill hurt destroy beat shoot stab hang burn attack murder".split()
TARGETS = "you your yours yourself u they them he she him her these those".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nobody neither nor without".split()
REPORTS = "said says say claimed claims called calls wrote writes quoted according reported told".split()
EVENTS = tuple(kind + mark for kind in "IJT" for mark in ("", "t", "n", "r"))
#: Prior weights of the events, of the text's length, and of the intercept.
PRIOR = np.array([3.0, 4.0, 1.0, 1.0, 2.0, 2.5, 0.5, 0.5, 0.5, 1.5, 0.0, 0.0, -0.3, -3.0])
NEGATION_REACH, TARGET_REACH = 3, 4
#: Lengths of learned beginnings; likelihood ratios above which an entry is a strong or a weak insult, by a bound of so many standard errors.
STEMS, STRONG, WEAK, ERRORS = (3, 4, 5, 6, 7, 8), 12.0, 3.0, 3.5
CLAUSE, TOKEN = re.compile(r"[.!?;\n]+"), re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@dataclass(frozen=True)
class Grammar:
    """The lexical transducer's entries (whole words, and beginnings of words) and the weights of the events."""

    symbols: dict[str, str]
    weights: tuple[float, ...]
    stems: dict[str, str] = field(default_factory=dict)

    def spotter(self) -> Callable[[str], list[int]]:
        """The places in a text in lower case where an insult or threat stands as a word or at a word's beginning."""
        automaton = ahocorasick.Automaton()
        for word, whole in [*((w, True) for w, s in self.symbols.items() if s in "IJT"), *((w, False) for w in self.stems)]:
            automaton.add_word(word, (len(word), whole))
        automaton.make_automaton()

        def spotted(text: str) -> list[int]:
            out = []
            for end, (n, whole) in automaton.iter(text):
                before, after = end - n, end + 1
                if (before < 0 or not text[before].isalnum()) and not (whole and after < len(text) and text[after].isalnum()):
                    out.append(before + 1)
            return out

        return spotted

    def symbol(self, word: str) -> str:
        """What the lexical transducer writes for a word; its own entry goes before that of its beginning."""
        return self.symbols.get(word) or next((self.stems[word[:n]] for n in STEMS if word[:n] in self.stems and len(word) >= n), "-")

    def events(self, clause: str, machine: Machine | None = None) -> list[str]:
        """One event for each insult or threat of a clause, by a run of the composed transducer."""
        machine = machine or Machine(grammar(NEGATION_REACH, TARGET_REACH))
        return machine.run(self.symbol(w) for w in TOKEN.findall(clause.lower()))

    def features(self, texts: pa.Array) -> np.ndarray:
        """Damped counts of the events of each text, and its damped length where it has any."""
        spotted, machine, at = self.spotter(), Machine(grammar(NEGATION_REACH, TARGET_REACH)), {e: k for k, e in enumerate(EVENTS)}
        out = np.zeros((len(texts), len(EVENTS) + 1))
        for row, text in enumerate(pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()):
            end = -1
            for place in spotted(text):
                if place < end:
                    continue
                start = end = max(end, 0)
                for cut in CLAUSE.finditer(text, start):  # the clause that holds the place
                    if cut.start() > place:
                        end = cut.start()
                        break
                    start = cut.end()
                else:
                    end = len(text)
                for event in self.events(text[start:end], machine):
                    out[row, at[event]] += 1
            if end >= 0:
                out[row, -1] = len(text) / 600
        return np.log2(1 + out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ np.array(self.weights[:-1]) + self.weights[-1])))


def lexicon(learned: dict[str, str] | None = None) -> dict[str, str]:
    words = dict(learned or {}) | dict.fromkeys(INSULTS, "I") | dict.fromkeys(THREATS, "T")
    return words | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R")


def chosen(counts: list[tuple[str, int, int, int, int]], bad: int, good: int) -> tuple[dict[str, str], dict[str, str]]:
    """(words, beginnings) with their symbols, of (entry, toxic and clean documents, capped occurrences in both); beginnings end with *.

    Entries go by the evidence they carry, whole words before beginnings and long before short ones where that is
    equal; an entry that another covers, or that covers one, adds nothing."""
    ranked = []
    for entry, p, n, hits, misses in counts:
        bound = math.log((hits + 1) / (bad + 1)) - math.log((misses + 1) / (good + 1)) - ERRORS * math.sqrt(1 / (p + 1) + 1 / (n + 1))
        if bound >= math.log(WEAK):
            ranked.append((-hits * bound, entry.endswith("*"), -len(entry), entry, "I" if bound >= math.log(STRONG) else "J"))
    words: dict[str, str] = {}
    stems: dict[str, str] = {}
    begun: set[str] = set()  # all beginnings of what was taken
    for *_, entry, symbol in sorted(ranked):
        bare = entry.rstrip("*")
        if any(bare[:k] in stems for k in range(1, len(bare) + 1)) or (entry != bare and bare in begun):
            continue
        (words if entry == bare else stems)[bare] = symbol
        begun.update(bare[:k] for k in range(1, len(bare) + 1))
    return words, stems


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 0.5, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method for the penalised likelihood about `prior`."""
    x, w = np.column_stack([x, np.ones(len(x))]), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (y - p) - strength * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 20_000) -> Grammar:
    """A grammar from at most `max_train` labelled rows (those of least hash, so the same ones each time) outside the held-out fold."""
    sample = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("sample_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("sample_id"), "sample_id").limit(max_train)
    rows = durable(docs.select(F.col(f"`{doc_id}`").alias("sample_id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(sample), "sample_id").select("y", "t"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Grammar(lexicon(), tuple(PRIOR))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(w for w in TOKEN.findall((t or "").lower()) if 2 < len(w) < 30 and not w.isdigit())
                begun: Counter[str] = Counter()
                for w, c in found.items():
                    for n in STEMS:
                        if len(w) >= n:
                            begun[w[:n] + "*"] += c
                found.update(begun)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([y] * len(found), pa.int32()), pa.array([min(3, c) for c in found.values()], pa.int32())], ["w", "y", "c"])

    bad, good = totals[1], totals[0]
    seen = rows.mapInArrow(words, "w string, y int, c int").groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.sum(F.col("y") * F.col("c")).alias("hits"), F.sum((1 - F.col("y")) * F.col("c")).alias("misses"))
    # an entry below this cannot pass the bound; what is left comes from the bounded sample
    likely = seen.where((F.col("p") >= 3) & (F.log((F.col("hits") + 1.0) / (bad + 1)) - F.log((F.col("misses") + 1.0) / (good + 1)) >= math.log(WEAK)))
    learned, stems = chosen([tuple(r) for r in likely.collect()], bad, good)
    found = Grammar(lexicon(learned), tuple(PRIOR), stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = found.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(measure, "y int, x array<double>").collect()
    return Grammar(found.symbols, fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float)), stems)


def score(docs: DataFrame, grammar: Grammar, *, text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns `carry` (all, if not given) with a score in 0..1; also that column's name."""
    carry = list(docs.columns) if carry is None else carry
    into, whole = free_name(carry, "toxicity"), free_name(docs.columns, "whole_text")
    df = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = grammar.scores(grammar.features(batch.column(len(carry))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(found)], [*carry, into])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carry), T.StructField(into, T.DoubleType())])), into


def reject(docs: DataFrame, labels: DataFrame, *, at: float = 0.5, **options) -> DataFrame:
    """`docs` that score below `at`."""
    found, into = score(docs, train(docs, labels, **options))
    return found.where(F.col(into) < at).drop(into)
