"""Dates and the four factors of a score. `today` is always given."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperflow.functions.identity import squeeze
from paperflow.functions.terms import SEPARATORS, Lexicon, strings, words_of
from paperflow.functions.text import is_jargon, tokens
from paperflow.functions.wordlists import EVERYDAY_DOMAINS
from paperflow.tables import let

# Lexicons and patterns.
OUTCOME_VERBS = (
    "reduced reduces reduction increased increases improved improves improvement lowered lowers raised raises prevented prevents prevention cured cures slowed slows "
    "accelerated doubled halved tripled predicted predicts detected detects detection restored restores protected protects delayed delays boosted boosts cut shortened "
    "shortens extended extends decreased decreases eliminated eliminates outperformed enabled enables caused causes triggered"
).split() + ["led to", "resulted in", "associated with", "linked to", "correlated with", "was followed by"]
SUBJECT_NOUNS = (
    "participants patients volunteers subjects children kids adolescents teenagers students pupils adults women men mothers infants babies elderly workers employees "
    "drivers households families consumers farmers nurses teachers residents mice rats dogs cats bees birds fish cattle pigs plants crops wheat maize soil rivers lakes "
    "forests cities towns schools hospitals homes buildings roads cars batteries phones"
).split() + ["older adults"]
METHOD_NOUNS = "framework architecture network model approach method methodology algorithm toolkit pipeline benchmark dataset corpus library formalism taxonomy".split()
THEORETICAL_MARKERS = [
    "we propose a framework", "we present a framework", "theoretical analysis", "we prove", "we derive", "theorem", "lemma", "corollary", "proof of", "asymptotic",
    "complexity bound", "convergence rate", "closed-form", "we formalise", "we formalize", "formalism", "axiom", "ablation study", "we introduce a novel architecture",
    "state-of-the-art results", "sota", "leaderboard", "benchmark suite", "we release a dataset", "taxonomy of", "position paper", "scoping review",
    "bibliometric analysis", "we survey", "this survey", "simulation study of estimators", "monte carlo simulation study", "we extend the model of",
    "methodological note", "protocol for a", "study protocol", "registered report protocol", "we compare estimators", "sensitivity analysis of methods", "in silico only",
]
QUANTIFIED = [
    r"[0-9]+(?:\.[0-9]+)?\s?%", r"(?iu)(?<!\p{L})p\s?[<=]\s?0?\.[0-9]+", r"(?<!\p{L})(?:OR|RR|HR|SMD|IRR)\s?[=:]\s?[0-9]", r"(?i)95\s?%\s?CI",
    r"(?iu)(?<![\p{L}\p{N}])n\s?=\s?[0-9]{2,}", r"(?iu)(?<![\p{L}\p{N}])[0-9]+(?:\.[0-9]+)?[-\s]fold(?!\p{L})",
    r"(?iu)(?<![\p{L}\p{N}])[0-9]+(?:\.[0-9]+)?\s?times\s+(?:higher|lower|more|less|greater|faster|slower)(?!\p{L})",
    r"(?iu)(?<!\p{L})(?:increase|decrease|reduction|improvement)\s+of\s+[0-9]", r"(?iu)(?<!\p{L})cohen['’]?s\s?d\s?[=:]",
]
#: A number of more than nine characters is read to its end.
REST = "(?:(?<! )[0-9,]{0,40}[0-9])?"
SAMPLE_SIZES = (
    rf"(?iu)(?<![\p{{L}}\p{{N}}])n\s?=\s?([0-9 ,]{{2,9}}{REST})",
    rf"(?iu)(?<![\p{{L}}\p{{N}}])([0-9][0-9 ,]{{1,8}}{REST})" r"\s+(?:participants|patients|subjects|respondents|individuals|adults|children|households|samples|animals|mice|records)(?!\p{L})",
)
#: What a text must have for each pattern of `QUANTIFIED`: a plain search or the first character, so that few places are looked at with look-arounds.
_HAS = ["%", "=<", "=:", "%", "=", None, None, None, "=:"]
_BEGINS = ["", "p", "[ORHSI]", "[0-9]", "n", "[0-9]", "[0-9]", "[idr]", "c"]
WEIGHTS = {"explainability": 0.4, "everyday_relevance": 0.28, "freshness": 0.18, "credibility": 0.14}


def term_pattern(term: str) -> str:
    """What `terms.Lexicon` finds, as a pattern: a term between non-letters, any dash or blank between its words, its last word in singular or plural."""
    return r"(?<!\p{L})" + f"[{SEPARATORS}]+".join(words_of(term)) + r"(?:s|es)?(?!\p{L})"


def begun(pattern: str, first: str) -> str:
    """The same pattern, which looks at the first character before all else."""
    flags, rest = re.fullmatch(r"((?:\(\?[iu]+\))?)(.*)", pattern, re.DOTALL).groups()
    return f"{flags}(?={first}){rest}" if first else pattern


def quantified(text: Column) -> Column:
    """Whether a text has any of `QUANTIFIED`."""

    def has(pattern: str, signs: str | None, first: str) -> Column:
        found = text.rlike(begun(pattern, first))
        return found if signs is None else reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs]) & found

    return reduce(lambda a, b: a | b, map(has, QUANTIFIED, _HAS, _BEGINS))


def hits(terms: list[str], title: Column, body: Column) -> Column:
    """array<struct<term, in_title>> of the terms that title or body, in lower case, has."""
    lexicon = Lexicon({"terms": terms})
    return let(F.struct(lexicon.found(title).alias("t"), lexicon.found(body).alias("b")), lambda x: lexicon.hits("terms", x["t"], x["b"]))


def weight_of(found: Column) -> Column:
    """2 for a hit in the title, 1 for another."""
    return F.aggregate(found, F.lit(0), lambda a, h: a + F.when(h["in_title"], 2).otherwise(1))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x.cast("double"), F.lit(0.0))))


def rounded(x: Column, places: int = 4) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def effective_date(published: Column, indexed: Column) -> Column:
    return F.greatest(published, indexed)


def age_in_days(published: Column, indexed: Column, today: Column) -> Column:
    date = effective_date(published, indexed)
    return F.when(date.isNotNull() & today.isNotNull(), F.greatest(F.lit(0), F.date_diff(today, date)))


def freshness(age: Column, days: int) -> Column:
    return F.when(age.isNull(), 0.0).otherwise(clamp((F.lit(days) - age) / float(days)))


def sample_size(text: Column) -> Column:
    """The largest stated number of cases, or null."""
    none = F.array().cast("array<string>")
    equals, counted = SAMPLE_SIZES
    # a null text has no size, as before
    raw = F.concat(F.when(~F.contains(text, F.lit("=")), none).otherwise(F.regexp_extract_all(text, F.lit(begun(equals, "n")), F.lit(1))), F.regexp_extract_all(text, F.lit(begun(counted, "[0-9]")), F.lit(1)))
    return F.array_max(F.filter(F.transform(raw, lambda d: F.regexp_replace(d, "[^0-9]", "").try_cast("bigint")), lambda n: n > 0))


def peer_review(preprint: Column, kind: Column, venue: Column) -> Column:
    k = F.lower(kind)
    early = F.coalesce(preprint, F.lit(False)) | F.coalesce(k.isin("preprint", "submitted-version"), F.lit(False))
    return F.when(early, 0.4).when((F.trim(F.coalesce(venue, F.lit(""))) != "") & (k.isNull() | (k == "article")), 1.0).otherwise(0.6)


def open_access(is_open: Column, licence: Column) -> Column:
    text = F.lower(F.coalesce(licence, F.lit("")))
    return F.when(~F.coalesce(is_open, F.lit(False)), 0.3).when(text.rlike(r"^cc[-\s]?") | text.contains("public-domain"), 1.0).otherwise(0.8)


def credibility(review: Column, n: Column, access: Column) -> Column:
    by_size = F.when(n.isNull(), 0.4).otherwise(clamp(F.log10(n.cast("double")) / 4))
    return clamp(0.4 * review + 0.25 * by_size + 0.2 * access + 0.15 * 0.3)


def texts(title: Column, abstract: Column, tldr: Column) -> Column:
    """struct<title, raw, note>: squeezed, null as empty."""
    return F.struct(squeeze(F.coalesce(title, F.lit(""))).alias("title"), squeeze(F.coalesce(abstract, F.lit(""))).alias("raw"), squeeze(F.coalesce(tldr, F.lit(""))).alias("note"))


def _matched(lexicon: Lexicon, x: Column, then) -> Column:
    """`then` of `texts` with what was found in them: `t` in the title, `b` in the abstract, `n` in the note. No term goes from one into the other."""
    lowered = F.struct(*[x[k].alias(k) for k in ("title", "raw", "note")], F.lower(x["title"]).alias("head"), F.lower(x["raw"]).alias("body"))
    found = lambda m: F.struct(*[m[k].alias(k) for k in ("title", "raw", "head")], lexicon.found(m["head"]).alias("t"), lexicon.found(m["body"]).alias("b"), F.when(m["note"] != "", lexicon.found(F.lower(m["note"]))).otherwise(F.expr("cast(array() as array<int>)")).alias("n"))
    return let(let(lowered, found), then)


def _explained(lexicon: Lexicon, m: Column, long_token: int, long_tokens: int, most_words: int) -> Column:
    """The struct of `explainability` from what was found."""

    def listed(m: Column) -> Column:
        every = F.array_union(m["b"], m["n"])
        return F.struct(*[m[k].alias(k) for k in ("title", "raw", "head")], *[lexicon.hits(k, m["t"], every).alias(k) for k in ("verbs", "nouns", "theory")], let(tokens(m["raw"]), lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, is_jargon)).alias("jargon"))).alias("words"))

    def measured(m: Column) -> Column:
        penalty = lambda why, by: F.struct(F.lit(why).alias("why"), F.lit(by).alias("by"))
        named = F.exists(m["verbs"], lambda h: h["in_title"]) | F.exists(m["nouns"], lambda h: h["in_title"])
        penalties = F.array_compact(F.array(
            F.when(m["head"].rlike(r":\s.*(?<!\p{L})(?:" + "|".join(METHOD_NOUNS) + r")(?!\p{L})"), penalty("method noun after a colon", 0.4)),
            F.when(~named, penalty("no verb or subject", 0.3)),
            F.when(F.size(F.filter(F.split(m["title"], r"\s+"), lambda w: w != "")) > most_words, penalty("many words", 0.2)),
            F.when(F.size(F.filter(tokens(m["title"]), lambda w: F.length(w) >= long_token)) >= long_tokens, penalty("long words", 0.2)),
        ))
        return F.struct(
            (F.least(weight_of(m["verbs"]), F.lit(4)) / 4).alias("v"), (F.least(weight_of(m["nouns"]), F.lit(4)) / 4).alias("s"), F.when(quantified(m["raw"]), 1.0).otherwise(0.0).alias("q"),
            clamp(F.aggregate(penalties, F.lit(1.0), lambda c, x: c - x["by"])).alias("c"), (F.least(weight_of(m["theory"]), F.lit(3)) / 3).alias("t"), clamp(F.when(m["words"]["n"] == 0, 0.0).otherwise(m["words"]["jargon"] / m["words"]["n"]) / 0.1).alias("j"),
            *[F.transform(m[k], lambda h: F.concat(h["term"], F.when(h["in_title"], " (title)").otherwise(""))).alias(k) for k in ("verbs", "nouns", "theory")], F.transform(penalties, lambda x: x["why"]).alias("penalties"),
            m["words"]["jargon"].alias("n_jargon"), m["words"]["n"].alias("n_tokens"),
        )

    def valued(x: Column) -> Column:
        value = clamp(0.35 * x["v"] + 0.25 * x["s"] + 0.2 * x["q"] + 0.2 * x["c"] - 0.45 * x["t"] - 0.15 * x["j"])
        return F.struct(value.alias("value"), *[x[k].alias(k) for k in ("v", "s", "q", "c", "t", "j", "verbs", "nouns", "theory", "penalties", "n_jargon", "n_tokens")])

    return let(let(listed(m), measured), valued)


def _touched(lexicon: Lexicon, m: Column, domains: dict[str, list[str]]) -> Column:
    """The struct of `everyday_relevance` from what was found; its domains are lists of the lexicon, one after the other."""
    named = [(d, lexicon.range_of(f"life:{d}")) for d in domains]
    if not any(first < end for _, (first, end) in named):
        none = F.array().cast("array<string>")
        return F.struct(F.lit(0.0).alias("value"), none.alias("domains"), none.alias("terms"))
    least = named[0][1][0]
    found = F.filter(F.array_sort(F.array_union(m["t"], m["b"])), lambda k: k >= least)
    of_term = strings(d for d, (first, end) in named for _ in range(first, end))
    listed = let(found, lambda f: F.struct(F.array_distinct(F.transform(f, lambda k: F.get(of_term, k - least))).alias("domains"), F.transform(f, lexicon.name).alias("terms")))
    return let(listed, lambda x: F.struct(clamp(0.8 * F.least(F.size(x["domains"]), F.lit(3)) / 3 + 0.2 * F.least(F.size(x["terms"]), F.lit(6)) / 6).alias("value"), x["domains"].alias("domains"), x["terms"].alias("terms")))


def _lexicon(verbs: list[str], nouns: list[str], theory: list[str], domains: dict[str, list[str]]) -> Lexicon:
    return Lexicon({"verbs": verbs, "nouns": nouns, "theory": theory, **{f"life:{d}": terms for d, terms in domains.items()}})


def explainability(title: Column, abstract: Column, tldr: Column, *, verbs: list[str] = OUTCOME_VERBS, nouns: list[str] = SUBJECT_NOUNS, theory: list[str] = THEORETICAL_MARKERS, long_token: int = 15, long_tokens: int = 2, most_words: int = 18) -> Column:
    """struct<value, v, s, q, c, t, j, verbs, nouns, theory, penalties, n_jargon, n_tokens>"""
    lexicon = _lexicon(verbs, nouns, theory, {})
    return let(texts(title, abstract, tldr), lambda x: _matched(lexicon, x, lambda m: _explained(lexicon, m, long_token, long_tokens, most_words)))


def everyday_relevance(title: Column, body: Column, domains: dict[str, list[str]] = EVERYDAY_DOMAINS) -> Column:
    """struct<value, domains, terms>: the domains that a text touches, in their order, and the terms that show it."""
    lexicon = _lexicon([], [], [], domains)
    return let(texts(title, body, F.lit("")), lambda x: _matched(lexicon, x, lambda m: _touched(lexicon, m, domains)))


def read(x: Column) -> Column:
    """struct<explain, everyday, n_cases> of `texts`: explainability, everyday relevance and stated cases, for which a text is squeezed, put in lower case and looked through once."""
    lexicon = _lexicon(OUTCOME_VERBS, SUBJECT_NOUNS, THEORETICAL_MARKERS, EVERYDAY_DOMAINS)
    return _matched(lexicon, x, lambda m: F.struct(_explained(lexicon, m, 15, 2, 18).alias("explain"), _touched(lexicon, m, EVERYDAY_DOMAINS).alias("everyday"), sample_size(m["raw"]).alias("n_cases")))


def total_score(weights: dict[str, float] = WEIGHTS, **factors: Column) -> Column:
    return rounded(reduce(lambda a, b: a + b, [F.lit(w) * factors[k] for k, w in weights.items()]))


GATE = 0.35


def evidence(score: Column, weights: dict[str, float] = WEIGHTS, gate: float = GATE) -> Column:
    """array<string>: why a row has its score, from a struct of total, explain, everyday, age, review, n_cases and access."""
    fixed = lambda x, places=2: F.format_number(x, places)
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("none")
    e, life = score["explain"], score["everyday"]
    sum_ = " + ".join(f"{w:.2f} x {k.replace('_', ' ')}" for k, w in weights.items())
    return F.array_compact(F.array(
        F.concat(F.lit("total "), fixed(score["total"], 4), F.lit(f" = {sum_}")),
        F.when(e["value"] >= gate, F.lit(f"passes the gate of {gate:.2f}")).otherwise(F.lit(f"below the gate of {gate:.2f}")),
        F.concat(F.lit("explainability "), fixed(e["value"])),
        F.concat(F.lit("outcome verbs (v "), fixed(e["v"]), F.lit("): "), listed(e["verbs"])), F.concat(F.lit("subjects (s "), fixed(e["s"]), F.lit("): "), listed(e["nouns"])),
        F.when(e["q"] == 1, F.lit("states a quantified effect")).otherwise(F.lit("states no number")), F.concat(F.lit("title (c "), fixed(e["c"]), F.lit("): "), F.when(F.size(e["penalties"]) > 0, F.array_join(e["penalties"], "; ")).otherwise("no penalty")),
        F.when(F.size(e["theory"]) > 0, F.concat(F.lit("theoretical markers (t "), fixed(e["t"]), F.lit("): "), listed(e["theory"]))),
        F.when(e["j"] > 0, F.concat(F.lit("jargon (j "), fixed(e["j"]), F.lit("): "), e["n_jargon"].cast("string"), F.lit(" of "), e["n_tokens"].cast("string"), F.lit(" tokens"))),
        F.concat(F.lit("everyday relevance "), fixed(life["value"]), F.lit(": "), listed(life["domains"])),
        F.concat(F.lit("age in days: "), F.coalesce(score["age"].cast("string"), F.lit("unknown"))),
        F.concat(F.lit("review "), fixed(score["review"]), F.lit(", access "), fixed(score["access"]), F.lit(", n "), F.coalesce(score["n_cases"].cast("string"), F.lit("not stated"))),
    ))


def ranking_record(total: Column, factors: dict[str, Column], subfield: Column, rank: Column, relaxed: Column, version: str) -> Column:
    """What a day's document says about the rank of a row."""
    return F.struct(total.alias("score"), F.struct(*[rounded(v).alias(k) for k, v in factors.items()]).alias("factors"), subfield.alias("subfield_key"), rank.alias("rank"), relaxed.alias("diversity_relaxed"), F.lit(version).alias("weights_version"))


def _as_text(weights: list[float]) -> str:
    return ",".join(f"{w:g}" for w in weights)


def weights_version(weights: list[float], freshness_days: int) -> str:
    return hashlib.sha256(f"[{_as_text([*weights, freshness_days])}]".encode()).hexdigest()[:12]


def weights_version_of(weights: list[float], freshness_days: Column) -> Column:
    """The same for days that differ by row."""
    return F.left(F.sha2(F.concat(F.lit(f"[{_as_text(weights)},"), freshness_days.cast("string"), F.lit("]")).cast("binary"), 256), F.lit(12))
