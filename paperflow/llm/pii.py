"""Personal data, found by patterns and by what corpus co-occurrence discloses, in DataFrame operations alone.

Protected entities are the values of base spans (e-mail addresses, IP addresses, card and phone numbers) and of
secrets: codes of letters and digits whose own characters carry `secret_bits` or more of information. Beside the
values, each kind is an entity of its own, held by every text with a value of that kind. A term anywhere in a text
that holds an entity discloses it as far as their pointwise mutual information goes, estimated over all different
texts: PMI = log2(N m(t,e) / (n(t) n(e))), against the entity's own information IC = log2(N / n(e)).
m = n(t,e) - 1 shrinks the count by the text at hand, which is no evidence for itself: few texts need a closer tie, and
a single text, in which every word stands beside the entity alike, tells nothing. A term discloses if PMI >= `share` IC
and if so close a tie is no accident: by Chernoff's bound, n(t) KL(n(t,e)/n(t) || n(e)/N) >= ln(terms / `alpha`).
Terms that disclose a value are spans of kind term and `sanitise` removes them; those that disclose only a kind are
hints and generalised, as are base spans and secrets. They count wherever they stand in a text with that entity.

Defined cases: a null text is empty; base spans stay whatever the method adds, also where kinds overlap, and nothing
added overlaps them; a row without id has base spans, and its text counts; texts that repeat count once in every count, so copies are no
evidence; words in e-mail addresses are no terms; a table without rows gives none; input columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.llm.common import durable
from paperflow.llm.native import apart, let, match_spans, scanned

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored forms of the contract's patterns: the same leftmost matches, in time that is linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What words are made of.
LETTER = r"\p{L}\p{M}"
SPAN = "array<struct<start:int,end:int,kind:string,found:string>>"
#: What the method adds: secrets, terms that disclose a value, terms that disclose a kind.
ADDED = ("secret", "term", "hint")
CODE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), small)
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then by kind in the order of KINDS."""

    def of(t: Column, kind: str) -> Column:
        return F.transform(F.filter(match_spans(t, PATTERNS[kind]), lambda s: valid(kind, s["found"])), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found")))

    every = let(F.coalesce(text, F.lit("")), lambda t: F.array_sort(F.concat(*[of(t, k) for k in KINDS])))
    return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))


def terms(text: Column) -> Column:
    """Distinct words in lower case, of any length, outside e-mail addresses; of Han, which has no spaces, also two and three characters in a row."""

    def of(t: Column) -> Column:
        grams = [F.regexp_extract_all(t, F.lit(rf"(?=(\p{{IsHan}}{{{n}}}))"), F.lit(1)) for n in (2, 3)]
        words = F.filter(F.split(t, rf"[^{LETTER}]+"), lambda w: w != "")
        return F.array_distinct(F.when(F.regexp_like(t, F.lit(r"\p{IsHan}{2}")), F.concat(words, *grams)).otherwise(words))

    return let(F.lower(F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)), of)


def secret_spans(text: Column, bits: float) -> Column:
    """Codes with letters and digits (one of eight characters or more) of `bits` of information by their own characters."""

    def strong(x: Column) -> Column:
        digits = F.length(x) - F.length(F.translate(x, "0123456789", ""))
        mixed = (8 * digits >= F.length(x)) & F.regexp_like(x, F.lit("[A-Za-z]"))

        def information(chars: Column) -> Column:
            each = lambda c: F.size(F.filter(chars, lambda d: d == c))
            return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total + each(c) * F.log2(F.size(chars) / each(c)))

        return F.when(mixed, let(F.split(x, ""), information) >= bits).otherwise(False)

    found = F.filter(match_spans(text, CODE), lambda s: strong(s["found"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("secret").alias("kind"), s["found"].alias("found")))


def told_pattern(told: Column) -> Column:
    """Matches the terms `told` as whole words, and those of two or three Han characters also within a run."""
    han = lambda w: F.regexp_like(w, F.lit(r"^\p{IsHan}{2,3}$"))
    runs = F.array_sort(F.filter(told, han), lambda a, b: F.length(b) - F.length(a))
    whole = F.concat(F.lit(rf"(?<![{LETTER}])(?:"), F.array_join(F.filter(told, lambda w: ~han(w)), "|"), F.lit(rf")(?![{LETTER}])"))
    return F.concat(F.lit("(?iu)(?:"), F.array_join(F.concat(runs, F.when(F.size(runs) < F.size(told), F.array(whole)).otherwise(F.expr("cast(array() as array<string>)"))), "|"), F.lit(")"))


def entity(span: Column) -> Column:
    """Kind and value of a span, with what may be written differently taken out."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["found"])).when(span["kind"] == "ip", span["found"]).otherwise(F.regexp_replace(span["found"], "[^0-9]", "")))


def disclosing(docs: DataFrame, rows: DataFrame, *, text: str, share: float = 0.8, alpha: float = 0.001, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(body_key, term, entity) for the terms of a text that disclose one of its entities; kinds end with ":*". `rows` has body_key of all rows, and spans and body of those with spans."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_texts = max(1, rows.select("body_key").distinct().count())
    some = rows.where(F.size("spans") > 0)
    held = some.select("body_key", F.explode("spans").alias("s")).select("body_key", F.explode(F.array(entity(F.col("s")), F.concat(F.col("s")["kind"], F.lit(":*")))).alias("entity")).distinct()
    held = held.join(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") > 1), "entity")
    # rows with a term, less those of its texts that are copies of another: what is shuffled is combined counts
    copies = durable(rows.groupBy("body_key").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0").withColumnRenamed("body_key", "copied"))
    few = F.broadcast(copies) if copies.count() <= broadcast_rows else copies
    copied = docs.select(F.xxhash64(body).alias("copied"), body.alias("body")).join(few, "copied").dropDuplicates(["copied"]).select(F.explode(terms(F.col("body"))).alias("term"), (-F.col("more")).alias("n"))
    counted = docs.select(F.explode(terms(body)).alias("term"), F.lit(1).cast("long").alias("n")).unionByName(copied)
    n_term = durable(counted.groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") > 1))
    least = math.log(max(1, n_term.count()) / alpha)
    # n(t,e) <= n(e): a term in more texts than this cannot reach `share`, so nothing is lost
    most = lambda n: F.pow(F.lit(float(n_texts)), F.lit(1 - share)) * F.pow(n, F.lit(share)) * (1 + 1e-9)
    widest = held.groupBy("body_key").agg(F.max("n_entity").alias("widest"))
    near = some.select("body_key", "body").dropDuplicates(["body_key"]).join(widest, "body_key").select("body_key", "widest", F.explode(terms(F.col("body"))).alias("term"))
    near = near.join(n_term, "term").where(F.col("n_term") <= most(F.col("widest"))).select("body_key", "term", "n_term")
    near = durable(near.join(held, "body_key").where(F.col("n_term") <= most(F.col("n_entity"))).select("body_key", "entity", "n_entity", "term", "n_term"))
    pairs = near.groupBy("entity", "n_entity", "term", "n_term").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") > 1)
    n, f, p = F.lit(float(n_texts)), F.col("n_pair") / F.col("n_term"), F.col("n_entity") / F.lit(float(n_texts))
    pmi, ic = F.log2(n * (F.col("n_pair") - 1) / (F.col("n_term") * F.col("n_entity"))), F.log2(n / F.col("n_entity"))
    tie = F.col("n_term") * (f * F.log(f / p) + F.when(f < 1, (1 - f) * F.log((1 - f) / (1 - p))).otherwise(0.0))
    scored = pairs.where((ic > 0) & (f > p) & (pmi >= share * ic) & (tie >= least)).select("entity", "term")
    return near.select("body_key", "term", "entity").join(scored, ["entity", "term"])


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", secret_bits: float = 96.0, whole: bool = True, **options) -> DataFrame:
    """(doc_id, body, base, added): every text with its base spans and those that the method adds. Unless `whole`, body is null where there are no spans."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("body"), base_spans(body).alias("base"), secret_spans(body, secret_bits).alias("secrets"))
    rows = marked.select("doc_id", F.xxhash64("body").alias("body_key"), "base", F.concat("base", apart(F.col("secrets"), F.col("base"))).alias("spans"), "body")
    if not whole:
        rows = rows.withColumn("body", F.when(F.size("spans") > 0, F.col("body")))
    rows = durable(rows)
    found = disclosing(docs, rows, text=text, **options)
    value = lambda own: F.array_sort(F.collect_set(F.when(F.endswith("entity", F.lit(":*")) != own, F.col("term"))))
    told = found.groupBy("body_key").agg(value(F.lit(True)).alias("of_values"), value(F.lit(False)).alias("of_kinds")).select(F.col("body_key").alias("told_key"), "of_values", F.array_except("of_kinds", "of_values").alias("of_kinds"))
    none = F.expr(f"cast(array() as {SPAN})")

    def spans(of: str, kind: str) -> Column:
        every = F.transform(match_spans(F.col("body"), told_pattern(F.col(of))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found")))
        return F.when(F.size(of) > 0, apart(every, F.col("spans"))).otherwise(none)

    secrets = F.filter("spans", lambda s: s["kind"] == "secret")
    with_spans = rows.where(F.size("spans") > 0).join(told, F.col("body_key") == F.col("told_key"), "left")
    with_spans = with_spans.select("doc_id", "body", "base", F.concat(secrets, spans("of_values", "term"), spans("of_kinds", "hint")).alias("added"))
    return with_spans.unionByName(rows.where(F.size("spans") == 0).select("doc_id", "body", "base", none.alias("added")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(base: Column, added: Column) -> Column:
    """Both by start, then by kind in the order of KINDS and ADDED."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS + ADDED]), s["kind"])
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def digest(docs: DataFrame, **options) -> DataFrame:
    found = find(docs, whole=False, **options)
    count = lambda of, k: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = listed(in_order(F.col("base"), F.col("added"))).alias("spans")
    return found.select("doc_id", *[count("base", k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), every, *[count("added", k) for k in ADDED], (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): base spans, secrets and hints generalised to their kind in brackets, terms removed; of overlapping spans the first counts."""
    found = find(docs, **options)

    def rebuilt(body: Column, spans: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            put = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
            met = x["start"] < at
            return F.struct(F.when(met, at).otherwise(x["end"]).alias("carry"), F.when(~met, F.struct(x["start"].alias("start"), x["end"].alias("end"), put.alias("put"))).alias("out"))

        def joined(kept: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.transform(kept, lambda x: x["end"]))
            part = lambda chars, at, x: F.concat(F.array_join(F.slice(chars, at + 1, F.coalesce(x["start"] - at, F.size(chars))), ""), F.coalesce(x["put"], F.lit("")))
            return let(F.split(body, "", -1), lambda chars: F.array_join(F.zip_with(before, kept, lambda at, x: part(chars, at, x)), ""))

        return F.when(F.size(spans) == 0, body).otherwise(let(scanned(spans, F.lit(0), step, "struct<start:int,end:int,put:string>"), joined))

    return found.select("doc_id", rebuilt(F.col("body"), in_order(F.col("base"), F.col("added"))).alias("text"))
