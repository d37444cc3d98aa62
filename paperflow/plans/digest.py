"""The digest's own score over documents as candidates: lexicon factors, total, gate, cap and evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperflow.catalog import register
from paperflow.functions import identity, scoring
from paperflow.functions.terms import words_of
from paperflow.operators import selection
from paperflow.plans.library import BLANK_RE, CANDIDATES, REASON_SQL, TODAY, aged, candidates, first_line, table
from paperflow.tables import durable, let

def re2(pattern: str) -> str:
    """A pattern whose look-arounds become characters that are read: the same for whether it is found."""
    for around, read in ((r"(?iu)", "(?i)"), (r"(?<![\p{L}\p{N}])", r"(?:^|[^\p{L}\p{N}])"), (r"(?<!\p{L})", r"(?:^|[^\p{L}])"), (r"(?!\p{L})", r"(?:$|[^\p{L}])")):
        pattern = pattern.replace(around, read)
    return pattern.replace("'", "''")


def found_sql(where: str, pattern: str) -> str:
    return f"regexp_matches({where}, '{re2(pattern)}')"


def term_sql(where: str, term: str) -> str:
    """Whether a text has a term, by the term's pattern; a plain search for its first word goes before."""
    return f"CASE WHEN contains({where}, '{words_of(term)[0]}') THEN {found_sql(where, scoring.term_pattern(term))} ELSE false END"


def terms_sql(terms: list[str]) -> str:
    rows = ", ".join(f"struct_pack(t := {term_sql('head', t)}, b := {term_sql('body', t)})" for t in terms)
    return f"[{rows}]"


def weight_sql(name: str) -> str:
    return f"list_sum(list_transform({name}, lambda x: CASE WHEN x.t THEN 2 WHEN x.b THEN 1 ELSE 0 END))"


TOKENS = "list_filter(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’+._-]*'), lambda t: regexp_replace(t, '[.''’_-]+$', '')), lambda t: t <> '')"
SIZES = " , ".join(f"regexp_extract_all(raw, '{re2(p)}', 1)" for p in scoring.SAMPLE_SIZES)
LEXICON_SQL = f"""x0 AS (SELECT doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '{BLANK_RE}', ' ', 'g')) AS title, trim(regexp_replace(coalesce(text, ''), '{BLANK_RE}', ' ', 'g')) AS raw FROM documents),
  x1 AS (SELECT *, lower(title) AS head, lower(raw) || '. ' AS body FROM x0),
  x2 AS (SELECT *, {terms_sql(scoring.OUTCOME_VERBS)} AS verbs, {terms_sql(scoring.SUBJECT_NOUNS)} AS nouns, {terms_sql(scoring.THEORETICAL_MARKERS)} AS theory, {TOKENS.format('raw')} AS words FROM x1),
  x3 AS (SELECT *, least({weight_sql('verbs')}, 4) / 4 AS v, least({weight_sql('nouns')}, 4) / 4 AS s, CASE WHEN {' OR '.join(found_sql('raw', p) for p in scoring.QUANTIFIED)} THEN 1e0 ELSE 0e0 END AS q, least({weight_sql('theory')}, 3) / 3 AS t,
    greatest(0e0, 1e0 - CASE WHEN {found_sql('head', r':\s.*(?<!\p{L})(?:' + '|'.join(scoring.METHOD_NOUNS) + r')(?!\p{L})')} THEN 0.4e0 ELSE 0e0 END - CASE WHEN len(list_filter(verbs, lambda x: x.t)) + len(list_filter(nouns, lambda x: x.t)) = 0 THEN 0.3e0 ELSE 0e0 END
      - CASE WHEN len(list_filter(string_split(title, ' '), lambda w: w <> '')) > 18 THEN 0.2e0 ELSE 0e0 END - CASE WHEN len(list_filter({TOKENS.format('title')}, lambda w: length(w) >= 15)) >= 2 THEN 0.2e0 ELSE 0e0 END) AS c,
    least(1e0, CASE WHEN len(words) = 0 THEN 0e0 ELSE len(list_filter(words, lambda t: length(t) >= 14 OR (regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '\\p{{N}}')))) / len(words) END / 0.1e0) AS j,
    list_max(list_filter(list_transform(list_concat({SIZES}), lambda d: try_cast(regexp_replace(d, '[^0-9]', '', 'g') AS BIGINT)), lambda n: n > 0)) AS n_cases FROM x2),
  x4 AS (SELECT *, least(1e0, greatest(0e0, 0.35e0 * v + 0.25e0 * s + 0.2e0 * q + 0.2e0 * c - 0.45e0 * t - 0.15e0 * j)) AS explain FROM x3)"""
DOMAINS = scoring.EVERYDAY_DOMAINS
LIFE_HITS = {d: "[" + ", ".join(f"CASE WHEN {term_sql('head', t)} OR {term_sql('low', t)} THEN '{t}' END" for t in terms) + "]" for d, terms in DOMAINS.items()}
LIFE_SQL = f"""y0 AS MATERIALIZED (SELECT doc_id, {', '.join(f"list_filter({h}, lambda t: t IS NOT NULL) AS {d}" for d, h in LIFE_HITS.items())} FROM (SELECT doc_id, head, lower(raw) AS low FROM x1)),
  y1 AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN len({d}) > 0 THEN '{d}' END" for d in DOMAINS)}], lambda d: d IS NOT NULL) AS ds, flatten([{', '.join(DOMAINS)}]) AS ts FROM y0),
  y2 AS (SELECT doc_id, least(1e0, 0.8e0 * least(len(ds), 3) / 3 + 0.2e0 * least(len(ts), 6) / 6) AS everyday, array_to_string(ds, ',') AS domains, array_to_string(ts, ',') AS terms FROM y1)"""


@register("explainability", f"WITH {LEXICON_SQL} SELECT doc_id, explain AS value, v::DOUBLE AS v, s::DOUBLE AS s, q, c, t::DOUBLE AS t, j, len(words)::INT AS n_tokens FROM x4")
def explainability(spark, sf_dir):
    e = scoring.explainability(first_line(), F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", *[F.col("e")[k].cast("double").alias(k) for k in ("value", "v", "s", "q", "c", "t", "j")], F.col("e")["n_tokens"].alias("n_tokens"))


@register("weighted_hits", f"WITH {LEXICON_SQL} SELECT doc_id, {weight_sql('verbs')}::INT AS verbs, {weight_sql('nouns')}::INT AS nouns FROM x2")
def weighted_hits(spark, sf_dir):
    low = table(spark, sf_dir, "documents").select("doc_id", F.lower(identity.squeeze(first_line())).alias("head"), F.lower(identity.squeeze("text")).alias("body"))
    found = low.select("doc_id", scoring.hits(scoring.OUTCOME_VERBS, F.col("head"), F.col("body")).alias("v"), scoring.hits(scoring.SUBJECT_NOUNS, F.col("head"), F.col("body")).alias("n"))
    return found.select("doc_id", scoring.weight_of(F.col("v")).alias("verbs"), scoring.weight_of(F.col("n")).alias("nouns"))


@register("everyday_relevance", f"WITH {LEXICON_SQL}, {LIFE_SQL} SELECT doc_id, everyday AS value, domains, terms FROM y2")
def everyday_relevance(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", scoring.everyday_relevance(first_line(), F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e")["value"].alias("value"), *[F.array_join(F.col("e")[k], ",").alias(k) for k in ("domains", "terms")])


@register("stated_cases", f"WITH {LEXICON_SQL} SELECT doc_id, n_cases FROM x3")
def stated_cases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scoring.sample_size(identity.squeeze("text")).alias("n_cases"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the exclusions with all four factors and the total."""
    open_to = selection.open_to(**{n: F.col(n) for n in ("title", "kind", "retracted", "age", "seen")})
    review, access = scoring.peer_review(F.lit(False), F.col("kind"), F.col("venue")), scoring.open_access(F.col("is_open"), F.col("licence"))
    # one generator excludes and reads: a filter on the text would go below the columns that read it, and squeeze it once more
    read = let(scoring.texts(F.col("title"), F.col("abstract"), F.col("tldr")), lambda x: F.when(selection.sound_text(x["raw"], x["note"]), F.array(scoring.read(x))))
    kept = aged(spark, sf_dir).select("id", "doc_id", "subfield", "date", "age", review.alias("review"), access.alias("access"), F.explode(F.when(open_to, read)).alias("read"))
    base = kept.select("*", "read.*").drop("read")
    factors = {"explainability": F.col("explain")["value"], "everyday_relevance": F.col("everyday")["value"], "freshness": scoring.freshness(F.col("age"), 7), "credibility": scoring.credibility(F.col("review"), F.col("n_cases"), F.col("access"))}
    return base.withColumns(factors).withColumn("total", scoring.total_score(**{k: F.col(k) for k in factors}))


CRED_SQL = "least(1e0, 0.4e0 * review + 0.25e0 * CASE WHEN n_cases IS NULL THEN 0.4e0 ELSE least(1e0, log10(n_cases) / 4) END + 0.2e0 * access + 0.15e0 * 0.3e0)"
SCORED_SQL = f"""WITH {CANDIDATES}, {REASON_SQL}, {LEXICON_SQL}, {LIFE_SQL},
  z0 AS (SELECT r.id, doc_id, r.subfield, r.date, r.title, explain, everyday, n_cases, greatest(0e0, (7 - (DATE '{TODAY}' - r.date)) / 7e0) AS fresh, CASE WHEN kind = 'preprint' THEN 0.4e0 WHEN venue IS NOT NULL AND kind = 'article' THEN 1e0 ELSE 0.6e0 END AS review,
    CASE WHEN NOT is_open THEN 0.3e0 WHEN licence IS NOT NULL THEN 1e0 ELSE 0.8e0 END AS access FROM r JOIN x4 USING (doc_id) JOIN y2 USING (doc_id) WHERE reason IS NULL),
  z1 AS (SELECT *, {CRED_SQL} AS cred FROM z0), z2 AS (SELECT *, floor((0.4e0 * explain + 0.28e0 * everyday + 0.18e0 * fresh + 0.14e0 * cred) * 10000 + 0.5e0) / 10000 AS total FROM z1),
  o AS (SELECT *, row_number() OVER (ORDER BY floor(total / 0.005e0 + 1e-9) DESC, explain DESC, date DESC, access DESC, cred DESC, id) AS rank FROM z2)"""


def score_order():
    return selection.ranking("total", "explainability", "date", "access", "credibility", "id")


@register("total_score", SCORED_SQL + " SELECT doc_id, floor(explain * 10000 + 0.5) / 10000 AS explainability, floor(everyday * 10000 + 0.5) / 10000 AS everyday_relevance, floor(fresh * 10000 + 0.5) / 10000 AS freshness, floor(cred * 10000 + 0.5) / 10000 AS credibility, total FROM o")
def total_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", *[scoring.rounded(F.col(k)).alias(k) for k in scoring.WEIGHTS], "total")


@register("rank_shortlist", SCORED_SQL + " SELECT id, rank::INT AS rank, total FROM o WHERE rank <= 20")
def rank_shortlist(spark, sf_dir):
    return selection.top(scored(spark, sf_dir), score_order(), 20).select("id", "rank", "total")


GATED_SQL = SCORED_SQL + """, g AS (SELECT *, row_number() OVER (PARTITION BY subfield ORDER BY rank) AS n FROM o WHERE explain >= GATE), a AS (SELECT * FROM g WHERE n <= 2 ORDER BY rank LIMIT 5),
  u AS (SELECT subfield, count(*) AS used FROM a GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY subfield ORDER BY rank) AS n FROM o WHERE explain < GATE),
  t AS (SELECT b.* FROM b LEFT JOIN u USING (subfield) WHERE n <= 2 - coalesce(used, 0) ORDER BY rank LIMIT (SELECT CASE WHEN count(*) < 3 THEN 3 - count(*) ELSE 0 END FROM a))
  SELECT id, subfield, total, below_gate FROM (SELECT *, false AS below_gate FROM a UNION ALL SELECT *, true FROM t)"""


@register("discover_digest", GATED_SQL.replace("GATE", "0.35e0"))
def discover_digest(spark, sf_dir):
    """The day's five: the gate, two a subfield, and at least three."""
    ranked = durable(scored(spark, sf_dir).select("id", "subfield", "total", "explainability", "date", "access", "credibility"))
    return selection.select_day(ranked, "id", "subfield", score_order(), F.col("explainability") >= scoring.GATE, cap=2, limit=5, least=3).select("id", "subfield", "total", "below_gate")


@register("gate_waiver", GATED_SQL.replace("GATE", "0.999e0"))
def gate_waiver(spark, sf_dir):
    """The same with a gate that few or none pass: the best below it fill up to three."""
    ranked = durable(scored(spark, sf_dir).select("id", "subfield", "total", "explainability", "date", "access", "credibility"))
    return selection.select_day(ranked, "id", "subfield", score_order(), F.col("explainability") >= 0.999, cap=2, limit=5, least=3).select("id", "subfield", "total", "below_gate")


@register("score_evidence", SCORED_SQL + " SELECT doc_id, 'total ' || printf('%.4f', total) || ' = 0.40 x explainability + 0.28 x everyday relevance + 0.18 x freshness + 0.14 x credibility' AS first, CASE WHEN explain >= 0.35e0 THEN 'passes the gate of 0.35' ELSE 'below the gate of 0.35' END AS gate FROM o")
def score_evidence(spark, sf_dir):
    score = F.struct("total", "explain", "everyday", "age", "review", "access", "n_cases")
    found = scored(spark, sf_dir).select("doc_id", scoring.evidence(score).alias("e"))
    return found.select("doc_id", F.get("e", F.lit(0)).alias("first"), F.get("e", F.lit(1)).alias("gate"))


@register("ranking_record", SCORED_SQL + " SELECT id, total AS score, rank::INT AS rank, floor(explain * 10000 + 0.5) / 10000 AS explainability, subfield AS subfield_key, substr(sha256('[0.4,0.28,0.18,0.14,7]'), 1, 12) AS weights_version FROM o WHERE rank <= 50")
def ranking_record(spark, sf_dir):
    ranked = selection.top(scored(spark, sf_dir), score_order(), 50)
    record = scoring.ranking_record(F.col("total"), {k: F.col(k) for k in scoring.WEIGHTS}, F.col("subfield"), F.col("rank"), F.lit(False), scoring.weights_version(list(scoring.WEIGHTS.values()), 7))
    r = F.col("r")
    return ranked.select("id", record.alias("r")).select("id", r["score"].alias("score"), r["rank"].alias("rank"), r["factors"]["explainability"].alias("explainability"), r["subfield_key"].alias("subfield_key"), r["weights_version"].alias("weights_version"))


@register("unenriched", f"WITH {CANDIDATES} SELECT id, NULL::VARCHAR AS tldr, CASE WHEN body <> '' THEN 'source' ELSE 'none' END AS abstract_source FROM c")
def unenriched(spark, sf_dir):
    return selection.unenriched(candidates(spark, sf_dir), "abstract").select("id", "tldr", "abstract_source")
