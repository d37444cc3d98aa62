"""Queries for the operators and functions of the library, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperflow import tables
from paperflow.catalog import register
from paperflow.functions import identity, scoring, text
from paperflow.operators import ledger, merge, pages, selection, similarity

TODAY = "2026-08-19"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = tables.table(spark, sf_dir, name)
    return tables.spread(df) if name in ("documents", "pages") else df


def quoted(rows: list[tuple]) -> str:
    value = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


def first_line(column: str = "text"):
    return F.substring_index(F.col(column), "\n", 1)


#: Spellings of identifiers, {} in each being a document's number.
SPELLINGS = [
    ("10.1038/S41586-{}-5", "w44{}", "arXiv:2608.{}v3"), ("https://doi.org/10.1038/s41586-{}-5", "https://openalex.org/W44{}", "https://arxiv.org/abs/2608.{}v1"),
    ("  doi:10.1038/s41586-{}-5.  ", "openalex:W{}", "http://www.arxiv.org/pdf/2608.{}.pdf"), ("http://dx.doi.org/10.1/x{}),", "https://api.openalex.org/works/W{}", "2608.{}"), (None, None, None), ("  ", " ", ""),
]


def spelled(k: int):
    """The k-th identifier of each document, in one of the spellings."""
    pick = F.get(F.array(*[F.lit(s[k]).cast("string") for s in SPELLINGS]), (F.col("doc_id") % len(SPELLINGS)).cast("int"))
    return F.replace(pick, F.lit("{}"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))


def spelled_sql(k: int) -> str:
    return "replace([" + ", ".join("NULL" if s[k] is None else f"'{s[k]}'" for s in SPELLINGS) + f"][doc_id % {len(SPELLINGS)} + 1], '{{}}', lpad(doc_id::VARCHAR, 5, '0'))"


@register(
    "normalise_ids",
    rf"""SELECT id, nullif(regexp_replace(regexp_replace(lower(trim(d)), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', ''), '[.,)\s]+$', ''), '') AS doi,
      nullif(lower(regexp_replace(trim(d), '(?i)^https://doi\.org/', '')), '') AS bare_doi,
      nullif(upper(regexp_replace(regexp_replace(trim(w), '(?i)^https?://(?:api\.)?openalex\.org/(?:works/)?', ''), '(?i)^openalex:', '')), '') AS work_id,
      nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p)), '^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/', ''), '^arxiv:', ''), '\.pdf$', ''), 'v[0-9]+$', ''), '') AS preprint_id
    FROM (SELECT doc_id AS id, {spelled_sql(0)} AS d, {spelled_sql(1)} AS w, {spelled_sql(2)} AS p FROM documents)""",
)
def normalise_ids(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[spelled(k).alias(c) for k, c in enumerate("dwp")])
    return df.select("id", identity.normalise_doi(F.col("d")).alias("doi"), identity.bare_doi(F.col("d")).alias("bare_doi"), identity.normalise_work_id(F.col("w")).alias("work_id"), identity.normalise_preprint_id(F.col("p")).alias("preprint_id"))


KEY_SQL = "regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+', '', 'g')"


@register("title_key", f"SELECT doc_id, {KEY_SQL} AS key FROM documents")
def title_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.title_key(first_line()).alias("key"))


@register(
    "trigram_pairs_090",
    f"""WITH k AS (SELECT DISTINCT {KEY_SQL} AS k FROM documents), g AS (SELECT DISTINCT k, k[i:i + 2] AS gram FROM (SELECT k, unnest(range(1, len(k) - 1)) AS i FROM k WHERE len(k) >= 3)),
    n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT x.k AS a, y.k AS b, count(*) AS both_ FROM g x JOIN g y ON x.gram = y.gram AND x.k < y.k GROUP BY 1, 2)
    SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE both_ * 10 >= 9 * (x.n + y.n - both_)""",
)
def trigram_pairs(spark, sf_dir):
    return similarity.similar_keys(title_key(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: title and abstract are the text's, the rest follows from the id and the labels."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    return docs.select(
        F.concat(F.lit("W"), k.cast("string")).alias("id"), k, first_line().alias("title"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("tldr"), F.date_sub(F.lit(TODAY).cast("date"), (k % 12).cast("int")).alias("date"),
        F.when(k % 19 == 0, "editorial").when(k % 5 == 0, "preprint").otherwise("article").alias("kind"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("retracted"), F.when(k % 17 == 0, "doi").when(k % 23 == 0, "title").alias("seen"),
        F.col("source").alias("subfield"), (k % 2 == 0).alias("is_open"), F.when(k % 4 == 0, "cc-by").when(k % 4 == 2, "public-domain").alias("licence"), F.when(k % 3 != 0, "Venue").alias("venue"),
    )


BLANK_RE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CANDIDATES = f"""c AS (SELECT 'W' || doc_id AS id, doc_id, split_part(text, chr(10), 1) AS title, trim(regexp_replace(text, '{BLANK_RE}', ' ', 'g')) AS body, text, (DATE '{TODAY}' - (doc_id % 12)::INT)::DATE AS date,
  CASE WHEN doc_id % 19 = 0 THEN 'editorial' WHEN doc_id % 5 = 0 THEN 'preprint' ELSE 'article' END AS kind, coalesce(toxic = 1, false) AS retracted, CASE WHEN doc_id % 17 = 0 THEN 'doi' WHEN doc_id % 23 = 0 THEN 'title' END AS seen,
  source AS subfield, doc_id % 2 = 0 AS is_open, CASE WHEN doc_id % 4 = 0 THEN 'cc-by' WHEN doc_id % 4 = 2 THEN 'public-domain' END AS licence, CASE WHEN doc_id % 3 <> 0 THEN 'Venue' END AS venue
  FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))"""
INDEX_SQL = r"""(regexp_matches(body, '(?s)^\s*\{.*"\s*:\s*\[') OR regexp_matches(body, '(?i)inverted[_\s]?index|indexlength') OR
  (len(string_split(body, ' ')) >= 10 AND len(list_filter(string_split(body, ' '), lambda t: regexp_matches(t, '^[0-9]+[,;\]]?$'))) * 2 >= len(string_split(body, ' '))))"""
REASON_SQL = rf"""r AS (SELECT *, CASE WHEN retracted OR kind = 'retraction' OR regexp_matches(title, '(?i)^\s*retracted($|[^\p{{L}}])') THEN 'EXCL_RETRACTED' WHEN body = '' THEN 'EXCL_NO_ABSTRACT' WHEN length(body) < 400 THEN 'EXCL_ABSTRACT_TOO_THIN'
  WHEN DATE '{TODAY}' - date > 7 THEN 'EXCL_STALE' WHEN seen = 'title' THEN 'EXCL_SEEN_TITLE' WHEN seen IS NOT NULL THEN 'EXCL_SEEN'
  WHEN kind IN ('editorial', 'letter', 'erratum', 'book-review', 'paratext', 'dataset', 'peer-review') OR regexp_matches(title, '(?i)^\s*(correction|corrigendum|erratum|editorial|comment on|reply to|response to)($|[^\p{{L}}])') THEN 'EXCL_TYPE'
  WHEN {INDEX_SQL} THEN 'EXCL_NO_ABSTRACT' END AS reason FROM c)"""


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("age", scoring.age_in_days(F.col("date"), F.lit(None).cast("date"), F.lit(TODAY).cast("date")))


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).withColumn("reason", selection.exclusion_reason(**{n: F.col(n) for n in ("title", "abstract", "tldr", "kind", "retracted", "age", "seen")}))


@register("exclusion_reason", f"WITH {CANDIDATES}, {REASON_SQL} SELECT doc_id, reason FROM r")
def exclusion_reason(spark, sf_dir):
    return reasoned(spark, sf_dir).select("doc_id", "reason")


@register("exclusion_counts", f"WITH {CANDIDATES}, {REASON_SQL} SELECT d.reason, count(r.reason) AS n FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in selection.REASONS)}) d(reason) LEFT JOIN r USING (reason) GROUP BY 1")
def exclusion_counts(spark, sf_dir):
    return selection.counts_by_reason(reasoned(spark, sf_dir))


def part_order():
    return [F.floor(F.col("p_retailprice") / 50 + 1e-9).desc(), F.col("p_size").desc(), F.col("p_partkey").asc()]


PART_SQL = "o AS (SELECT *, row_number() OVER (ORDER BY floor(p_retailprice / 50 + 1e-9) DESC, p_size DESC, p_partkey) AS rank FROM part), g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rank) AS n FROM o)"


@register("rank_total_order", f"WITH {PART_SQL} SELECT p_partkey, rank::INT AS rank FROM o WHERE rank <= 100")
def rank_total_order(spark, sf_dir):
    return selection.top(table(spark, sf_dir, "part"), part_order(), 100).select("p_partkey", "rank")


@register("diversity_cap", f"WITH {PART_SQL} SELECT p_partkey, p_brand FROM g WHERE n <= 2 ORDER BY rank LIMIT 30")
def diversity_cap(spark, sf_dir):
    return selection.capped(table(spark, sf_dir, "part"), "p_brand", part_order(), 2, 30).select("p_partkey", "p_brand")


@register("diversity_relaxed", f"WITH {PART_SQL} SELECT p_partkey, p_brand, n > 1 AS relaxed FROM g WHERE n <= 3 ORDER BY n > 1, rank LIMIT 40")
def diversity_relaxed(spark, sf_dir):
    return selection.capped(table(spark, sf_dir, "part"), "p_brand", part_order(), 1, 40, relaxed=3).select("p_partkey", "p_brand", "relaxed")


@register(
    "seeded_admission",
    f"""WITH {PART_SQL}, a AS (SELECT * FROM g WHERE p_size > 25 AND n <= 1 ORDER BY rank LIMIT 8), u AS (SELECT p_brand, count(*) AS used FROM a GROUP BY 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rank) AS k FROM o WHERE p_size <= 25) SELECT p_partkey, p_brand FROM x LEFT JOIN u USING (p_brand) WHERE k <= 2 - coalesce(used, 0) ORDER BY rank LIMIT (SELECT 30 - count(*) FROM a)""",
)
def seeded_admission(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    already = selection.capped(part, "p_brand", part_order(), 1, 10**6).where("p_size > 25").orderBy(*part_order()).limit(8)
    return selection.admit(part.where("p_size <= 25"), already, "p_brand", part_order(), 2, 30).select("p_partkey", "p_brand")


@register("remainder", f"WITH {PART_SQL} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM g WHERE n <= 2 ORDER BY rank LIMIT 30)")
def remainder(spark, sf_dir):
    return table(spark, sf_dir, "part").join(diversity_cap(spark, sf_dir), "p_partkey", "left_anti").select("p_partkey")


@register("shortfall_reason", "SELECT p_brand, CASE WHEN s >= 10 THEN 'none' WHEN e > s THEN 'diversity-cap' ELSE 'candidate-shortage' END AS reason FROM (SELECT p_brand, count(*) AS e, least(count(*), count(DISTINCT p_type) * 2) AS s FROM part GROUP BY 1)")
def shortfall_reason(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("e"), F.countDistinct("p_type").alias("t"))
    return n.select("p_brand", selection.shortfall(F.least("e", F.col("t") * 2), F.col("e"), 10).alias("reason"))


@register("freshness_score", "SELECT o_orderkey, greatest(0, DATE '1998-08-05' - o_orderdate::DATE)::INT AS age, least(1.0, greatest(0.0, (200 - greatest(0, DATE '1998-08-05' - o_orderdate::DATE)) / 200.0))::DOUBLE AS freshness FROM orders")
def freshness_score(spark, sf_dir):
    age = scoring.age_in_days(F.col("o_orderdate").cast("date"), F.lit(None).cast("date"), F.lit("1998-08-05").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"), scoring.freshness(age, 200).alias("freshness"))


@register("effective_date", "SELECT o_orderkey, greatest(o_orderdate::DATE, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE + (o_orderkey % 9 - 4)::INT END)::DATE AS effective FROM orders")
def effective_date(spark, sf_dir):
    indexed = F.when(F.col("o_orderkey") % 3 > 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 9 - 4).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.effective_date(F.col("o_orderdate").cast("date"), indexed).alias("effective"))


@register("local_date", "SELECT event_id, strftime(timezone('Europe/Prague', timezone('UTC', ts)), '%Y-%m-%d') AS day, isodow(timezone('Europe/Prague', timezone('UTC', ts)))::INT AS weekday FROM events")
def local_date(spark, sf_dir):
    here = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Prague")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(here, "yyyy-MM-dd").alias("day"), (F.weekday(here) + 1).alias("weekday"))


@register("cross_source_merge", """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 2 > 0 THEN source END AS source, doc_id % 7 = 0 AS flag FROM documents),
    r AS (SELECT *, (CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END) AS rich FROM x)
    SELECT md5(text) AS key, arg_min(doc_id, (1000000000 * (2 - rich) + doc_id)) AS lead_id, arg_min(lang, (1000000000 * (2 - rich) + doc_id)) FILTER (lang IS NOT NULL) AS lang, arg_min(source, (1000000000 * (2 - rich) + doc_id)) FILTER (source IS NOT NULL) AS source, bool_or(flag) AS flag, count(*) AS records FROM r GROUP BY 1""")
def cross_source_merge(spark, sf_dir):
    k = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select(k, k.alias("lead_id"), F.md5("text").alias("key"), F.when(k % 3 > 0, F.col("lang")).alias("lang"), F.when(k % 2 > 0, F.col("source")).alias("source"), (k % 7 == 0).alias("flag"))
    return merge.merge_by(x, "key", "doc_id", lead=["lead_id"], fill=["lang", "source"], any_true=["flag"], rich=merge.richness(["lang", "source"])).drop("doc_id")


@register("enrich_left_join", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN text END AS abstract FROM documents), l AS (SELECT doc_id, 'quality ' || max(quality) AS t, 'n' || count(*) AS tldr FROM labels GROUP BY 1)
    SELECT s.doc_id, CASE WHEN nullif(trim(abstract), '') IS NOT NULL THEN abstract ELSE t END AS abstract, tldr, CASE WHEN nullif(trim(abstract), '') IS NOT NULL THEN 'source' WHEN t IS NOT NULL THEN 'lookup' ELSE 'none' END AS abstract_source, CASE WHEN l.doc_id IS NULL THEN 'not found' END AS enrichment_note FROM s LEFT JOIN l USING (doc_id)""")
def enrich_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("abstract"))
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.concat(F.lit("quality "), F.max("quality").cast("string")).alias("abstract"), F.concat(F.lit("n"), F.count(F.lit(1)).cast("string")).alias("tldr"))
    return merge.enrich(rows, found, "doc_id", "abstract", "tldr")


@register("seen_within_180_days", """WITH l AS (SELECT 'W' || o_custkey AS work_id, 'D' || o_orderkey % 700 AS doi, o_orderdate::DATE AS published_on, o_orderkey AS entry_idx FROM orders WHERE DATE '1998-08-05' - o_orderdate::DATE <= 180),
    m AS (SELECT c_custkey, entry_idx, 0 AS o, 'work_id' AS kind FROM customer JOIN l ON work_id = 'W' || c_custkey UNION ALL SELECT c_custkey, entry_idx, 1, 'doi' FROM customer JOIN l ON doi = 'D' || c_custkey)
    SELECT c_custkey AS id, seen_kind FROM customer LEFT JOIN (SELECT c_custkey, arg_min(kind, entry_idx * 2 + o) AS seen_kind FROM m GROUP BY 1) USING (c_custkey)""")
def seen_within(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(F.concat(F.lit("W"), F.col("o_custkey").cast("string")).alias("work_id"), F.concat(F.lit("D"), (F.col("o_orderkey") % 700).cast("string")).alias("doi"), F.lit(None).cast("string").alias("preprint_id"), F.col("o_orderdate").cast("date").alias("published_on"), F.col("o_orderkey").alias("entry_idx"))
    key = F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("W"), key).alias("work_id"), F.concat(F.lit("D"), key).alias("doi"), F.lit(None).cast("string").alias("preprint_id"))
    return ledger.seen(rows, entries, F.lit("1998-08-05").cast("date")).select("id", "seen_kind")


@register("ledger_latest", "SELECT o_custkey, max(o_orderdate::DATE)::DATE AS published_on, min(o_orderkey) AS entry_idx, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 > 0) AS category FROM orders GROUP BY 1")
def ledger_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("published_on"), F.col("o_orderkey").alias("entry_idx"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("category"))
    return ledger.latest(o, "o_custkey")


TOKENS_SQL = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}''’+._-]*'), lambda t: regexp_replace(t, '[.''’_-]+$', '')), lambda t: t <> '')"


@register("jargon_share", rf"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) SELECT doc_id, len(w)::INT AS n_tokens, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda t: length(t) >= 14 OR (regexp_matches(t, '\p{{L}}') AND regexp_matches(t, '\p{{N}}')))) / len(w) END::DOUBLE AS jargon FROM t")
def jargon_share(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), text.share(F.filter("w", text.is_jargon), F.col("w")).alias("jargon"))


@register("looks_like_inverted_index", f"WITH {CANDIDATES} SELECT doc_id, {INDEX_SQL} AS indexed FROM c")
def looks_like_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.inverted_index_like(identity.squeeze(F.col("text"))).alias("indexed"))


@register("inverted_index_roundtrip", f"SELECT doc_id, nullif(trim(regexp_replace(text, '{BLANK_RE}', ' ', 'g')), '') AS body FROM documents")
def inverted_index_roundtrip(spark, sf_dir):
    words = F.filter(F.split(identity.squeeze(F.col("text")), " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", identity.reconstruct(identity.inverted_index(words)).alias("body"))


def studies(spark, sf_dir):
    """Documents as studies: how many took part, the kind, venue and licence."""
    k = F.col("doc_id")
    n = (k + 100).cast("string")
    stated = F.when(k % 4 == 0, F.concat(F.lit("a trial, n = "), n, F.lit(".")))
    stated = stated.when(k % 4 == 1, F.concat(F.lit("Of "), n, F.lit(" patients and 12 mice"))).when(k % 4 == 2, F.lit("no one was asked")).otherwise(F.concat(F.lit("n="), n, F.lit(",000 and 9 adults")))
    kind = F.when(k % 3 == 0, "preprint").when(k % 3 == 1, "article")
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.concat(stated, F.lit("\n"), F.coalesce("source", F.lit(""))).alias("a"), kind.alias("k"), F.when(k % 2 == 0, "V").alias("v"), F.when(k % 5 == 0, "CC-BY").when(k % 5 == 1, "other").alias("l"), (k % 5 < 3).alias("o"))


STUDIES_SQL = """s AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN doc_id + 100 WHEN 1 THEN doc_id + 100 WHEN 3 THEN (doc_id + 100) * 1000 END AS n, CASE WHEN doc_id % 3 = 0 THEN 0.4e0 WHEN doc_id % 2 = 0 THEN 1e0 ELSE 0.6e0 END AS r,
    CASE WHEN doc_id % 5 >= 3 THEN 0.3e0 WHEN doc_id % 5 = 0 THEN 1e0 ELSE 0.8e0 END AS a FROM documents)"""


@register("sample_size", f"WITH {STUDIES_SQL} SELECT id, n FROM s")
def sample_size(spark, sf_dir):
    return studies(spark, sf_dir).select("id", scoring.sample_size(F.col("a")).alias("n"))


@register("credibility", f"WITH {STUDIES_SQL} SELECT id, floor(least(1e0, 0.4e0 * r + 0.25e0 * CASE WHEN n IS NULL THEN 0.4e0 ELSE least(1e0, log10(n) / 4) END + 0.2e0 * a + 0.15e0 * 0.3e0) * 10000 + 0.5e0) / 10000 AS credibility FROM s")
def credibility(spark, sf_dir):
    score = scoring.credibility(scoring.peer_review(F.lit(False), F.col("k"), F.col("v")), scoring.sample_size(F.col("a")), scoring.open_access(F.col("o"), F.col("l")))
    return studies(spark, sf_dir).select("id", scoring.rounded(score).alias("credibility"))


@register("page_self_contained", r"""WITH p AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), chr(10)) AS css, regexp_replace(html, '>[^<]*<', '><', 'g') AS m FROM pages),
    v AS (SELECT page_id, list_filter([CASE WHEN regexp_matches(css, '(?i)@import') THEN 'css import' END, CASE WHEN regexp_matches(regexp_replace(css, '(?i)url\(\s*[''"]?data:', '', 'g'), '(?i)url\(') THEN 'css url' END, CASE WHEN regexp_matches(m, '(?i)<link\b') THEN 'link' END, CASE WHEN regexp_matches(m, '(?i)<script\b[^>]*\bsrc=') THEN 'script src' END,
      CASE WHEN regexp_matches(m, '(?i)<(img|iframe|video|audio|object|embed|source|base)\b') THEN 'remote element' END, CASE WHEN regexp_matches(m, 'localStorage|sessionStorage|indexedDB') THEN 'storage' END, CASE WHEN regexp_matches(m, '(?i)\son[a-z]+\s*=') THEN 'inline handler' END,
      CASE WHEN regexp_matches(regexp_replace(m, '(?i)<a\b[^>]*>|</a>', '', 'g'), 'https?://') THEN 'remote url' END], lambda x: x IS NOT NULL) AS broken FROM p) SELECT page_id, array_to_string(broken, ',') AS broken FROM v""")
def page_self_contained(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(pages.violations(F.col("html")), ",").alias("broken"))


@register("escape_html", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM documents""")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("safe"))


@register("preview_sentence", rf"WITH {CANDIDATES}, s AS (SELECT doc_id, body, regexp_extract(body, '(?s)^(.{{19,179}}?[.!?])\s', 1) AS s FROM c) SELECT doc_id, CASE WHEN s <> '' THEN s WHEN length(body) <= 160 THEN body ELSE rtrim(substr(body, 1, 157)) || '…' END AS preview FROM s")
def preview_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@register("archive_index_days", "SELECT o_orderdate::DATE AS day, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1")
def archive_index_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("best"))


@register("run_log_rollup", "SELECT ts::DATE AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(value::DECIMAL(18, 2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def run_log_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@register("category_chips", "SELECT n.n_nationkey, count(c.c_custkey) AS days FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def category_chips(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("days"))


@register("first_occurrence", "SELECT role, text, min(conv_id * 1000 + turn) AS first_at FROM conversations GROUP BY 1, 2")
def first_occurrence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", "text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"))


@register("best_attempt", "SELECT conv_id, arg_min(turn, length(text) * 1000 + turn) AS turn FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def best_attempt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).groupBy("conv_id").agg(F.min_by("turn", F.struct(F.length("text"), "turn")).alias("turn"))


@register("degradations_by_source", "SELECT event_type, arg_min(user_id, event_id) AS first_user, count(*) AS n FROM events GROUP BY 1")
def degradations(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("user_id", "event_id").alias("first_user"), F.count(F.lit(1)).alias("n"))


@register("weights_version", "SELECT p_size, any_value(substr(sha256('[0.4,0.28,0.18,0.14,' || p_size || ']'), 1, 12)) AS version, count(*) AS n FROM part GROUP BY 1")
def weights_version(spark, sf_dir):
    """The version of the weights for every number of days that parts have as their size."""
    sizes = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("p_size", scoring.weights_version_of(list(scoring.WEIGHTS.values()), F.col("p_size")).alias("version"), "n")


@register("sessions", "SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    new = F.when(before.isNull() | (F.col("ts") - before > F.expr("interval 1 hour")), 1).otherwise(0)
    return table(spark, sf_dir, "events").select("user_id", new.alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"))
