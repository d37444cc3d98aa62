"""The queries of this subpackage and, where SQL can state the same result, that SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperflow.llm import centroids, decontamination, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity, vector_codes, warc
from paperflow.llm.common import spread
from paperflow.llm.common import table as read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores if its file has fewer splits."""
    df = read_table(spark, sf_dir, name)
    return spread(df) if name in ("documents", "pages", "embeddings") else df


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
h AS (SELECT dg.doc_id, dg.i, dg.k, g.item_id FROM dg JOIN g ON dg.k = g.k AND dg.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, (coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op1_decontamination", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(list_aggregate(w[i:i + 49], 'string_agg', ' ')) AS h, md5(list_aggregate(w[i:i + 49], 'string_agg', ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, m, min(doc_id) AS first_id FROM g GROUP BY 1, 2),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h, m) WHERE first_id < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM r GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""


@query("op4_substring_dedup", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, into = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), carry=["doc_id"], hashed=True)
    got = F.col(into)
    return found.select("doc_id", got["n_words"].alias("n_words"), got["n_removed"].alias("n_removed"), got["kept"].alias("kept_sha256"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, into = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col(into).alias("score"), (F.col(into) >= 0.5).cast("int").alias("predicted"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, n, min(page_id) AS first_id FROM p GROUP BY 1, 2)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (5 * (3 - k % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (x, n)
"""


@query("op7_warc", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed")
    return found.select("doc_id", F.col("removed")["chunks"].alias("n_chunks_removed"), F.col("removed")["lines"].alias("n_lines_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_CUTS = ", ".join(f"('{name}', {k}, {c!r}e0)" for name, (_, cuts) in quality_rules.RULES.items() for k, c in enumerate(cuts))
OP10_VALUES = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, ({x})::DOUBLE AS x FROM s" for name, (x, _) in quality_rules.RULES.items())
OP10 = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, gram)) GROUP BY 1),
b AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM a LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
k AS (SELECT s.*, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS tuning FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1)),
h AS (SELECT lang, count(*) AS n FROM k WHERE NOT tuning GROUP BY 1),
m AS (SELECT x.lang, coalesce(h.n, 0) < ceil(ln(0.05e0 / ((SELECT count(*) FROM h) + 1)) / ln(0.95e0)) AS pooled FROM (SELECT DISTINCT lang FROM s) x LEFT JOIN h ON h.lang IS NOT DISTINCT FROM x.lang),
e AS (SELECT greatest(1, (SELECT count(*) FROM m WHERE NOT pooled) + 1) AS tested),
u AS (SELECT doc_id, CASE WHEN pooled THEN 'pool' ELSE coalesce('own ' || s.lang, 'null') END AS grp FROM s JOIN m ON m.lang IS NOT DISTINCT FROM s.lang),
v AS ({OP10_VALUES}), c(rule, k, c) AS (VALUES {OP10_CUTS}),
x AS (SELECT v.doc_id, u.grp, v.rule, count(*) FILTER (v.x > c.c) AS kx FROM v JOIN u USING (doc_id) JOIN c USING (rule) GROUP BY 1, 2, 3),
n AS (SELECT x.grp, x.rule, i.k, count(*) FILTER (x.kx > i.k) AS bad, count(*) AS n FROM x JOIN k USING (doc_id) CROSS JOIN (SELECT unnest(range(8)) AS k) i WHERE k.tuning AND NOT k.base_failed GROUP BY 1, 2, 3),
o AS (SELECT grp, rule, coalesce(min(k) FILTER (bad <= 0.01e0 * n), 8) AS at FROM n GROUP BY 1, 2),
d AS (SELECT x.doc_id, x.grp, max(x.kx - o.at) AS reach FROM x JOIN o USING (grp, rule) GROUP BY 1, 2),
p AS (SELECT d.grp, i.r, count(*) AS n, count(*) FILTER (k.base_failed OR i.r < d.reach) AS k FROM d JOIN k USING (doc_id) CROSS JOIN (SELECT unnest(range(9)) AS r) i WHERE NOT k.tuning GROUP BY 1, 2),
q AS (SELECT grp, r, k < 0.05e0 * n AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05e0) + (n - i) * ln(0.95e0)))) <= 0.05e0 / (SELECT tested FROM e) AS safe FROM p),
z AS (SELECT grp, coalesce(max(r) FILTER (NOT safe) + 1, 0) AS relaxed FROM q GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d.reach <= z.relaxed, true) AS kept
FROM s LEFT JOIN d USING (doc_id) LEFT JOIN z USING (grp)
"""


@query("op10_quality_rules", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The most tokens that a document has without being over the limit.
TOKEN_LIMIT = 4096


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:  # on the driver, which sends it to the executors
        found, into = token_counts.count_tokens(table(spark, sf_dir, "documents"), file.read(), carry=["doc_id"])
    got = F.col(into)
    return found.select("doc_id", got["n_bytes"].alias("n_bytes"), got["n_tokens"].alias("n_tokens"), (got["n_tokens"] > TOKEN_LIMIT).alias("over_limit"))


#: The mean of whole numbers, rounded down; `n` is positive.
FLOOR_MEAN = "((sum({0}) - ((sum({0}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def code_rounds(rounds: int) -> str:
    """Codebooks c1, c2, ... and the assignments a0, a1, ... that they come from."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""e{k} AS MATERIALIZED (SELECT p.vec_id, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM p JOIN c{k} c USING (part, pos) GROUP BY 1, 2, 3),
a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM e{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if k < rounds:
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT part, entry, pos, {FLOOR_MEAN.format('x')} AS x FROM p JOIN a{k} USING (vec_id, part) GROUP BY 1, 2, 3) n USING (part, entry, pos))")
    return ",\n".join(out)


OP12 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT vec_id, i // 8 AS part, i % 8 AS pos, q[i + 1] AS x FROM v CROSS JOIN (SELECT unnest(range(64)) AS i)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= 16),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM p JOIN s USING (vec_id)),
{code_rounds(6)},
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id) CROSS JOIN h
"""


@query("op12_vector_codes", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def centroid_rounds(rounds: int) -> str:
    out = []
    for k in range(rounds + 1):
        out.append(f"""e{k} AS MATERIALIZED (SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM p JOIN c{k} c USING (pos) GROUP BY 1, 2),
a{k} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM e{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, pos, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT cluster, pos, {FLOOR_MEAN.format('x')} AS x FROM p JOIN a{k} USING (vec_id) GROUP BY 1, 2) n USING (cluster, pos))")
    return ",\n".join(out)


OP13 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT vec_id, i AS pos, q[i + 1] AS x FROM v CROSS JOIN (SELECT unnest(range(64)) AS i)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40),
c0 AS MATERIALIZED (SELECT cluster, pos, x FROM p JOIN s USING (vec_id)),
{centroid_rounds(5)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c5 GROUP BY 1)
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a5 JOIN h USING (cluster)
"""


@query("op13_centroids", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
