"""Queries for similar titles and for the rules of prose, over whole tables and whole texts."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from paperflow.catalog import register
from paperflow.functions import anchors, identity, lexicon, prose
from paperflow.operators import collapse, echoes, gram_index, ledger, render, style
from paperflow.plans import prose_sql
from paperflow.plans.library import KEY_SQL, first_line, table
from paperflow.tables import scratch

WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}''’-]*')"
LETTERS_SQL = r"regexp_extract_all(text, '[\p{L}''’]+')"


PAIRS_SQL = f"""k AS (SELECT doc_id, {KEY_SQL} AS k FROM documents), u AS (SELECT DISTINCT k FROM k), g AS (SELECT DISTINCT k, k[i:i + 2] AS gram FROM (SELECT k, unnest(range(1, len(k) - 1)) AS i FROM u WHERE len(k) >= 3)), n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT x.k AS a, y.k AS b FROM (SELECT x.k AS a, y.k AS b, count(*) AS both_ FROM g x JOIN g y ON x.gram = y.gram AND x.k <> y.k GROUP BY 1, 2) z JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE both_ * 10 >= 9 * (x.n + y.n - both_))"""


@register("near_dup_collapse", f"""WITH RECURSIVE {PAIRS_SQL}, f AS (SELECT k.k, min(length(text) * 1000000 + doc_id) AS place FROM k JOIN documents USING (doc_id) WHERE k.k <> '' GROUP BY 1),
    o AS (SELECT k, place, row_number() OVER (ORDER BY place) AS i FROM f WHERE k IN (SELECT a FROM p)), e AS (SELECT o.k, o.i, list(q.k) AS earlier FROM o LEFT JOIN p ON p.a = o.k LEFT JOIN o q ON q.k = p.b AND q.i < o.i GROUP BY 1, 2),
    w(i, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT e.i, CASE WHEN len(list_intersect(w.kept, e.earlier)) > 0 THEN w.kept ELSE list_append(w.kept, e.k) END FROM w JOIN e ON e.i = w.i + 1),
    z AS (SELECT kept FROM w ORDER BY i DESC LIMIT 1)
    SELECT doc_id, k.k IS NULL OR k.k = '' OR (f.place = length(text) * 1000000 + doc_id AND (k.k NOT IN (SELECT k FROM o) OR list_contains((SELECT kept FROM z), k.k))) AS kept FROM k JOIN documents USING (doc_id) LEFT JOIN f USING (k)""")
def near_dup_collapse(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("rank"), identity.title_key(first_line()).alias("key"))
    return collapse.collapse(keyed, "doc_id", "rank").select("doc_id", "kept")


@register("seen_or_similar_title", f"""WITH {PAIRS_SQL}, e AS (SELECT DISTINCT k.k FROM k JOIN documents USING (doc_id) WHERE source <> 'web' AND k.k <> '')
    SELECT doc_id AS id, CASE WHEN k.k <> '' AND (k.k IN (SELECT k FROM e) OR k.k IN (SELECT a FROM p JOIN e ON e.k = p.b)) THEN 'title' END AS seen_kind FROM k""")
def seen_or_similar_title(spark, sf_dir):
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", identity.title_key(first_line()).alias("key"))
    entries = docs.where(F.col("source") != "web").select(none.alias("work_id"), none.alias("doi"), none.alias("preprint_id"), "key", F.lit("2026-08-01").cast("date").alias("published_on"), F.col("doc_id").alias("entry_idx"))
    asked = docs.select(F.col("doc_id").alias("id"), none.alias("work_id"), none.alias("doi"), none.alias("preprint_id"), "key")
    return ledger.seen_or_similar(asked, entries, F.lit("2026-08-19").cast("date")).select("id", "seen_kind")


@register("indexed_similar_titles", f"""WITH {PAIRS_SQL}, e AS (SELECT DISTINCT k FROM k WHERE doc_id % 2 = 0 AND k <> ''), a AS (SELECT DISTINCT k FROM k WHERE doc_id % 2 = 1 AND k <> '')
    SELECT p.a, p.b FROM p JOIN a ON a.k = p.a JOIN e ON e.k = p.b""")
def indexed_similar_titles(spark, sf_dir):
    """Titles of odd documents against an index of the even ones, made in two steps: half the titles at first, the rest added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", identity.title_key(first_line()).alias("key"))
    path, others = scratch(spark, "titles"), docs.where("doc_id % 2 = 0")
    gram_index.create(spark, path, others.where("doc_id % 4 = 0"))
    gram_index.append(spark, path, others)
    return gram_index.similar(spark, path, docs.where("doc_id % 2 = 1"))


@register("word_counts", f"SELECT doc_id, coalesce(len({WORDS_SQL}), 0)::INT AS countable, coalesce(len({LETTERS_SQL}), 0)::INT AS words FROM documents")
def word_counts(spark, sf_dir):
    n = lambda pattern: F.coalesce(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", n(prose.COUNTABLE).alias("countable"), n(prose.LETTERS).alias("words"))


ENGLISH_SQL = ", ".join(f"'{w}'" for w in sorted(set(prose.ENGLISH_WORDS) - set(prose.AMBIGUOUS)))


@register("english_function_share", f"SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: list_contains([{ENGLISH_SQL}], t)))::DOUBLE / len(w) ELSE 0.0 END AS share FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}''’]+') AS w FROM documents)")
def english_function_share(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(prose.LETTERS), F.lit(0))
    hits = F.size(F.filter("w", lambda t: t.isin(*sorted(set(prose.ENGLISH_WORDS) - set(prose.AMBIGUOUS)))))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.when(F.size("w") > 0, hits / F.size("w")).otherwise(0.0).alias("share"))


PLAIN_SQL = "x AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"


@register("sentence_split", f"WITH {PLAIN_SQL}, {prose_sql.sentences('x', 's')} SELECT id AS doc_id, a AS start, b AS end FROM s")
def sentence_split(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(prose.sentences(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.start", "s.end")


@register("syllables", f"SELECT word, count(*) AS n, any_value({prose_sql.syllables('word')}) AS syllables FROM (SELECT unnest({LETTERS_SQL}) AS word FROM documents) GROUP BY 1")
def syllables(spark, sf_dir):
    """Each distinct word once."""
    words = table(spark, sf_dir, "documents").select(F.explode(prose.words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", prose.syllables(F.col("word")).alias("syllables"))


METRICS = "n_sentences n_words mean_sentence_words longest_sentence_words long_sentences mean_syllables share_4_syllables share_5_syllables passive_share reflexive_share composite".split()


@register("readability", f"WITH {PLAIN_SQL}, {prose_sql.readability('x')} SELECT id AS doc_id, {', '.join(METRICS)}, array_to_string({prose_sql.broken_rules()}, ',') AS findings FROM metrics")
def readability(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", prose.readability(F.col("text")).alias("m"))
    broken = F.array_join(F.transform(prose.readability_findings(F.col("m")), lambda f: F.concat_ws(":", f["rule"], f["severity"])), ",")
    return scored.select("doc_id", *[f"m.{k}" for k in METRICS], broken.alias("findings"))


@register("english_findings", f"WITH {PLAIN_SQL}, {prose_sql.english('x')} SELECT id AS doc_id, rule, severity, a AS start, b AS end FROM english")
def english_findings(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(prose.english_findings(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.*")


#: Sentences that documents are given, as their own words have none of the lexicons.
LEADS = [
    "Tento revoluční objev mění pravidla hry, protože buňky (novel cells) rostou rychleji.", "Zlomový okamžik přišel v roce 2019. Medián, tedy prostřední hodnota ze všech čísel, klesl o 12 %.",
    "Průlomová bolest není průlom v léčbě; masivní hvězda je ovšem obrovská.", "Cena klesla o 9 %, což znamená jednu korunu z jedenácti. Nová éra? Historický průlom!",
    "Neuronová síť – počítačový program, který se učí z příkladů – je slibný nástroj.", "Statisticky velmi významný rozdíl měl p < 0,05 a poměr šancí (odds ratio) 1,4.",
    "This groundbreaking, state-of-the-art study of the sleep of the children shows what we have known.", "Korelace není kauzalita. Randomizovaná studie RCT měla 40 starších dětí a kontrolní skupinu.",
    "Raketový nárůst cen, první-ever a once-and-for-all: game–changing novinka za 3,5 milionu.", "Děti stavěly na louce dřevěný domek.", "Medián příjmu vzrostl dvojnásobně; nadějné výsledky jsou zcela zásadní, např. pro mRNA (tedy poselskou kyselinu v buňce).",
]
LEAD_SQL = f"x AS MATERIALIZED (SELECT doc_id AS id, [{prose_sql.some(LEADS)}][doc_id % {len(LEADS)} + 1] || chr(10) || coalesce(text, '') AS text FROM documents)"


def led(spark, sf_dir):
    """Every document after a lead sentence of its own."""
    lead = F.get(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % len(LEADS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@register("overstatements", f"WITH {LEAD_SQL}, {prose_sql.overstated('x')} SELECT id AS doc_id, rule, severity, a AS start, b AS end FROM overstated")
def overstatements(spark, sf_dir):
    """All 118 entries over whole texts."""
    return led(spark, sf_dir).select("doc_id", F.explode(lexicon.overstatements(F.col("text"))).alias("f")).select("doc_id", "f.*")


@register("unexplained_terms")
def unexplained_terms(spark, sf_dir):
    """The first uses of the 86 terms that lack a gloss or the original."""
    return style.gloss_findings(led(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(0).alias("block"), "text")).withColumnRenamed("doc", "doc_id")


HEADED_SQL = f"""h1 AS MATERIALIZED (SELECT doc_id AS id, {prose_sql.mask("coalesce(text, '')", f'https?://{prose.SOLID}+')} AS t, array_to_string(string_split_regex(split_part(coalesce(text, ''), chr(10), 1), '\\s+')[2:9], ' ') AS title FROM documents),
    x AS MATERIALIZED (SELECT id, lower({prose_sql.mask('t', f'10[.][0-9]{{4,9}}/{prose.SOLID}+')}) AS text, lower(title) AS title FROM h1)"""


@register("title_echoes", f"WITH RECURSIVE {HEADED_SQL}, {prose_sql.echoed('x')} SELECT id AS doc_id, a AS start, b AS end FROM echoed")
def title_echoes(spark, sf_dir):
    """Where a document repeats its heading: the second to the ninth word of its first line, a-z in capitals."""
    title = F.translate(F.array_join(F.slice(F.split(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), r"\s+"), 2, 8), " "), string.ascii_lowercase, string.ascii_uppercase)
    found = echoes.echoes(table(spark, sf_dir, "documents").select("doc_id", prose.masked(F.col("text")).alias("text"), title.alias("title")), ["doc_id"], "text", "title")
    return found.select("doc_id", F.explode("echoes").alias("e")).select("doc_id", "e.start", "e.end")


@register("style_status")
def style_status(spark, sf_dir):
    """The five checks over each document after its lead sentence, as one block, and the status that follows."""
    blocks = led(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(style.BLOCKS[1]).alias("block"), "text", F.lit(None).cast("string").alias("title"))
    return style.statuses(blocks, style.findings(blocks)).withColumnRenamed("doc", "doc_id")


@register("unanchored_numbers")
def unanchored_numbers(spark, sf_dir):
    found = led(spark, sf_dir).select("doc_id", F.explode(anchors.unanchored(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.severity", "f.start", "f.end")


MONTHS_SQL = "['January','February','March','April','May','June','July','August','September','October','November','December']"
WHEN_SQL = f"day(date) || '. ' || {MONTHS_SQL}[month(date)] || ' ' || year(date)"
HEAD_SQL = "'<!doctype html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head><meta charset=\"utf-8\"><title>' || {0} || '</title></head>' || chr(10) || '<body>' || chr(10)"
TAIL_SQL = "chr(10) || '</body>' || chr(10) || '</html>' || chr(10)"
PAGE_ROWS_SQL = f"""WITH a AS (SELECT o_orderdate::DATE AS date, o_orderkey AS rank, '<article>' || chr(10) || '<h2>Order ' || o_orderkey || '</h2>' || chr(10) || '<p>' || o_orderpriority || '</p>' || chr(10) || '<p>' || o_orderstatus || '</p>' || chr(10) || '</article>' AS html FROM orders),
    d AS (SELECT date, string_agg(html, chr(10) ORDER BY rank) AS body FROM a GROUP BY 1) SELECT date, {HEAD_SQL.format(WHEN_SQL)} || '<h1>' || {WHEN_SQL} || '</h1>' || chr(10) || body || {TAIL_SQL} AS html FROM d"""


@register("day_pages", PAGE_ROWS_SQL)
def day_pages(spark, sf_dir):
    """Every day of orders as a page."""
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("url"), F.array(F.col("o_orderpriority")).alias("authors"), F.col("o_orderstatus").alias("summary"), F.lit(None).cast("string").alias("notes"))
    return render.day_pages(entries, "en").select("date", "html")


@register("index_page", f"""WITH d AS (SELECT o_orderdate::DATE AS date, min(o_orderpriority) AS category, min(o_clerk_) AS title FROM (SELECT *, 'O' || o_orderkey AS o_clerk_ FROM orders) GROUP BY 1),
    i AS (SELECT date, '<li data-cat="' || category || '"><a href="archive/' || date || '.html"><time>' || {WHEN_SQL} || '</time></a><ul><li>' || title || '</li></ul><a href="archive/' || date || '.html">Open this day</a></li>' AS html FROM d)
    SELECT {HEAD_SQL.format("'Digest'")} || '<h1>Digest</h1>' || chr(10) || '<p>New papers, explained.</p>' || chr(10) || '<ol>' || chr(10) || string_agg(html, chr(10) ORDER BY date DESC) || chr(10) || '</ol>' || {TAIL_SQL} AS html FROM i""")
def index_page(spark, sf_dir):
    """All days of orders in the index, the newest first."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.min("o_orderpriority").alias("category"), F.array(F.min(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")))).alias("titles"))
    return render.index_page(days, "en")
