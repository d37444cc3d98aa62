"""SQL that states the rules of prose by tables of tokens: ends of sentences, masks, syllables, runs of words, stems."""

from __future__ import annotations

from collections.abc import Iterable

from paperflow.functions import lexicon, prose
from paperflow.functions.stems import ANY, EXACT, LONGER, form

B = prose.BLANK
LETTERS, COUNTABLE = r"[\p{L}''’]+", r"[\p{L}\p{N}][\p{L}\p{N}''’-]*"


def some(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+$', '')"


def low(x: str) -> str:
    """Lower case at the same length."""
    return f"replace(lower(replace({x}, 'İ', chr(65535))), chr(65535), 'İ')"


def sentences(source: str, name: str) -> str:
    """CTEs that end in `name` (id, k, a, b, body): the sentences of `source` (id, text), from a table of the runs of . ! ? … and one of line breaks."""
    n, words = name, f"regexp_extract(before, '[\\p{{L}}\\p{{N}}.]*$')"
    cut = lambda what: f"SELECT id, text, unnest(string_split_regex(text, '{what}')[:len(regexp_extract_all(text, '{what}'))]) AS piece, unnest(regexp_extract_all(text, '{what}')) AS run, unnest(range(len(regexp_extract_all(text, '{what}')))) AS k FROM {source}"
    return f"""{n}_r AS MATERIALIZED (SELECT id, text, run, sum(length(piece) + length(run)) OVER (PARTITION BY id ORDER BY k) AS b FROM ({cut('[.!?…]+')})),
    {n}_c AS (SELECT *, substr(text, greatest(b - length(run) - 15, 1)::BIGINT, least(16, b - length(run))::BIGINT) AS before, substr(text, b::BIGINT + 1, 400) AS after FROM {n}_r),
    {n}_e AS (SELECT id, b FROM {n}_c WHERE regexp_matches(after, '^(?:$|{B}+(?:$|[\\p{{Lu}}\\p{{N}}{prose.OPENING_QUOTES.replace("'", "''")}]))')
      AND lower({words}) NOT IN ({some(prose.ABBREVIATIONS)}) AND lower({words} || run) NOT IN ({some(prose.ABBREVIATIONS)})
      AND NOT (run = '.' AND regexp_matches(right(before, 8), '\\p{{N}}{B}*$') AND regexp_matches(left(after, 8), '^{B}*\\p{{N}}'))
      AND NOT (run = '.' AND regexp_matches(before, '\\p{{N}}$') AND NOT (regexp_matches(after, '^{B}*\\p{{Lu}}') AND lower(regexp_extract(after, '^{B}*(\\p{{L}}+)', 1)) NOT IN ({some(prose.MONTHS)})))
      AND NOT (run = '.' AND regexp_matches(before, '(?:^|[^\\p{{L}}])\\p{{Lu}}$'))),
    {n}_l AS (SELECT id, sum(length(piece) + length(run)) OVER (PARTITION BY id ORDER BY k) AS b FROM ({cut(chr(10) + '+')})),
    {n}_b AS (SELECT id, b FROM {n}_e UNION SELECT id, b FROM {n}_l UNION SELECT id, length(text) FROM {source}),
    {n}_p AS (SELECT id, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY b) AS a, b FROM {n}_b),
    {n}_t AS (SELECT p.id, p.a, substr(text, p.a::BIGINT + 1, (p.b - p.a)::BIGINT) AS piece FROM {n}_p p JOIN {source} s ON s.id = p.id),
    {n}_u AS (SELECT id, a + length(piece) - length(regexp_replace(piece, '^{B}+', '')) AS a, {strip('piece')} AS body FROM {n}_t),
    {name} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a) AS k, a::INT AS a, (a + length(body))::INT AS b, body FROM {n}_u WHERE body <> '')"""


def syllables(word: str) -> str:
    """A word's syllables, letter by letter."""
    v = f"[{prose.VOWELS}]"
    letters = f"regexp_replace({low(word)}, '[^\\p{{L}}]', '', 'g')"
    prefixes = "|".join(sorted(prose.PREFIXES, key=len, reverse=True))
    body = f"replace(regexp_replace(regexp_replace({letters}, '^({prefixes})({v})', '\\1|\\2'), 'ou|au|eu', '#', 'g'), '|', '')"
    vowel = lambda at: f"contains('{prose.VOWELS}#', x[{at}])"
    count = f"len(list_filter(range(1, length(x) + 1), lambda i: {vowel('i')} OR (i > 1 AND NOT {vowel('i - 1')} AND ((x[i] IN ('r', 'l') AND (i = length(x) OR NOT {vowel('i + 1')})) OR (x[i] = 'm' AND i = length(x))))))"
    return f"list_transform([{body}], lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, {count}) END)[1]::INT"


PASSIVE = f"(?:^|[^\\p{{L}}]){any_of(prose.AUXILIARIES)}{B}+(?:\\p{{L}}+{B}+){{0,2}}(\\p{{L}}*{any_of(prose.PARTICIPLE_ENDINGS)})(?:$|[^\\p{{L}}])"
REFLEXIVE = f"(?:^|[^\\p{{L}}])se{B}+\\p{{L}}+?{any_of(prose.REFLEXIVE_ENDINGS)}(?:$|[^\\p{{L}}])"
#: What parts words stands twice, so that a match takes none of it from the next.
APART = "regexp_replace({0}, '([^\\p{{L}}])', '\\1\\1', 'g')"


def readability(source: str) -> str:
    """CTEs that end in metrics (id and the struct's fields) of `source` (id, text)."""
    passive = f"len(list_filter(regexp_extract_all({APART.format('body')}, '{PASSIVE}', 1), lambda w: length(w) >= {prose.PARTICIPLE_CHARS} AND lower(w) NOT IN ({some(prose.NOT_PARTICIPLES)}) AND NOT regexp_matches(lower(w), 'ostí?$'))) > 0"
    return f"""{sentences(source, 'st')},
    sm AS (SELECT id, count(*) AS n_sentences, sum(len(regexp_extract_all(body, '{COUNTABLE}'))) AS n_words, max(len(regexp_extract_all(body, '{COUNTABLE}'))) AS longest, count(*) FILTER (len(regexp_extract_all(body, '{COUNTABLE}')) > {prose.LONG_SENTENCE_WORDS}) AS long_,
      count(*) FILTER ({passive}) AS passive, count(*) FILTER (regexp_matches(body, '{REFLEXIVE}')) AS reflexive FROM st GROUP BY 1),
    wd AS MATERIALIZED (SELECT id, unnest(regexp_extract_all(text, '{COUNTABLE}')) AS w FROM {source}),
    sy AS MATERIALIZED (SELECT w, {syllables('w')} AS c FROM (SELECT DISTINCT w FROM wd WHERE regexp_matches(w, '\\p{{L}}'))),
    wm AS (SELECT id, count(*) AS said, sum(c) AS c, count(*) FILTER (c >= 4) AS c4, count(*) FILTER (c >= 5) AS c5 FROM wd JOIN sy USING (w) GROUP BY 1),
    mm AS (SELECT s.id, coalesce(n_sentences, 0)::INT AS n_sentences, coalesce(n_words, 0)::INT AS n_words, coalesce(n_words / n_sentences, 0)::DOUBLE AS mean_sentence_words, coalesce(longest, 0)::INT AS longest_sentence_words, coalesce(long_, 0)::INT AS long_sentences,
      coalesce(c / said, 0)::DOUBLE AS mean_syllables, coalesce(c4 / said, 0)::DOUBLE AS share_4_syllables, coalesce(c5 / said, 0)::DOUBLE AS share_5_syllables, coalesce(passive / n_sentences, 0)::DOUBLE AS passive_share, coalesce(reflexive / n_sentences, 0)::DOUBLE AS reflexive_share
      FROM {source} s LEFT JOIN sm USING (id) LEFT JOIN wm USING (id)),
    metrics AS (SELECT *, 100 - (2e0 * mean_sentence_words + 25 * (mean_syllables - 2e0)) AS composite FROM mm)"""


def broken_rules() -> str:
    """A list of 'rule:severity' of the rules that a row of metrics breaks."""

    def level(metric: str, warn: float, hard: float | None, below: bool) -> str:
        beyond = lambda limit: f"{metric} {'<' if below else '>'} {limit}e0"
        return "CASE " + (f"WHEN {beyond(hard)} THEN 'hard' " if hard is not None else "") + f"WHEN {beyond(warn)} THEN 'warn' END"

    each = ", ".join(f"'{rule}:' || {level(*limits)}" for rule, limits in prose.READABILITY.items())
    return f"CASE WHEN n_sentences > 0 THEN list_filter([{each}], lambda x: x IS NOT NULL) ELSE [] END"


def mask(x: str, pattern: str) -> str:
    """A text with the matches overwritten that have no mask yet."""
    m = prose.MASK
    return f"list_transform([{x}], lambda t: array_to_string(list_transform(range(1, len(string_split_regex(t, '{pattern}')) + 1), lambda i: string_split_regex(t, '{pattern}')[i] || coalesce(CASE WHEN contains(regexp_extract_all(t, '{pattern}')[i], '{m}') THEN regexp_extract_all(t, '{pattern}')[i] ELSE repeat('{m}', length(regexp_extract_all(t, '{pattern}')[i])) END, '')), ''))[1]"


def hidden(source: str, name: str) -> str:
    """CTEs that end in `name` (id, text): `source` with addresses, DOIs, parentheses and numbers masked.

    For numbers, all that is no letter or digit stands twice, so that what must stand before and after one is another character for each; then once again."""
    m, s = prose.MASK, f"(?:{B}{{2}}|\\.\\.|,,)"
    number = f"[^\\p{{L}}\\p{{N}}]((?:−−|––|--)?\\p{{N}}(?:\\p{{N}}|{s})*(?:%%|‰‰|××)?)[^\\p{{L}}\\p{{N}}]"
    solid = prose.SOLID
    width = "(2 * length(regexp_replace({0}, '[^\\p{{N}}]', '', 'g')) + length(regexp_replace({0}, '[\\p{{N}}]', '', 'g')))"
    found = f"regexp_extract_all(t, '{number}')[i]"
    return f"""{name}_1 AS MATERIALIZED (SELECT id, {mask('text', f'https?://{solid}+')} AS t FROM {source}), {name}_2 AS MATERIALIZED (SELECT id, {mask('t', f'10[.][0-9]{{4,9}}/{solid}+')} AS t FROM {name}_1),
    {name}_3 AS MATERIALIZED (SELECT id, '  ' || regexp_replace({mask('t', '[(][^()]{0,200}[)]')}, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g') || '  ' AS t FROM {name}_2),
    {name}_4 AS MATERIALIZED (SELECT id, string_split_regex(t, '{number}') AS p, regexp_extract_all(t, '{number}') AS f FROM {name}_3),
    {name}_5 AS (SELECT id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(f[i][1] || repeat('{m}', {width.format("f[i][2:length(f[i]) - 1]")}) || right(f[i], 1), '')), '') AS t FROM {name}_4),
    {name} AS MATERIALIZED (SELECT id, substr(x, 2, length(x) - 2) AS text FROM (SELECT id, regexp_replace(t, '([^\\p{{L}}\\p{{N}}])[^\\p{{L}}\\p{{N}}]', '\\1', 'g') AS x FROM {name}_5))"""


def english(source: str) -> str:
    """CTEs that end in english (id, rule, severity, a, b) of `source` (id, text)."""
    lim, clear = prose.ENGLISH_LIMITS, lambda words: some(sorted(set(words) - set(prose.AMBIGUOUS)))
    marked, ambiguous = "regexp_matches(w, '(?i)[áčďéěíňóřšťúůýž]')", some(prose.AMBIGUOUS)
    return f"""{hidden(source, 'hi')}, {sentences('hi', 'se')},
    ew AS (SELECT id, k, unnest(regexp_extract_all({low('body')}, '{LETTERS}')) AS w FROM se),
    ev AS (SELECT id, k, count(*) AS n, count(*) FILTER (w IN ({clear(prose.CZECH_WORDS)})) AS c, count(*) FILTER ({marked}) AS d, count(*) FILTER (w IN ({clear(prose.ENGLISH_WORDS)})) AS e,
      count(*) FILTER (w NOT IN ({ambiguous}) AND regexp_matches(w, '{any_of(prose.CZECH_ENDINGS)}$')) AS m, count(*) FILTER (w NOT IN ({ambiguous}) AND regexp_matches(w, '{any_of(prose.ENGLISH_ENDINGS)}$') AND NOT {marked}) AS g FROM ew GROUP BY 1, 2),
    ej AS (SELECT se.id, se.a, se.b, n, c, d, (e + 0.5e0 * g) / n AS en, (c + d + 0.5e0 * m) / n AS cz FROM se JOIN ev USING (id, k)),
    es AS (SELECT id, CASE WHEN n >= {lim['min_tokens']} AND en >= {lim['english_hard']}e0 AND cz <= {lim['czech_hard']}e0 AND d = 0 AND c <= {lim['max_czech_words']} THEN 'untranslated' WHEN n >= {lim['mixed_min_tokens']} AND en >= {lim['mixed_warn']}e0 AND d > 0 THEN 'mixed' END AS rule, a, b FROM ej),
    er AS MATERIALIZED (SELECT id, unnest(string_split_regex(t, '{LETTERS}')[:len(regexp_extract_all(t, '{LETTERS}'))]) AS gap, unnest(regexp_extract_all(t, '{LETTERS}')) AS w, unnest(range(len(regexp_extract_all(t, '{LETTERS}')))) AS k FROM (SELECT id, {low('text')} AS t FROM hi)),
    et AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY id ORDER BY k) AS b, NOT regexp_matches(w, '^[ -~]+$') AS foreign_ FROM er),
    ei AS (SELECT *, sum(CASE WHEN foreign_ OR contains(gap, '{prose.MASK}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS island FROM et),
    en AS (SELECT id, 'run' AS rule, min(b - length(w)) AS a, max(b) AS b FROM ei WHERE NOT foreign_ GROUP BY id, island HAVING count(*) >= {lim['run_tokens']} AND count(*) FILTER (w IN ({clear(prose.ENGLISH_WORDS)})) >= {lim['run_english_words']}),
    english AS (SELECT id, rule, CASE WHEN rule = 'mixed' THEN 'warn' ELSE 'hard' END AS severity, a::INT AS a, b::INT AS b FROM (SELECT * FROM es WHERE rule IS NOT NULL UNION ALL SELECT * FROM en))"""


def overstated(source: str) -> str:
    """CTEs that end in overstated (id, rule, severity, a, b) of `source` (id, text): words joined to the first words of forms, then to the others by place."""
    rows, firsts = [], []
    number = 0
    for k, e in enumerate(lexicon.OVERSTATEMENTS):
        for text in e.forms:
            f = form(k, text, *([B] if e.only_blanks else []))
            firsts.append(f"({number}, {len(f.words)}, {k}, '{e.ident}', '{e.severity}', {str(e.english).lower()}, {some([e.require]) if e.require else 'NULL'}, {some([e.reject]) if e.reject else 'NULL'})")
            rows += [f"({number}, {j}, {how}, '{word}', '{f.joints[j - 1] if j else ''}')" for j, (how, word) in enumerate(f.words)]
            number += 1
    meets = f"CASE how WHEN {EXACT} THEN t.w = p.word WHEN {ANY} THEN true WHEN {LONGER} THEN starts_with(t.w, p.word) AND length(t.w) > length(p.word) ELSE starts_with(t.w, p.word) END"
    runs = lambda name, text: f"""{name}_r AS (SELECT id, unnest(string_split_regex(t, '\\p{{L}}+')[:len(regexp_extract_all(t, '\\p{{L}}+'))]) AS gap, unnest(regexp_extract_all(t, '\\p{{L}}+')) AS w, unnest(range(len(regexp_extract_all(t, '\\p{{L}}+')))) AS k FROM (SELECT id, {text})),
    {name} AS MATERIALIZED (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY id ORDER BY k) AS b FROM {name}_r)"""  # noqa: E731
    return f"""of_(form, n, ord, rule, severity, english, req, rej) AS (VALUES {', '.join(firsts)}), op_(form, j, how, word, joint) AS (VALUES {', '.join(rows)}),
    om_1 AS MATERIALIZED (SELECT id, {mask(low('text'), f'https?://{prose.SOLID}+')} AS t FROM {source}), om_2 AS MATERIALIZED (SELECT id, {mask('t', f'10[.][0-9]{{4,9}}/{prose.SOLID}+')} AS t FROM om_1),
    {runs('oc', f"{low('text')} AS t FROM {source}")}, {runs('oe', f"{mask('t', '[(][^()]{0,200}[)]')} AS t FROM om_2")},
    ot AS MATERIALIZED (SELECT false AS english, * FROM oc UNION ALL SELECT true AS english, * FROM oe),
    od AS MATERIALIZED (SELECT t.w, p.form FROM (SELECT DISTINCT w FROM ot) t JOIN op_ p ON p.j = 0 AND {meets}),
    os_ AS MATERIALIZED (SELECT t.id, t.english, t.k, d.form FROM ot t JOIN od d ON d.w = t.w JOIN of_ f ON f.form = d.form AND f.english = t.english),
    og AS (SELECT s.id, s.english, s.form, s.k, min(t.b - length(t.w)) AS a, max(t.b) AS b FROM os_ s JOIN op_ p USING (form) JOIN ot t ON t.id = s.id AND t.english = s.english AND t.k = s.k + p.j AND {meets} AND (p.j = 0 OR regexp_matches(t.gap, p.joint)) JOIN of_ f ON f.form = s.form GROUP BY ALL HAVING count(*) = any_value(f.n)),
    oh AS (SELECT g.id, f.ord, f.rule, f.severity, g.a, g.b, row_number() OVER (PARTITION BY g.id, g.a ORDER BY f.severity = 'warn', g.b DESC, f.ord) AS r FROM og g JOIN of_ f USING (form) JOIN {source} s ON s.id = g.id
      WHERE (f.req IS NULL OR regexp_matches(substr({low('s.text')}, g.b::BIGINT + 1, {lexicon.GUARD_REACH}), f.req)) AND (f.rej IS NULL OR NOT regexp_matches(substr({low('s.text')}, g.b::BIGINT + 1, {lexicon.GUARD_REACH}), f.rej))),
    overstated AS (SELECT id, rule, severity, a::INT AS a, b::INT AS b FROM oh WHERE r = 1)"""


def echoed(source: str) -> str:
    """CTEs that end in echoed (id, a, b) of `source` (id, text, title), all in lower case and masked: places of equal eight characters, cut into runs on a diagonal; of those that no later one betters, in turn."""
    return f"""xt AS MATERIALIZED (SELECT id, unnest(range(length(title) - 7)) AS i, title FROM {source} WHERE length(title) >= 8), xg AS (SELECT id, i, substr(title, i + 1, 8) AS g FROM xt),
    xp AS (SELECT id, unnest(range(length(text) - 7)) AS p, text FROM {source} WHERE length(title) >= 8 AND length(text) >= 8), xh AS MATERIALIZED (SELECT q.id, q.p, xg.i, q.p - xg.i AS d FROM (SELECT id, p, substr(text, p + 1, 8) AS g FROM xp) q JOIN xg ON xg.id = q.id AND xg.g = q.g WHERE NOT contains(q.g, '{prose.MASK}')),
    xi AS (SELECT *, p - row_number() OVER (PARTITION BY id, d ORDER BY p) AS island FROM xh), xn AS (SELECT *, max(p) OVER (PARTITION BY id, d, island) - p + 8 AS n FROM xi),
    xb AS (SELECT *, max((n, -i, -p)) OVER (PARTITION BY id ORDER BY p DESC) AS best FROM xn), xs AS MATERIALIZED (SELECT id, p, p + n AS e, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM xb WHERE best = (n, -i, -p)),
    xr(id, k, p, e, free, taken) AS (SELECT id, k, p, e, e, true FROM xs WHERE k = 1 UNION ALL SELECT xs.id, xs.k, xs.p, xs.e, CASE WHEN xs.p >= xr.free THEN xs.e ELSE xr.free END, xs.p >= xr.free FROM xr JOIN xs ON xs.id = xr.id AND xs.k = xr.k + 1),
    echoed AS (SELECT id, p::INT AS a, e::INT AS b FROM xr WHERE taken)"""
