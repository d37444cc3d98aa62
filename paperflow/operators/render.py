"""Pages as rows: every archived day and the index in one grouped query each, from the records alone, so that a whole archive is written anew at will."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.functions.text import author_line, escape_html, paragraphs
from paperflow.functions.urls import http_url

#: Texts of a language; a missing language or text is an error, not a blank.
STRINGS = {
    "en": {"site": "Digest", "intro": "New papers, explained.", "open": "Open this day", "empty": "No days yet.", "limits": "Limits", "months": "January February March April May June July August September October November December"},
    "cs": {"site": "Přehled", "intro": "Nové práce srozumitelně.", "open": "Otevřít den", "empty": "Zatím žádný den.", "limits": "Omezení", "months": "ledna února března dubna května června července srpna září října listopadu prosince"},
}


def strings(language: str) -> dict[str, str]:
    if language not in STRINGS:
        raise ValueError(f"no texts for {language!r}")
    return STRINGS[language]


#: What a reader is told of a source that failed; another source has the last sentence.
DEGRADATIONS = {
    "en": {"works": "One source of papers could not be read.", "arxiv": "Preprints could not be read.", "lookup": "Short summaries could not be looked up.", "generation": "A paper could not be explained and was replaced or left out.", "budget": "The day's budget ran out.", "": "A part of this day is missing."},
    "cs": {"works": "Jeden ze zdrojů se nepodařilo přečíst.", "arxiv": "Preprinty se nepodařilo přečíst.", "lookup": "Krátká shrnutí se nepodařilo dohledat.", "generation": "Jednu práci se nepodařilo vysvětlit.", "budget": "Denní rozpočet se vyčerpal.", "": "Část dne chybí."},
}


def degradation_text(source: str, language: str) -> str:
    strings(language)
    return DEGRADATIONS[language].get(source, DEGRADATIONS[language][""])


def date_text(day: Column, language: str) -> Column:
    """19. srpna 2026"""
    months = F.array(*map(F.lit, strings(language)["months"].split()))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(months, F.month(day)), F.lit(" "), F.year(day).cast("string"))


def link(url: Column, label: Column) -> Column:
    safe = http_url(url)
    return F.when(safe.isNull(), escape_html(label)).otherwise(F.concat(F.lit('<a href="'), escape_html(safe), F.lit('" rel="noopener">'), escape_html(label), F.lit("</a>")))


def fill(template: str, **slots: Column) -> Column:
    """`template` with its {slots} filled; unknown ones stay as they are."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def document(language: str, title: Column, body: Column) -> Column:
    head = f'<!doctype html>\n<html lang="{language}">\n<head><meta charset="utf-8"><title>'
    return F.concat(F.lit(head), escape_html(title), F.lit("</title></head>\n<body>\n"), body, F.lit("\n</body>\n</html>\n"))


def day_pages(entries: DataFrame, language: str = "cs") -> DataFrame:
    """(date, html) of entries (date, rank, title, url, authors, summary, notes): a day's entries by rank, then one sentence for each distinct note."""
    words = strings(language)
    article = F.concat(F.lit("<article>\n<h2>"), link(F.col("url"), F.col("title")), F.lit("</h2>\n<p>"), escape_html(author_line(F.coalesce("authors", F.array().cast("array<string>")))), F.lit("</p>\n"), paragraphs(F.coalesce("summary", F.lit(""))), F.lit("\n</article>"))
    days = entries.select("date", "rank", article.alias("html"), "notes").groupBy("date").agg(F.sort_array(F.collect_list(F.struct("rank", "html"))).alias("a"), F.sort_array(F.collect_set("notes")).alias("n"))
    notes = F.array_join(F.transform("n", lambda s: F.concat(F.lit("<p>"), escape_html(s), F.lit("</p>"))), "\n")
    footer = F.when(F.size("n") > 0, F.concat(F.lit(f"\n<footer>\n<h2>{words['limits']}</h2>\n"), notes, F.lit("\n</footer>"))).otherwise("")
    when = date_text(F.col("date"), language)
    body = F.concat(F.lit("<h1>"), when, F.lit("</h1>\n"), F.array_join(F.transform("a", lambda x: x["html"]), "\n"), footer)
    return days.select("date", document(language, when, body).alias("html"))


def index_page(days: DataFrame, language: str = "cs", href: str = "archive/{date}.html") -> DataFrame:
    """One row, html, of days (date, category, titles), the newest first. It has one line a day, however large the archive's days are."""
    words = strings(language)
    titles = F.array_join(F.transform(F.coalesce("titles", F.array().cast("array<string>")), lambda t: F.concat(F.lit("<li>"), escape_html(t), F.lit("</li>"))), "")
    item = fill(f'<li data-cat="{{category}}"><a href="{href}"><time>{{when}}</time></a><ul>{{titles}}</ul><a href="{href}">{words["open"]}</a></li>', category=escape_html(F.col("category")), date=F.col("date").cast("string"), when=date_text(F.col("date"), language), titles=titles)
    rows = days.select("date", item.alias("html")).agg(F.sort_array(F.collect_list(F.struct("date", "html")), asc=False).alias("a"))
    listed = F.when(F.size("a") > 0, F.concat(F.lit("<ol>\n"), F.array_join(F.transform("a", lambda x: x["html"]), "\n"), F.lit("\n</ol>"))).otherwise(f"<p>{words['empty']}</p>")
    return rows.select(document(language, F.lit(words["site"]), F.concat(F.lit(f"<h1>{words['site']}</h1>\n<p>{words['intro']}</p>\n"), listed)).alias("html"))
