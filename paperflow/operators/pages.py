"""What a rendered page would load or run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules on style sheets and on markup.
CSS = ((r"(?i)@import", "css import"), (r"(?i)url\(\s*['\"]?(?!data:)", "css url"))
MARKUP = (
    (r"(?i)<link\b", "link"),
    (r"(?i)<script\b[^>]*\bsrc=", "script src"),
    (r"(?i)<(?:img|iframe|video|audio|object|embed|source|base)\b", "remote element"),
    (r"localStorage|sessionStorage|indexedDB", "storage"),
    (r"(?i)\son[a-z]+\s*=", "inline handler"),
)


def violations(html: Column) -> Column:
    """Labels of the rules that a page breaks; text between tags does not count, and links in anchors are allowed."""
    css = F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<style\b[^>]*>((?s:.*?))</style>"), F.lit(1)), "\n")
    markup = F.regexp_replace(html, ">[^<]*<", "><")
    anchored = F.regexp_replace(markup, r"(?i)<a\b[^>]*>|</a>", "")
    found = [F.when(css.rlike(p), F.lit(n)) for p, n in CSS] + [F.when(markup.rlike(p), F.lit(n)) for p, n in MARKUP] + [F.when(anchored.rlike("https?://"), F.lit("remote url"))]
    return F.array_compact(F.array(*found))
