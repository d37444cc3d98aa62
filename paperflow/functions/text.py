"""Tokens, previews and markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperflow.functions.identity import squeeze
from paperflow.tables import let

#: A token ends in a letter, a digit or a plus; the marks after it belong to none.
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}'’+._-]*[\p{L}\p{N}+])?"
JARGON_CHARS = 14


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_jargon(token: Column) -> Column:
    return (F.length(token) >= JARGON_CHARS) | (token.rlike(r"\p{N}") & token.rlike(r"\p{L}"))


def share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) == 0, 0.0).otherwise(F.size(part) / F.size(whole))


def inverted_index_like(text: Column) -> Column:
    """An abstract that is an index which nobody turned back into text."""

    n_words, n_numbers = F.regexp_count(text, F.lit(r"\S++")), F.regexp_count(text, F.lit(r"(?=[0-9])(?<!\S)[0-9]++[,;\]]?(?!\S)"))
    # half of ten words or more: with fewer than five numbers, words need not be counted
    by_words = let(n_numbers, lambda m: F.when(m < 5, False).otherwise(let(n_words, lambda n: (n >= 10) & (m * 2 >= n))))
    as_object = F.contains(text, F.lit("{")) & text.rlike(r'(?s)^\s*\{.*"\s*:\s*\[')
    return as_object | text.rlike(r"(?=[iI])(?i:inverted[_\s]?index|indexlength)") | by_words


def preview(text: Column, at_end: bool = False) -> Column:
    """The first sentence if it has 20 to 180 characters, else the first 157 with an ellipsis. `at_end`: the text's end ends a sentence too."""
    return let(squeeze(text), lambda t: _preview(t, r"(?s)^.{19,179}?[.!?](?=\s|\z)" if at_end else r"(?s)^.{19,179}?[.!?](?=\s)"))


def _preview(t: Column, pattern: str) -> Column:
    sentence = F.regexp_extract(t, pattern, 0)
    return F.when(sentence != "", sentence).when(F.length(t) <= 160, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, 157)), F.lit("…")))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def paragraphs(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), squeeze), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "\n")


def author_line(authors: Column, most: int = 6, rest: str = "and others") -> Column:
    shown = F.array_join(F.slice(authors, 1, most), ", ")
    return F.when(F.size(authors) > most, F.concat_ws(" ", shown, F.lit(rest))).otherwise(shown)


def redact(url: Column) -> Column:
    return F.regexp_replace(url, r"(?i)([?&](?:api_?key|key|token)=)[^&]*", "$1***")


@F.pandas_udf(StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC. Only texts with combining marks or characters of a compatibility form go to Python."""
    # what lies below U+0300 is asked first, as nearly all characters do
    apart = text.rlike(r"[\x{0300}-\x{10FFFF}&&[\p{M}\x{0340}-\x{0387}\x{0958}-\x{0FB9}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}-\x{232A}\x{2ADC}\x{F900}-\x{FB4E}]]")
    return F.coalesce(_composed(F.when(apart, text)), text)


#: Signs that `quote_form` spells in one way, and how.
TYPED, PLAIN = "“”„‟″«»‘’‚‛′´`–—‑−‐", "\"" * 7 + "'" * 7 + "-" * 5


def quote_form(text: Column) -> Column:
    """One spelling of quotes, dashes, ellipses and blanks, in lower case, so that a copy is found however it was typed. Null is empty."""
    given = F.coalesce(text, F.lit(""))
    # most texts have none of the signs, and a translation looks each character up
    plain = F.when(F.contains(given, F.lit("`")) | given.rlike(rf"[\x{{ab}}-\x{{2212}}&&[{TYPED}]]"), F.translate(given, TYPED, PLAIN)).otherwise(given)
    return F.lower(squeeze(F.replace(plain, F.lit("…"), F.lit("..."))))
