"""Identifiers and titles in the forms that are compared."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperflow.tables import let

#: Blanks as feeds have them, beyond ASCII.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same; whether a character is printable ASCII is read first. Runs of them that are not one space already.
_SPACE = f"[[^!-~]&&{SPACE}]"
_RUN = f"{_SPACE}(?:(?<! )|(?={_SPACE})){_SPACE}*+"


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def normalise_doi(raw: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")
    return _filled(F.regexp_replace(bare, r"[.,)\s]+$", ""))


def bare_doi(raw: Column) -> Column:
    """The source layer's form, which strips one prefix alone."""
    return _filled(F.lower(F.regexp_replace(F.trim(raw), r"(?i)^https://doi\.org/", "")))


def normalise_work_id(raw: Column) -> Column:
    bare = F.regexp_replace(F.trim(raw), r"(?i)^https?://(?:api\.)?openalex\.org/(?:works/)?", "")
    return _filled(F.upper(F.regexp_replace(bare, r"(?i)^openalex:", "")))


def normalise_preprint_id(raw: Column) -> Column:
    out = F.lower(F.trim(raw))
    for pattern in (r"^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/", "^arxiv:", r"\.pdf$", r"v[0-9]+$"):
        out = F.regexp_replace(out, pattern, "")
    return _filled(out)


def bare_work_id(raw: Column) -> Column:
    """The source layer's form, which strips one prefix alone."""
    return F.regexp_replace(raw, r"^https://openalex\.org/", "")


def preprint_id_from_url(url: Column) -> Column:
    tail = F.regexp_extract(url, r"arxiv\.org/abs/(.*)$", 1)
    return F.regexp_replace(F.when(tail != "", tail).otherwise(url), r"v[0-9]+$", "")


def _key(text: str | None, form: str) -> str | None:
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize(form, text) if unicodedata.category(c)[0] != "M").lower()
    return "".join(c for c in plain if c.isascii() and c.isalnum())


@F.pandas_udf(StringType())
def _decomposed_key(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in titles:
        yield s.map(lambda t: _key(t, "NFD"), na_action="ignore")


@F.pandas_udf(StringType())
def _compatible_key(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in titles:
        yield s.map(lambda t: _key(t, "NFKD"), na_action="ignore")


def _by_alphabet(title: Column, udf) -> Column:
    """ASCII in the JVM; only the other titles go to Python."""
    ascii_ = ~title.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.when(ascii_, F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")), udf(F.when(~ascii_, title)))


def title_key(title: Column) -> Column:
    """Letters a-z and digits of the title, without accents (canonical decomposition)."""
    return _by_alphabet(title, _decomposed_key)


def merge_key(title: Column) -> Column:
    """As title_key, by compatibility decomposition: ligatures and superscripts come apart."""
    return _by_alphabet(title, _compatible_key)


def every_trigram(key: Column) -> Column:
    """Runs of three characters, repeats included; none if the key is shorter."""
    return F.regexp_extract_all(key, F.lit("(?s)(?=(...))"), F.lit(1))


def trigrams(key: Column) -> Column:
    """Distinct runs of three characters; none if the key is shorter."""
    return F.array_distinct(every_trigram(key))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    share = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))
    return F.when(a == b, F.when(a == "", 0.0).otherwise(1.0)).otherwise(share)


def inverted_index(words: Column) -> Column:
    """map<string, array<int>> of an array of words: each with its places, ascending. Null without words.

    Places are sorted by their words' hashes, once a row, so no text is shuffled and none is compared word by word."""

    def grouped(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(F.get(s, k - 1)["word"] != F.get(s, k)["word"], F.lit(True)))
        entry = lambda a, b: F.struct(F.get(s, a)["word"].alias("word"), F.transform(F.slice(s, a + 1, b - a), lambda x: x["place"]).alias("places"))
        return let(begins, lambda at: F.map_from_entries(F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s))), entry)))

    def placed(w: Column) -> Column:
        """Words and places in the order of the words' hashes, as numbers; by the words themselves where two words share a hash."""
        keys = F.sort_array(F.transform(w, lambda x, k: F.shiftleft(F.hash(x).cast("bigint"), 32) + k))
        by_hash = lambda h: F.transform(h, lambda k: let(k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), lambda p: F.struct(F.get(w, p).alias("word"), p.alias("place"))))
        by_word = F.sort_array(F.transform(w, lambda x, k: F.struct(x.alias("word"), k.alias("place"))))
        mixed = lambda h: F.exists(F.sequence(F.lit(1), F.size(h) - 1), lambda k: (F.shiftright(F.get(h, k - 1), 32) == F.shiftright(F.get(h, k), 32)) & (F.get(w, F.get(h, k - 1).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")) != F.get(w, F.get(h, k).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))))
        return let(keys, lambda h: F.when((F.size(h) > 1) & mixed(h), by_word).otherwise(by_hash(h)))

    return let(words, lambda w: F.when(F.size(w) > 0, let(placed(w), grouped)))


def reconstruct(index: Column) -> Column:
    """Text of an inverted index (map<string, array<int>>): words by place, the first to claim a place has it.

    Words that are whole numbers come first, by value, as they do where the index is made. A claim is one number, its place before its word's, so that sorting compares numbers."""
    whole = lambda e: (e["key"] >= "0") & (e["key"] < ":") & e["key"].rlike("^(?:0|[1-9][0-9]{0,9})$")
    plain = lambda e: F.struct(e["key"].alias("word"), e["value"].alias("at"))

    def by_value(entries: Column) -> Column:
        keyed = F.transform(entries, lambda e, n: let(whole(e), lambda w: F.struct(F.when(w, 0).otherwise(1).alias("late"), F.when(w, e["key"].cast("bigint")).otherwise(n.cast("bigint")).alias("by"), e["key"].alias("key"), e["value"].alias("value"))))
        return F.transform(F.sort_array(keyed), plain)

    def claims(entries: Column) -> Column:
        each = F.transform(entries, lambda e, n: F.transform(F.filter(e["at"], lambda p: p >= 0), lambda p: F.shiftleft(p.cast("bigint"), 32) + n))
        return F.struct(F.transform(entries, lambda e: e["word"]).alias("words"), F.sort_array(F.flatten(each)).alias("claims"))

    def firsts(x: Column) -> Column:
        place = lambda c: F.shiftright(c, 32)
        new = F.filter(x["claims"], lambda c, k: F.coalesce(place(F.get(x["claims"], k - 1)) != place(c), F.lit(True)))
        return F.array_join(F.transform(new, lambda c: F.get(x["words"], c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))), " ")

    ordered = lambda entries: F.when(F.exists(entries, whole), by_value(entries)).otherwise(F.transform(entries, plain))
    return _filled(squeeze(let(let(let(F.map_entries(index), ordered), claims), firsts)))


def candidate_identity(ident: Column, source: Column, work_id: Column, doi: Column, title: Column) -> Column:
    """struct<work_id, doi, preprint_id, title_key>: what a candidate is recognised by. A preprint id only if source or id say it is one."""
    preprint = (source == "arxiv") | F.startswith(F.lower(ident), F.lit("arxiv:"))
    return F.struct(normalise_work_id(work_id).alias("work_id"), normalise_doi(doi).alias("doi"), F.when(preprint, normalise_preprint_id(ident)).alias("preprint_id"), title_key(F.coalesce(title, F.lit(""))).alias("title_key"))


def subfield_key(subfield: Column, field: Column, ident: Column) -> Column:
    """The subfield's id, else the field's, else one that no other row has."""
    return F.coalesce(_filled(F.trim(subfield)), _filled(F.trim(field)), F.concat(F.lit("unknown:"), ident))


def lookup_key(doi: Column, preprint_id: Column) -> Column:
    """The key by which a row is looked up, with / and : as they are; null without an identifier."""
    escaped = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    return F.coalesce(F.concat(F.lit("DOI:"), escaped(_filled(F.trim(doi)))), F.concat(F.lit("arXiv:"), escaped(_filled(F.trim(preprint_id)))))
