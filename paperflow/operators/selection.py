"""Exclusion, ranking and constrained choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperflow.functions.identity import squeeze
from paperflow.functions.text import inverted_index_like
from paperflow.tables import durable, let

REASONS = ("EXCL_RETRACTED", "EXCL_NO_ABSTRACT", "EXCL_ABSTRACT_TOO_THIN", "EXCL_STALE", "EXCL_SEEN", "EXCL_SEEN_TITLE", "EXCL_SAME_PAPER_TWICE", "EXCL_TYPE")
EXCLUDED_TYPES = ("editorial", "letter", "erratum", "book-review", "paratext", "dataset", "peer-review")
BAND = 0.005


def _fixed_rules(*, title: Column, kind: Column, retracted: Column, age: Column, seen: Column, freshness_days: int = 7) -> tuple[list, list]:
    """(condition, reason) of the rules that look at no abstract: those before the rules on it, and those after."""
    k = F.lower(F.trim(kind))
    no = F.lit(False)
    withdrawn = F.coalesce(retracted, no) | F.coalesce(k == "retraction", no) | title.rlike(r"(?iu)^\s*retracted(?!\p{L})")
    return [(withdrawn, "EXCL_RETRACTED")], [
        (age.isNull() | (age > freshness_days), "EXCL_STALE"),
        (seen == "title", "EXCL_SEEN_TITLE"),
        (seen.isNotNull(), "EXCL_SEEN"),
        (k.isin(*EXCLUDED_TYPES) | title.rlike(r"(?iu)^\s*(?:correction|corrigendum|erratum|editorial|comment on|reply to|response to)(?!\p{L})"), "EXCL_TYPE"),
    ]


def _text_rules(body: Column, note: Column, least_chars: int) -> tuple[list, list]:
    """The same of the rules on a squeezed abstract and note: whether they are there, and what they are."""
    return [((body == "") & (note == ""), "EXCL_NO_ABSTRACT"), ((F.length(body) < least_chars) & (note == ""), "EXCL_ABSTRACT_TOO_THIN")], [((body != "") & inverted_index_like(body), "EXCL_NO_ABSTRACT")]


def exclusion_reason(*, title: Column, abstract: Column, tldr: Column, kind: Column, retracted: Column, age: Column, seen: Column, freshness_days: int = 7, least_chars: int = 400, defer_abstract: bool = False) -> Column:
    """The first rule that excludes a candidate, or null. `seen` is null, 'title' or another kind of match."""
    first, later = _fixed_rules(title=title, kind=kind, retracted=retracted, age=age, seen=seen, freshness_days=freshness_days)

    def reason(bound: Column) -> Column:
        there, sound = _text_rules(bound["body"], bound["note"], least_chars)
        every = [*first, *([] if defer_abstract else there), *later, *sound]
        out = F.when(F.coalesce(every[0][0], F.lit(False)), every[0][1])
        for when, name in every[1:]:
            out = out.when(F.coalesce(when, F.lit(False)), name)
        return out

    # squeezed once a row, however many rules look at it
    return let(F.struct(squeeze(F.coalesce(abstract, F.lit(""))).alias("body"), squeeze(F.coalesce(tldr, F.lit(""))).alias("note")), reason)


def _none(rules: list) -> Column:
    return ~reduce(lambda a, b: a | b, [F.coalesce(when, F.lit(False)) for when, _ in rules])


def open_to(**fixed) -> Column:
    """Whether none of the rules that look at no abstract excludes a candidate; with `sound_text`, the same as no `exclusion_reason`."""
    first, later = _fixed_rules(**fixed)
    return _none([*later, *first])


def sound_text(body: Column, note: Column, least_chars: int = 400) -> Column:
    """Whether no rule excludes a candidate for its squeezed abstract and note."""
    there, sound = _text_rules(body, note, least_chars)
    return _none([*there, *sound])


def counts_by_reason(excluded: DataFrame, column: str = "reason") -> DataFrame:
    """One row for each reason there is, none missing, in one pass."""
    one = excluded.agg(*[F.count_if(F.col(column) == r).alias(r) for r in REASONS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])).alias("x")).select("x.*")


def ranking(total: str, explainability: str, date: str, access: str, credibility: str, ident: str) -> list[Column]:
    """The total order: band of the total, then the other factors, the id last."""
    band = F.floor(F.col(total) / BAND + 1e-9)
    return [band.desc(), F.col(explainability).desc(), F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), F.col(access).desc(), F.col(credibility).desc(), F.col(ident).asc()]


def top(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows with their rank. The limit comes before the window, which so never sees more than k rows."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def capped(df: DataFrame, group: str, order: list[Column], cap: int, limit: int, relaxed: int | None = None) -> DataFrame:
    """At most `cap` rows a group, `limit` in all; with `relaxed`, a second pass over what the cap refused fills up to that cap.

    A group keeps no more than its larger cap before the rows meet, so the global order sorts few rows of each group."""
    most = max(cap, relaxed or cap)
    within = Window.partitionBy(group).orderBy(*order)
    few = df.withColumn("place_in_group", F.row_number().over(within)).where(F.col("place_in_group") <= most)
    late = F.col("place_in_group") > cap
    return few.orderBy(late, *order).limit(limit).withColumn("relaxed", late)


def admit(pool: DataFrame, already: DataFrame, group: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """Rows for the room that `already` leaves under the cap; limit counts those too."""
    already = durable(already.select(group))
    used = already.groupBy(group).agg(F.count(F.lit(1)).alias("used"))
    room = max(0, limit - already.count())
    within = Window.partitionBy(group).orderBy(*order)
    ranked = pool.withColumn("place_in_group", F.row_number().over(within)).where(F.col("place_in_group") <= cap)
    fits = ranked.join(used, group, "left").where(F.col("place_in_group") <= cap - F.coalesce("used", F.lit(0)))
    return fits.orderBy(*order).limit(room).drop("used", "place_in_group")


def shortfall(selected: Column, eligible: Column, wanted: int) -> Column:
    return F.when(selected >= wanted, "none").when(eligible > selected, "diversity-cap").otherwise("candidate-shortage")


def select_day(ranked: DataFrame, ident: str, group: str, order: list[Column], gate: Column, *, cap: int, limit: int, least: int) -> DataFrame:
    """At most `limit` rows that pass the gate, `cap` a group; if they are fewer than `least`, the best of the others fill up to it under
    the same cap, and `below_gate` marks them."""
    above = durable(capped(ranked.where(F.coalesce(gate, F.lit(False))), group, order, cap, limit).drop("place_in_group", "relaxed"))
    chosen = above.withColumn("below_gate", F.lit(False))
    if above.count() < least:
        rest = ranked.where(~F.coalesce(gate, F.lit(False)))
        chosen = chosen.unionByName(admit(rest, above, group, order, cap, least).withColumn("below_gate", F.lit(True)))
    return chosen


def unenriched(rows: DataFrame, text: str) -> DataFrame:
    """Rows before any lookup: no short summary, and where the text is from."""
    return rows.withColumn("tldr", F.lit(None).cast("string")).withColumn("abstract_source", F.when(squeeze(F.coalesce(F.col(text), F.lit(""))) != "", "source").otherwise("none"))
