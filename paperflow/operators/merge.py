"""Merging records of one paper, and filling rows from a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.tables import durable, free_name, scanned


def filled(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def richness(texts: list[str], others: list[str] = [], arrays: list[str] = []) -> Column:  # noqa: B006
    """How many fields a record has."""
    have = [F.when(filled(F.col(c)).isNotNull(), 1).otherwise(0) for c in texts] + [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in others] + [F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1).otherwise(0) for c in arrays]
    out = F.lit(0)
    for x in have:
        out = out + x
    return out


def merge_by(records: DataFrame, key: str, place: str, *, lead: list[str], fill: list[str], any_true: list[str] = [], rich: Column) -> DataFrame:  # noqa: B006
    """One row a key: the richest record leads (ties: the earlier), the others fill its gaps in order; flags hold if any is true.

    All of it is one grouped aggregate, so it combines before the shuffle and no group is gathered."""
    order = F.struct((-rich).alias("r"), F.col(place).alias("p"))
    aggs = [F.min_by(c, order).alias(c) for c in lead]
    aggs += [F.min_by(c, F.when(filled(F.col(c)).isNotNull(), order)).alias(c) for c in fill]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_true]
    return records.groupBy(key).agg(*aggs, F.min(place).alias(place), F.count(F.lit(1)).alias("records"))


def enrich(rows: DataFrame, lookup: DataFrame, on: str, text: str, note: str) -> DataFrame:
    """Left join; the row's own text goes before the lookup's, and abstract_source tells which it is."""
    side = lookup.select(F.col(on), F.col(text).alias("found_text"), F.col(note), F.lit(True).alias("matched"))
    joined = rows.join(side, on, "left")
    own = filled(F.col(text))
    source = F.when(own.isNotNull(), "source").when(filled(F.col("found_text")).isNotNull(), "lookup").otherwise("none")
    return joined.withColumn("abstract_source", source).withColumn(text, F.coalesce(own, filled(F.col("found_text")))).withColumn("enrichment_note", F.when(F.col("matched").isNull(), "not found")).drop("found_text", "matched")


def slots(records: DataFrame, *, place: str, doi: str, title: str, into: str) -> DataFrame:
    """`records` with `into`: the place of the record that leads those which are one paper, by order.

    In their order, a record goes to where its DOI is, else to where its title was first, unless both have DOIs that differ; a DOI that comes by title stays. That needs no
    rounds: all records of a DOI are where its first one is. A first one joins the first record of its title if that has no DOI and no earlier first one has the title, else it
    leads. A record without DOI is where the first of its title is. So three grouped minima say it all, and a title or DOI on very many records combines before it shuffles."""
    names = [free_name(records.columns, n) for n in ("doi_", "title_", "first_", "lead_", "of_doi_", "of_title_")]
    d, t, first, lead, of_doi, of_title = names
    rows = records.select("*", F.nullif(F.col(doi), F.lit("")).alias(d), F.nullif(F.col(title), F.lit("")).alias(t))
    by_doi = durable(rows.where(F.col(d).isNotNull()).groupBy(d).agg(F.min(F.struct(F.col(place).alias("p"), F.col(t).alias("t"))).alias("f")).select(d, F.col("f.p").alias("p"), F.col("f.t").alias("t")))
    by_title = rows.where(F.col(t).isNotNull()).groupBy(t).agg(F.min(F.struct(F.col(place).alias("p"), F.col(d).alias("d"))).alias("l"))
    joins = by_doi.where(F.col("t").isNotNull()).groupBy(F.col("t").alias(t)).agg(F.min("p").alias("joins"))
    titles = durable(by_title.join(joins, t, "left").select(t, F.col("l.p").alias("first"), F.col("l.d").alias("d"), "joins"))
    open_title = titles.where(F.col("d").isNull() & F.col("joins").isNotNull()).select(F.col("joins").alias("p"), "first")
    leads = durable(by_doi.join(open_title, "p", "left").select(F.col(d), F.coalesce("first", "p").alias(lead)))
    where = titles.join(leads.withColumnsRenamed({d: "d", lead: "led"}), "d", "left").select(F.col(t), F.coalesce("led", "first").alias(first))
    # rows with a DOI ask by it, the others by their title
    with_doi = rows.where(F.col(d).isNotNull()).join(leads, d).select(*records.columns, F.col(lead).alias(into))
    by_name = rows.where(F.col(d).isNull() & F.col(t).isNotNull()).join(where, t).select(*records.columns, F.col(first).alias(into))
    alone = rows.where(F.col(d).isNull() & F.col(t).isNull()).select(*records.columns, F.col(place).alias(into))
    return with_doi.unionByName(by_name).unionByName(alone)


def merge_fold(records: DataFrame, *, place: str, doi: str, title: str, lead: list[str], fill: list[str], any_true: list[str] = []) -> DataFrame:  # noqa: B006
    """Records merged in the order of `place`, which may be a struct: one goes to the record with its DOI, else to the first with its title key unless their DOIs differ.

    The richer of two (fields of `fill` that are there; ties: the earlier) leads with its `lead` fields and the other fills gaps. A record leads only if it has more fields than
    all before it together, so of records with the same fields only the earliest can: one for each set of fields is kept by a grouped minimum, and of these, a bounded number
    for a paper, those that led are told in order. A field is that of the last leader that has it, else of the earliest record that has it."""
    counted = [*fill, *([doi] if doi not in fill else [])]
    kinds = dict(records.dtypes)
    columns = [c for c in records.columns if c in {place, doi, title, *lead, *counted, *any_true}]
    have = lambda c: filled(F.col(c)).isNotNull() if kinds[c] == "string" else F.col(c).isNotNull() & (F.size(c) > 0) if kinds[c].startswith("array") else F.col(c).isNotNull()
    slot, fields = free_name(columns, "slot"), free_name(columns, "fields")
    bits = F.lit(0)
    for k, c in enumerate(counted):
        bits = bits.bitwiseOR(F.when(have(c), 1 << k).otherwise(0))
    rows = slots(records.select(*columns), place=place, doi=doi, title=title, into=slot).withColumn(fields, bits)
    kept = list(dict.fromkeys([*lead, *counted, *[c for c in columns if c not in any_true and c != place]]))
    by_fields = rows.groupBy(slot, fields).agg(
        F.min_by(F.struct(*[F.col(c) for c in kept]), F.col(place)).alias("row_"), F.min(place).alias("place_"), *[F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(f"any{k}_") for k, c in enumerate(any_true)]
    )
    one = F.struct(F.col("place_").alias("place"), F.col(fields).alias("fields"), F.col("row_").alias("row"))
    papers = by_fields.groupBy(slot).agg(F.array_sort(F.collect_list(one)).alias("all_"), *[F.bool_or(f"any{k}_").alias(f"any{k}_") for k in range(len(any_true))])

    def leaders(every: Column) -> Column:
        step = lambda before, x: F.struct(before.bitwiseOR(x["fields"]).alias("carry"), F.when(F.bit_count(x["fields"]) > F.bit_count(before), x["place"]).alias("out"))
        places = scanned(every, F.lit(0), step, dict(by_fields.dtypes)["place_"])
        # the first record leads whatever it has
        return F.filter(every, lambda x, k: (k == 0) | F.array_contains(places, x["place"]))

    said = papers.select("all_", *[f"any{k}_" for k in range(len(any_true))], leaders(F.col("all_")).alias("led_"))
    last = F.element_at("led_", -1)
    has = lambda rows, k: F.filter(F.col(rows), lambda x: x["fields"].bitwiseAND(F.lit(1 << k)) != 0)
    picked = {c: last["row"][c] for c in kept} | {c: F.try_element_at(has("led_", k), F.lit(-1))["row"][c] for k, c in enumerate(counted)}
    for k, c in enumerate(counted):
        picked[c] = F.coalesce(picked[c], F.get(has("all_", k), F.lit(0))["row"][c], last["row"][c])
    picked |= {c: F.col(f"any{k}_") for k, c in enumerate(any_true)} | {place: F.get("all_", F.lit(0))["place"]}
    return said.select(*[picked[c].alias(c) for c in columns])
