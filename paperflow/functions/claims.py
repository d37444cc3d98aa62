"""What claims and their quotes are compared by: stems, numbers, magnitudes and coverage, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperflow.functions.text import quote_form
from paperflow.tables import let

# Stop words, units, limits.
STOP_WORDS = (
    """the a an and or but of in on at to for with from as by is are was were be been being this that these those it its we our they their has have had not no can
    could may might will would should must more most also than then there here which who when while study studies paper results result""".split()
)
SI_PREFIXES = "nano mikro mili centi deci deka hekto kilo mega giga tera".split()
UNIT_WORDS = """procent promile krát násob bod[uů] p\\.\\s?b\\. sekund minut hodin dn[ůí] dní týdn měsíc rok roků let gram tun litr metr míl hektar ar[uů] watt watthodin
    joul kalori volt ampér ohm hertz newton pascal bar decibel kelvin stup[nň] korun eur dolar centů tep[uů] úder[uů] případ úmrtí obyvatel""".split()
UNIT_SYMBOLS = "% ‰ × °\\s?[CF] ° € \\$ Kč km/h m/s kWh MWh kW MW GW kJ MJ ppm ppb dB Hz kHz MHz GHz mg µg μg kg mm cm km ml dl hl ha m2 m3 km2".split()
CLAIMS_LEAST, CLAIMS_MOST, SHORT_WORDS, COVERAGE_LEAST = 2, 12, 15, 0.7
QUOTE_CHARS, QUOTE_WORDS, QUOTE_CONTENT = 15, 3, 2
CONCRETE = ("setting", "application", "mechanism", "other")


WORD = r"[\p{L}\p{N}]+"
NUMBER = r"(?<!\p{L})[0-9]+(?:[.,][0-9]+)?"
MAGNITUDE = rf"(?iu)(?<!\p{{L}})([0-9]+(?:[.,][0-9]+)?)\s*(?:{'|'.join(UNIT_SYMBOLS)}|(?:{'|'.join(SI_PREFIXES)})?(?:{'|'.join(UNIT_WORDS)})\p{{L}}*(?!\p{{L}}))"
QUANTITY = r"(?iu)(?<!\p{L})\p{N}|(?<![A-Za-z0-9_])(?:half|halved|third|quarter|twice|double|doubled|triple|tripled|times|percent|percentage)(?![A-Za-z0-9_])|fold(?![A-Za-z0-9_])"
ENDINGS = (("ies$", "y"), ("(?:sses|shes|ches|xes)$", ""), ("(?:ing|ed|es|s)$", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def stems(text: Column) -> Column:
    """Numbers, and the first four letters of content words without their endings; each once."""

    def stem(word: Column) -> Column:
        base = word
        for ending, instead in ENDINGS:
            base = F.regexp_replace(base, ending, instead)
        content = (F.length(word) >= 3) & ~word.isin(*STOP_WORDS)
        return F.when(word.rlike(r"^\p{N}"), word).when(content, F.left(F.when(F.length(base) >= 3, base).otherwise(word), F.lit(4)))

    return F.array_distinct(F.array_compact(F.transform(words(F.lower(text)), stem)))


def plain_number(number: Column) -> Column:
    """No zeros before or after, a point for a comma."""
    pointed = F.replace(number, F.lit(","), F.lit("."))
    return F.regexp_replace(F.regexp_replace(pointed, r"^0+(?=[0-9])", ""), r"(\.[0-9]+?)0+$", "$1")


def numbers(text: Column) -> Column:
    """Numbers in one spelling, each once. Digits of names (CO2) are none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), plain_number))


def magnitudes(text: Column) -> Column:
    """Numbers that carry a unit, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MAGNITUDE), F.lit(1)), plain_number))


def accounted(value: Column, known: Column) -> Column:
    """Whether a number is among the known, as it is, rounded either way, or within one part in a hundred."""
    v = value.cast("double")

    def same(other: Column) -> Column:
        k = other.cast("double")
        return (value == other) | (F.floor(k + 0.5) == v) | (F.floor(v + 0.5) == k) | (F.abs(v - k) <= 0.01 * F.greatest(v, k))

    return F.exists(known, same)


def solid(text: Column) -> Column:
    """How many characters are no blanks."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def covered(text: Column, spans: Column) -> Column:
    """How many characters, blanks aside, are in the union of the spans (array<struct<start, end>>, from 0, end exclusive)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(state["end"], span["start"])
        more = F.when(span["end"] > begin, solid(F.substring(text, begin + 1, span["end"] - begin))).otherwise(0)
        return F.struct(F.greatest(state["end"], span["end"]).alias("end"), (state["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def coverage(text: Column, spans: Column) -> Column:
    """Share of the characters, blanks aside, in the union of the spans."""
    return F.when(solid(text) > 0, covered(text, spans) / solid(text)).otherwise(0.0)


def weak(quote: Column) -> Column:
    """Too short a quote to bear anything out."""
    return let(words(quote), lambda w: (F.length(quote) < QUOTE_CHARS) | (F.size(w) < QUOTE_WORDS) | (F.size(F.filter(w, lambda x: ~F.lower(x).isin(*STOP_WORDS))) < QUOTE_CONTENT))


__all__ = ["accounted", "coverage", "covered", "magnitudes", "numbers", "plain_number", "quote_form", "solid", "stems", "weak", "words"]
