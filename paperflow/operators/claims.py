"""Adjudication of examples by their claims: array columns of each row, no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.functions import claims
from paperflow.functions.claims import CLAIMS_LEAST, CLAIMS_MOST, CONCRETE, COVERAGE_LEAST, QUANTITY, SHORT_WORDS
from paperflow.functions.text import composed, quote_form
from paperflow.tables import free_name, let

CLAIM = "struct<id:string,text:string,kind:string,span:string,verdict:string,quote:string,field:string>"
SOURCE = ("title", "abstract", "tldr", "venue", "type", "date")
#: A claim with one of these has nothing behind it.
UNBACKED = ("V2_UNSUPPORTED_CLAIM", "V3_QUOTE_TOO_WEAK", "V4_FABRICATED_QUOTE")


def code(name: str, when: Column) -> Column:
    return F.when(when, F.lit(name))


def judged(claim: Column, example: Column, fields: Column) -> Column:
    """struct<id, codes, beside, start, end> of one claim; beside: its quote is real but not to the point, in a way that one claim may be."""

    def found(bound: Column) -> Column:
        span, said = bound["span"], F.coalesce(claim["text"], F.lit(""))
        at = F.when(span != "", F.instr(example, span) - 1).otherwise(-1)
        unsupported = F.coalesce(claim["verdict"] == "unsupported", F.lit(False))
        weak = ~unsupported & (claim["quote"].isNull() | claim["field"].isNull() | F.coalesce(claims.weak(claim["quote"]), F.lit(True)))
        invented = ~unsupported & ~weak & ~F.contains(F.coalesce(F.element_at(fields, claim["field"]), F.lit("")), bound["quote"])
        real = ~unsupported & ~weak & ~invented
        beside, concrete = real & ~F.arrays_overlap(claims.stems(said), claims.stems(claim["quote"])), F.coalesce(claim["kind"].isin(*CONCRETE), F.lit(False))
        codes = F.array(
            code("V5_SPAN_NOT_IN_EXAMPLE", at < 0), code("V2_UNSUPPORTED_CLAIM", unsupported), code("V3_QUOTE_TOO_WEAK", weak), code("V4_FABRICATED_QUOTE", invented), code("V7_QUOTE_IRRELEVANT", beside & concrete),
            code("V7_MAGNITUDE_UNSUPPORTED", real & said.rlike(QUANTITY) & ~claim["quote"].rlike(QUANTITY)), code("V8_VENUE_CANNOT_SUPPORT_MECHANISM", real & F.coalesce((claim["kind"] == "mechanism") & (claim["field"] == "venue"), F.lit(False))),
        )
        return F.struct(claim["id"].alias("id"), F.array_compact(codes).alias("codes"), (beside & ~concrete).alias("beside"), at.alias("start"), (at + F.length(span)).alias("end"))

    return let(F.struct(quote_form(claim["span"]).alias("span"), quote_form(claim["quote"]).alias("quote")), found)


def report(example: Column, fields: Column, listed: Column, model_verdict: Column, illustration: Column) -> Column:
    """struct<verdict, failures, coverage>: failures of the example as a whole, of its claims in their order, then of what they add up to."""
    shown, given = quote_form(example), F.coalesce(listed, F.expr(f"cast(array() as array<{CLAIM}>)"))
    one = lambda name, when: F.when(when, F.array(F.struct(F.lit(name).alias("code"), F.lit(None).cast("string").alias("claim")))).otherwise(F.expr("cast(array() as array<struct<code:string,claim:string>>)"))

    def whole(bound: Column) -> Column:
        each = bound["judged"]
        few = ~illustration & (F.size(given) < CLAIMS_LEAST) & (F.size(F.filter(F.split(F.coalesce(example, F.lit("")), r"\s+"), lambda w: w != "")) > SHORT_WORDS)
        of_claims = F.flatten(F.transform(each, lambda j: F.transform(j["codes"], lambda c: F.struct(c.alias("code"), j["id"].alias("claim")))))
        said = claims.numbers(F.array_join(F.transform(given, lambda c: F.concat_ws(" ", F.coalesce(c["text"], F.lit("")), F.coalesce(c["quote"], F.lit("")))), " "))
        unknown = let(said, lambda known: F.transform(F.filter(claims.magnitudes(example), lambda v: ~claims.accounted(v, known)), lambda v: F.struct(F.lit("V9_UNACCOUNTED_NUMBER").alias("code"), F.lit(None).cast("string").alias("claim"))))
        backed = F.size(F.filter(each, lambda j: ~F.arrays_overlap(j["codes"], F.array(*map(F.lit, UNBACKED)))))
        loose = F.filter(each, lambda j: j["beside"])
        adrift = F.when((F.size(loose) >= 2) & (2 * F.size(loose) > backed), F.transform(loose, lambda j: F.struct(F.lit("V7_QUOTE_IRRELEVANT").alias("code"), j["id"].alias("claim")))).otherwise(F.expr("cast(array() as array<struct<code:string,claim:string>>)"))
        covered = claims.coverage(bound["shown"], F.transform(F.filter(each, lambda j: j["start"] >= 0), lambda j: F.struct(j["start"].alias("start"), j["end"].alias("end"))))

        def closed(failures: Column) -> Column:
            veto = one("MODEL_VETO", (F.size(failures) == 0) & F.coalesce(model_verdict == "unsupported", F.lit(False)))
            every = F.concat(failures, veto)
            return F.struct(F.when(F.size(every) > 0, "unsupported").otherwise("supported").alias("verdict"), every.alias("failures"), covered.alias("coverage"))

        return let(F.concat(one("EXAMPLE_TOO_ELABORATE", F.size(given) > CLAIMS_MOST), one("DECOMPOSITION_TOO_COARSE", few), of_claims, unknown, adrift, one("V6_COVERAGE_TOO_LOW", ~illustration & (covered < COVERAGE_LEAST))), closed)

    return let(F.struct(shown.alias("shown"), fields.alias("fields")), lambda b: let(F.struct(b["shown"].alias("shown"), F.transform(given, lambda c: judged(c, b["shown"], b["fields"])).alias("judged")), whole))


def adjudicated(examples: DataFrame, illustration: Column | None = None) -> DataFrame:
    """`examples` (example, claims array<CLAIM>, model_verdict and the columns of SOURCE) with `report`.

    The model's verdict can only reject. An illustration need not be covered nor taken apart. Nulls are empty."""
    taken, told = free_name(examples.columns, "composed"), F.to_json("claims")
    rows = examples.withColumn(taken, F.struct(*[composed(F.col(c)).alias(c) for c in ("example", *SOURCE)], composed(told).alias("told"), told.alias("as_told")))
    plain = F.col(taken)
    listed = F.coalesce(F.from_json(F.when(plain["told"] != plain["as_told"], plain["told"]), f"array<{CLAIM}>"), F.col("claims"))
    venue = F.concat_ws(" ", *[F.coalesce(plain[c], F.lit("")) for c in ("venue", "type", "date")])
    fields = F.create_map(*[x for k in ("title", "abstract", "tldr") for x in (F.lit(k), quote_form(plain[k]))], F.lit("venue"), quote_form(venue))
    return rows.withColumn("report", report(plain["example"], fields, listed, F.col("model_verdict"), F.lit(False) if illustration is None else illustration)).drop(taken)


def graded(rows: DataFrame) -> DataFrame:
    """`rows` (report, claims, expected, must_flag array, need_supported) with `problems`: what is wrong with a known outcome; nothing if all is as it should be."""
    flagged = F.transform(F.filter("claims", lambda c: c["verdict"] == "unsupported"), lambda c: F.trim(F.lower(F.coalesce(c["span"], F.lit("")))))
    missed = F.filter(F.coalesce("must_flag", F.array().cast("array<string>")), lambda s: ~F.exists(flagged, lambda f: F.contains(f, F.trim(F.lower(s))) | F.contains(F.trim(F.lower(s)), f)))
    invented = F.exists("report.failures", lambda f: f["code"] == "V4_FABRICATED_QUOTE")
    wrong = F.array(F.when(F.col("report.verdict") != F.col("expected"), "verdict"), F.when((F.col("expected") == "supported") & invented, "invented quote"))
    none = (F.col("expected") != "supported") & F.coalesce("need_supported", F.lit(False)) & ~F.exists("claims", lambda c: c["verdict"] == "supported")
    flags = F.when(F.col("expected") != "supported", F.transform(missed, lambda s: F.concat(F.lit("not flagged: "), s))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("problems", F.array_compact(F.concat(wrong, flags, F.array(F.when(none, "nothing supported")))))


def summary(rows: DataFrame, expected: str = "expected", actual: str = "actual", model: str = "model_verdict") -> DataFrame:
    """Passed, wrongly accepted, wrongly rejected, and where the model says otherwise than the rules."""
    e, a = F.col(expected), F.col(actual)
    return rows.agg(
        F.count_if(e == a).alias("passed"), F.count_if((e == "unsupported") & (a == "supported")).alias("false_accepts"), F.count_if((e == "supported") & (a == "unsupported")).alias("false_rejects"), F.count_if(F.col(model) != a).alias("drift")
    )
