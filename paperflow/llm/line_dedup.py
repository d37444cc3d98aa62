"""Removal of multi-line chunks that the corpus repeats, in DataFrame operations alone.

A text's lines are hashed; a cyclic-polynomial rolling hash over the last `window` line hashes ends a chunk wherever
it is 0 mod `divisor`, so that a boundary depends on the lines about it alone and chunks line up again after an
insertion. No chunk ends before it has `least_lines` lines that are not blank, and a shorter tail joins the chunk
before it, so that a later copy of several lines goes whole. Chunk hashes are counted globally; of those found more than once, the texts are compared byte by byte
with the first chunk (by id, then place), which stays while equal ones go. Counts combine before they shuffle; the
texts of a chunk with many copies are dealt over as many keys as its count asks for, each with a first text to
compare with; documents are joined on keys of their own.

Defined cases: a null text stays null; a text with fewer than `least_lines` lines that are not blank stays; a row without id comes before all others; rows that repeat an id and
its text are one document and get the same result; a table without rows gives none; helper columns take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperflow.llm.common import durable
from paperflow.llm.native import BLANKS, let, scanned

#: Copies of one chunk that are compared under one key.
COPIES_A_KEY = 64
#: Keys over which the places of one chunk are spread.
SALTS = 64


def rotated(h: Column, n: int) -> Column:
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def chunks_of(text: Column, *, window: int = 3, divisor: int = 4, least_lines: int = 2) -> Column:
    """array<struct<body, n_lines, full>>: chunks that joined by newlines give the text; full counts the lines that are not blank."""

    def ends(h: Column) -> Column:
        def last(i: Column) -> Column:
            rolled = rotated(F.get(h, i), 0)
            for j in range(1, window):
                rolled = rolled.bitwiseXOR(rotated(F.coalesce(F.get(h, i - j), F.lit(0).cast("long")), j))
            return (F.pmod(F.xxhash64(rolled), F.lit(divisor)) == 0) | (i == F.size(h) - 1)

        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), last)

    def chunk(lines: Column, start: Column, end: Column) -> Column:
        part = F.slice(lines, start + 1, end - start + 1)
        return F.struct(F.array_join(part, "\n").alias("body"), F.size(part).alias("n_lines"), F.size(F.filter(part, lambda x: F.translate(x, BLANKS, "") != "")).alias("full"))

    def wide(lines: Column, e: Column) -> Column:
        """The ends that leave each chunk `least_lines` lines that are not blank."""
        parts = F.transform(e, lambda end, k: F.struct(end.alias("end"), chunk(lines, F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), end)["full"].alias("full")))

        def step(before: Column, x: Column) -> Column:
            enough = before + x["full"] >= least_lines
            return F.struct(F.when(enough, 0).otherwise(before + x["full"]).alias("carry"), F.when(enough, x["end"]).alias("out"))

        def closed(out: Column) -> Column:
            return F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.size(lines) - 1))

        return let(scanned(parts, F.lit(0), step, "int"), closed)

    def cut(lines: Column) -> Column:
        found = let(let(F.transform(lines, lambda x: F.xxhash64(x)), ends), lambda e: wide(lines, e))
        return let(found, lambda e: F.transform(e, lambda end, k: chunk(lines, F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), end)))

    return let(F.split(text, "\n"), cut)


def repeated(rows: DataFrame, text: str, least_lines: int, **options) -> DataFrame:
    """(id_, key_, gone array of chunk numbers) of `rows`, which have the columns id_, key_ and `text`: what each document loses.

    Hashes and places alone find what repeats; then the texts of the repeated chunks are fetched and compared."""
    options["least_lines"] = least_lines
    parts = rows.where(F.col(f"`{text}`").isNotNull()).select("id_", "key_", F.posexplode(chunks_of(F.col(f"`{text}`"), **options)).alias("n", "c")).where(F.col("c")["full"] >= least_lines)
    place = F.struct("id_", "key_", "n")
    slim = durable(parts.select(place.alias("place"), F.xxhash64(F.col("c")["body"]).alias("h")).withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS))))
    # a chunk that many documents have is counted, and told of, under as many keys; one place twice is a repeated row
    salted = slim.groupBy("h", "salt").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("copies"))
    seen = salted.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("copies").alias("copies")).where(F.col("first") != F.col("last"))
    seen = seen.select("h", "first", F.ceil(F.col("copies") / COPIES_A_KEY).cast("int").alias("parts"))
    told_of = salted.select("h", "salt").join(seen, "h")
    found = slim.join(told_of, ["h", "salt"]).groupBy(F.col("place")["id_"].alias("id2_"), F.col("place")["key_"].alias("key2_")).agg(F.collect_set(F.struct(F.col("place")["n"].alias("n"), "h", "parts", (F.col("place") == F.col("first")).alias("first"))).alias("found"))
    both = rows.join(found, F.col("id_").eqNullSafe(F.col("id2_")) & (F.col("key_") == F.col("key2_")))
    bodies = let(chunks_of(F.col(f"`{text}`"), **options), lambda c: F.transform("found", lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["parts"].alias("parts"), x["first"].alias("first"), F.get(c, x["n"])["body"].alias("body"))))
    told = both.select("id_", "key_", F.explode(bodies).alias("x")).select("id_", "key_", "x.n", "x.h", "x.parts", "x.first", "x.body")
    first = told.where("first").groupBy("h", "parts").agg(F.min("body").alias("first_body")).select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "first_body")
    copies = told.where("not first").withColumn("part", F.pmod(F.xxhash64("id_", "key_", "n"), F.col("parts")).cast("int"))
    equal = copies.join(first, ["h", "part"]).where(F.col("body") == F.col("first_body"))
    return equal.groupBy("id_", "key_").agg(F.collect_set("n").alias("gone"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_lines: int = 2, removed: str | None = None, **options) -> DataFrame:
    """`docs` with their texts less what repeats. With `removed`, a struct column of that name counts the chunks and lines gone."""
    names = [f"c{k}_" for k in range(len(docs.columns))]  # so that no name clashes
    body, ident = names[docs.columns.index(text)], names[docs.columns.index(doc_id)]
    rows = docs.toDF(*names).withColumns({"id_": F.col(ident), "key_": F.xxhash64(body)})
    gone = repeated(rows, body, least_lines, **options).select(F.col("id_").alias("id2_"), F.col("key_").alias("key2_"), "gone")
    joined = rows.join(gone, F.col("id_").eqNullSafe(F.col("id2_")) & (F.col("key_") == F.col("key2_")), "left")

    def rest(c: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(c) - 1), "gone")
        return F.array_join(F.transform(left, lambda n: F.get(c, n)["body"]), "\n")

    def lost(c: Column) -> Column:
        return F.aggregate("gone", F.lit(0), lambda a, n: a + F.get(c, n)["n_lines"])

    kept = F.when(F.col("gone").isNull(), F.col(body)).otherwise(let(chunks_of(F.col(body), least_lines=least_lines, **options), rest))
    extra = []
    if removed:
        extra = [F.struct(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("chunks"), F.when(F.col("gone").isNull(), 0).otherwise(let(chunks_of(F.col(body), least_lines=least_lines, **options), lost)).cast("long").alias("lines")).alias(removed)]
    return joined.select(*[(kept if n == body else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)], *extra)
