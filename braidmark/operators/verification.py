"""The verification battery: structure checks over all documents at once, one row per document and check.

lessons: doc, place, code, grade, module, unit, lesson, page_start, page_end, declared array<string>,
minutes (null where none is printed), blocks array<struct<section,letter,page,n_steps>>, materials and
vocabulary (arrays), parsed_by. pages: doc, page, text. docs: doc, page_count, guide_pages, expected
(null: from the headers), separation_fallback, engine_fallback. overviews: doc, start, end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.session import written

# Headers, codes, sections, limits.
HEADER = r"(?i)(?:Grade\s+(\d+)\s*:\s*)?(?:Module\s+(\d+)\s*:\s*)?Unit\s+(\d+)\s*:\s*Lesson\s+(\d+)"
STANDARD_CODE = r"\b([A-Z]{1,4}\.(?:K|\d+)\.\d+[a-z]{0,3})\b"
SECTIONS = ("Opening", "Work Time", "Closing and Assessment")
LEAST_MINUTES, MOST_MINUTES = 45, 75


def headers(pages: DataFrame) -> DataFrame:
    """doc, page, at and the numbers of every running header; grade and module are null where not printed."""
    found = pages.select("doc", "page", F.posexplode(F.regexp_extract_all("text", F.lit(HEADER), F.lit(0))).alias("at", "h"))
    number = lambda i: F.regexp_extract("h", HEADER, i).try_cast("int")
    return found.select("doc", "page", "at", number(1).alias("grade"), number(2).alias("module"), number(3).alias("unit"), number(4).alias("lesson"))


def expected_counts(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc, derived: lessons by the first header of each page: distinct grade and module inside each unit and lesson, one at least. found: the pages' headers, if at hand."""
    first = (headers(pages) if found is None else found).filter("at = 0")
    both = F.when(F.col("grade").isNotNull() & F.col("module").isNotNull(), F.struct("grade", "module"))
    per = first.groupBy("doc", "unit", "lesson").agg(F.greatest(F.lit(1), F.count_distinct(both)).alias("n"))
    return per.groupBy("doc").agg(F.sum("n").alias("derived"))


def partition_faults(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, faults: overlaps and gaps of segments (doc, start, end) against pages 1 to page_count; reversed segments cover nothing."""
    w = W.partitionBy("doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    used = segments.filter(F.col("end") >= F.col("start")).withColumn("__seen", F.coalesce(F.max("end").over(w), F.lit(0)))
    per = used.groupBy("doc").agg(F.count_if(F.col("start") != F.col("__seen") + 1).alias("__n"), F.max("end").alias("__last"))
    met = docs.select("doc", "page_count").join(per, "doc", "left")
    return met.select("doc", (F.coalesce("__n", F.lit(0)) + (F.coalesce("__last", F.lit(0)) != F.col("page_count")).cast("bigint")).alias("faults"))


def unconfirmed(lessons: DataFrame, pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Lessons without a header of their unit and lesson on their first page; a header's grade and module count where printed. found: the pages' headers, if at hand."""
    h = (headers(pages) if found is None else found).select("doc", F.col("page").alias("page_start"), "unit", "lesson", F.col("grade").alias("__g"), F.col("module").alias("__m"))
    hit = lessons.select("doc", "code", "page_start", "unit", "lesson", "grade", "module").join(h, ["doc", "page_start", "unit", "lesson"])
    hit = hit.filter(F.coalesce(F.col("__g") == F.col("grade"), F.lit(True)) & F.coalesce(F.col("__m") == F.col("module"), F.lit(True))).select("doc", "code").distinct()
    return lessons.join(hit, ["doc", "code"], "left_anti")


def ungrounded_codes(lessons: DataFrame, pages: DataFrame, engine: str = "docling") -> DataFrame:
    """doc, code, declared: declared codes that no page of the lesson's span prints: the next page from a span's start on that prints the code lies behind its end.

    Spans and pages are dealt once, by document and code, and read in order of page.
    """
    wanted = lessons.filter(F.col("parsed_by") == engine).select("doc", "code", F.col("page_start").alias("at"), "page_end", F.explode(F.array_distinct("declared")).alias("declared"))
    printed = pages.filter("doc IS NOT NULL AND page IS NOT NULL").select("doc", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(STANDARD_CODE), F.lit(1)))).alias("declared"))
    both = wanted.withColumn("asks", F.lit(True)).unionByName(printed.withColumn("at", F.col("page")), allowMissingColumns=True)
    before = W.partitionBy("doc", "declared").orderBy(F.desc("at"), F.desc_nulls_last("page")).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("next", F.min("page").over(before)).filter("asks")
    # a code that is null equals none, so its spans stay
    found = F.coalesce(F.col("at").isNotNull() & (F.col("next") <= F.col("page_end")) & F.col("code").isNotNull(), F.lit(False))
    return met.groupBy("doc", "code", "declared").agg(F.max(found).alias("found")).filter("NOT found").drop("found")


def disagreements(lessons: DataFrame, second: DataFrame, engine: str = "docling") -> DataFrame:
    """doc, code: lessons that a second division lacks or sees otherwise: span, set of codes, minutes, blocks in order, set of sections."""
    shape = lambda df: df.select("doc", "code", "page_start", "page_end", F.array_sort(F.array_distinct("declared")).alias("d"), "minutes", F.transform("blocks", lambda b: F.struct(b["section"], b["letter"])).alias("b"), F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["section"]))).alias("s"))
    own, other = shape(lessons.filter(F.col("parsed_by") == engine)), shape(second)
    # equal as a whole, so a repeated code is settled by any of its rows; a hash of the fields, which may be null, finds them
    fields = F.xxhash64("page_start", "page_end", "d", "minutes", "b", "s")
    sides = [df.withColumn("__f", F.struct("page_start", "page_end", "d", "minutes", "b", "s")).withColumn("__h", fields) for df in (own, other)]
    one, two = sides[0].alias("one"), sides[1].alias("two")
    same = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in ("doc", "code", "__h")]
    return one.join(two, same[0] & same[1] & same[2] & F.col("one.__f").eqNullSafe(F.col("two.__f")), "left_anti").select("doc", "code")


def _named(name: str, severity: str, bad: Column, shown: Column | None = None) -> Column:
    """A check's row; null where the check doesn't apply."""
    row = F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("n_bad"))
    return row if shown is None else F.when(shown, row)


def battery(lessons: DataFrame, pages: DataFrame, docs: DataFrame, overviews: DataFrame, second: DataFrame | None = None, engine: str = "docling") -> DataFrame:
    """doc, name, severity, n_bad, passed for every document and check that applies to it."""
    lessons, pages = written(lessons, "lessons"), written(pages, "pages")  # read by several checks each
    found = written(headers(pages), "headers")
    w = W.partitionBy("doc").orderBy("place")
    u = W.partitionBy("doc", "unit").orderBy("place")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    sections = F.transform(F.coalesce("blocks", F.array().cast(lessons.schema["blocks"].dataType)), lambda b: b["section"])
    flags = {
        "v3": F.col("page_start") <= F.lag("page_start").over(w),
        "v4": F.col("page_end") < F.col("page_start"),
        "v6": F.lead("page_start").over(u) != F.col("page_end") + 1,
        "v8": (F.size(F.array_except(F.array(*map(F.lit, SECTIONS)), sections)) > 0) | none("declared"),
        "v8b": none("blocks"),
        "v13": F.exists("blocks", lambda b: b["page"] == 0),
        "v14": F.exists("blocks", lambda b: b["n_steps"] == 0),
        "v9": ~F.col("minutes").between(LEAST_MINUTES, MOST_MINUTES),
        "v11": none("materials"),
        "v12": none("vocabulary"),
    }
    flagged = lessons.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    per = flagged.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("code")).alias("v5"), F.count_if(F.col("parsed_by") == engine).alias("n_engine"), *[F.count_if(k).alias(k) for k in flags])
    count = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    segments = overviews.select("doc", "start", "end").unionByName(lessons.select("doc", F.col("page_start").alias("start"), F.col("page_end").alias("end")))
    met = docs.join(per, "doc", "left").join(expected_counts(pages, found), "doc", "left").join(partition_faults(segments, docs), "doc", "left")
    met = met.join(count(unconfirmed(lessons, pages, found), "v7"), "doc", "left").join(count(ungrounded_codes(lessons, pages, engine), "v10"), "doc", "left")
    met = met.join(count(disagreements(lessons, second, engine), "v15"), "doc", "left") if second is not None else met.withColumn("v15", F.lit(None).cast("bigint"))
    wanted, n = F.coalesce("expected", "derived"), F.coalesce("n", F.lit(0))
    checks = [
        _named("V0 separation fallback", "soft", F.lit(1), F.col("separation_fallback").isNotNull()),
        _named("V0 content fallback", "soft", F.lit(1), F.col("engine_fallback").isNotNull()),
        _named("V1 lesson count", "hard", (n != wanted).cast("int"), wanted.isNotNull()),
        _named("V1 lesson count skipped", "soft", F.lit(1), wanted.isNull()),
        _named("V16 page count", "hard", F.lit(1), F.col("guide_pages") != F.col("page_count")),
        _named("V2 pages partitioned", "hard", F.col("faults")),
        _named("V3 starts rise", "hard", F.col("v3")),
        _named("V4 no reversed span", "hard", F.col("v4")),
        _named("V5 codes unique", "hard", F.col("v5")),
        _named("V6 contiguous in units", "hard", F.col("v6")),
        _named("V7 headers match", "hard", F.col("v7")),
        _named("V8 required blocks", "soft", F.col("v8")),
        _named("V8b some blocks", "hard", F.col("v8b")),
        _named("V13 blocks located", "hard", F.col("v13")),
        _named("V14 blocks have steps", "soft", F.col("v14")),
        _named("V9 minutes in band", "soft", F.col("v9")),
        _named("V11 materials", "hard", F.col("v11")),
        _named("V12 vocabulary", "soft", F.col("v12")),
        _named("V10 codes grounded", "hard", F.col("v10"), F.col("n_engine") > 0),
        _named("V15 second division agrees", "hard", F.col("v15"), (F.col("n_engine") > 0) & F.lit(second is not None)),
    ]
    # a check that doesn't apply is a row of nulls, dropped after the array is laid out
    return met.select("doc", F.inline(F.array(*checks))).filter("name IS NOT NULL").withColumn("passed", F.col("n_bad") == 0)


def verdicts(checked: DataFrame) -> DataFrame:
    """doc, verdict (GO unless a hard check fails), checks, fail_count, warn_count."""
    failed = lambda s: F.count_if((F.col("severity") == s) & ~F.col("passed"))
    return checked.groupBy("doc").agg(F.when(failed("hard") == 0, "GO").otherwise("BLOCK").alias("verdict"), F.count(F.lit(1)).alias("checks"), failed("hard").alias("fail_count"), failed("soft").alias("warn_count"))


def published(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of documents whose verdict is GO."""
    return rows.join(verdict.filter("verdict = 'GO'").select("doc"), "doc", "left_semi")


def text_layer(pages: DataFrame, samples: int = 24, least_chars: int = 50, share: float = 0.8) -> DataFrame:
    """doc, sampled, coverage, has_text: the share of every n-th page (n so that about `samples` are read) with enough characters. Sampling is the reference's rule."""
    n = pages.groupBy("doc").agg(F.max("page").alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / samples))
    taken = pages.join(n, "doc").filter(F.pmod(F.col("page") - 1, step) == 0)
    long = F.avg((F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars).cast("int"))
    return taken.groupBy("doc").agg(F.count(F.lit(1)).alias("sampled"), F.bround(long, 6).alias("coverage")).withColumn("has_text", F.col("coverage") >= share)
