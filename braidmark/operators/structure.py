"""Document structure: segments, gaps, state filled forward, and the verification battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.session import written


def segments(outline: DataFrame, doc: str, page: str, last_page: str) -> DataFrame:
    """start and end page of each outline entry: up to the next entry, or the document's end."""
    after = F.lead(page).over(W.partitionBy(doc).orderBy(page))
    return outline.withColumns({"start": F.col(page), "end": F.coalesce(after - 1, F.col(last_page))})


def gaps(spans: DataFrame, doc: str, last_page: str) -> DataFrame:
    """Pages that no span covers: before, between and after (start, end)."""
    seen = F.coalesce(F.max("end").over(W.partitionBy(doc).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    between = spans.withColumn("__seen", seen).filter(F.col("start") > F.col("__seen") + 1).select(doc, (F.col("__seen") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    tail = spans.groupBy(doc).agg((F.max("end") + 1).alias("start"), F.max(last_page).alias("end")).filter("start <= end")
    return between.unionByName(tail)


def order_checks(spans: DataFrame, doc: str) -> DataFrame:
    """Per document: spans whose start doesn't rise, that overlap, or that end before they start."""
    w = W.partitionBy(doc).orderBy("place")
    before = F.lag("start").over(w)
    seen = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = spans.withColumns({"__b": before, "__s": seen})
    n = lambda c: F.count(F.when(c, 1))
    return flagged.groupBy(doc).agg(n(F.col("start") <= F.col("__b")).alias("not_rising"), n(F.col("start") <= F.col("__s")).alias("overlaps"), n(F.col("end") < F.col("start")).alias("reversed"))


def fill_forward(df: DataFrame, by: str, order: str, value: Column, out: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def runs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Consecutive rows of one value: by, run, value, n, first, last."""
    w = W.partitionBy(by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(by, "run", value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def covering(start: Column, end: Column) -> Column:
    """The least set of dyadic spans (level, at: pages at * 2^level and so on) that covers start to end: two of each length at most."""

    def of_level(level: Column) -> Column:
        low = -F.call_function("shiftright", -start, level)  # the first span of this length that begins in the range, and the last that ends in it
        high = F.call_function("shiftright", end + 1, level) - 1
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        span = lambda at: F.struct(level.alias("level"), at.alias("at"))
        return F.array_compact(F.array(F.when((low <= high) & odd(low), span(low)), F.when((low <= high) & ~odd(high), span(high))))

    return F.when(start <= end, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2((end - start + 1).cast("double"))).cast("int") + 1), of_level)))


def printed_range(spans: DataFrame, page_map: DataFrame, doc: str) -> DataFrame:
    """First and last printed page of each span's mapped pages, by way of dyadic spans.

    The map is summed up once for each length that a span may need: the first and last mapped page
    of each dyadic span. A span meets those that cover it, about two for each doubling of its
    length, so rows grow with spans and mapped pages, not with the pages between.
    """
    whole = spans.withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})
    top = whole.agg(F.max(F.floor(F.log2((F.col("end") - F.col("start") + 1).cast("double"))))).first()[0]
    points = page_map.filter("page IS NOT NULL").select(doc, F.col("page").cast("bigint").alias("page"), "printed", F.explode(F.sequence(F.lit(0), F.lit(int(top or 0) + 1))).alias("level"))
    known = F.struct("page", "printed")
    summed = points.groupBy(doc, "level", F.call_function("shiftright", F.col("page"), F.col("level")).alias("at")).agg(F.min(known).alias("low"), F.max(known).alias("high"))
    cover = whole.select(doc, "start", "end", F.inline(covering(F.col("start"), F.col("end"))))
    met = cover.join(summed, [doc, "level", "at"]).groupBy(doc, "start", "end").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    typed = [F.col(c).cast(spans.schema[c].dataType).alias(c) for c in ("start", "end")]
    return met.select(doc, *typed, F.col("low.printed").alias("printed_first"), F.col("high.printed").alias("printed_last"))


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Numbered lines of each text (from 1)."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def top_level(outline: DataFrame, doc: str, level: str) -> DataFrame:
    """Outline entries of a document's shallowest level."""
    least = outline.groupBy(doc).agg(F.min(level).alias("__least"))
    return outline.join(least, doc).filter(F.col(level) == F.col("__least")).drop("__least")


def header_segments(headers: DataFrame, last_pages: DataFrame) -> DataFrame:
    """doc, identity, start, end: from the first page that names an identity up to the next identity's.

    headers: doc, page, identity; last_pages: doc, last_page.
    """
    first = headers.filter("identity IS NOT NULL").groupBy("doc", "identity").agg(F.min("page").alias("start"))
    after = F.lead("start").over(W.partitionBy("doc").orderBy("start", "identity"))
    met = first.withColumn("__next", after).join(last_pages, "doc")
    return met.select("doc", "identity", "start", F.coalesce(F.col("__next") - 1, F.col("last_page")).alias("end"))


def overview_spans(spans: DataFrame, last_pages: DataFrame) -> DataFrame:
    """doc, unit, start, end of pages that no span covers: those before a span belong to its unit, those after the last to the last one's.

    spans: doc, unit, start, end; last_pages: doc, last_page.
    """
    w = W.partitionBy("doc").orderBy("start", "end")
    seen = F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = spans.withColumn("__seen", seen).filter(F.col("start") > F.col("__seen") + 1).select("doc", "unit", (F.col("__seen") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    tail = spans.groupBy("doc").agg(F.max_by("unit", F.struct("end", "start")).alias("unit"), (F.max("end") + 1).alias("start")).join(last_pages, "doc").filter("start <= last_page")
    return before.unionByName(tail.select("doc", "unit", "start", F.col("last_page").alias("end")))


def printed_page(pages: DataFrame, edge: int = 6) -> DataFrame:
    """doc, page, printed: a number that stands alone, or after the name of the curriculum, on one of a page's first or last lines; the last such line counts.

    pages: doc, page, text.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda x: x != "")
    at_edge = F.filter(lines, lambda x, i: (i < edge) | (i >= F.size(lines) - edge))
    numbers = F.filter(F.transform(at_edge, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^(\d{1,4})$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?i)Curriculum\s+(\d{1,4})\s*$", 1), F.lit("")))), lambda n: n.isNotNull())
    return pages.select("doc", "page", F.when(F.size(numbers) > 0, F.get(numbers, F.size(numbers) - 1)).cast("int").alias("printed"))


def printed_of(points: DataFrame, page_map: DataFrame, doc: str) -> DataFrame:
    """Points (doc, page) with their printed page; null where the map lacks it."""
    return points.join(page_map.select(doc, "page", "printed"), [doc, "page"], "left")


def font_tier(size: Column, font: Column, hint: str = "MarkPro", major: float = 12.5, section: tuple[float, float] = (10.4, 11.6), runin: tuple[float, float] = (9.0, 9.9)) -> Column:
    """Heading tier of a line by its font: 1 major, 2 section, 3 run-in, 0 body."""
    headed = F.contains(font, F.lit(hint))
    return F.when(headed & (size >= major), 1).when(headed & size.between(*section), 2).when(headed & size.between(*runin), 3).otherwise(0)


def agenda_items(lines: DataFrame) -> DataFrame:
    """doc, at, section, letter, title, minutes of agenda lines like "A. Reading aloud (10 minutes)" under headers like "1. Opening".

    lines: doc, line_no, line.
    """
    header = F.regexp_extract("line", r"^\d+\.\s*(.+)", 1)
    known = F.when(header.startswith("Opening"), "Opening").when(header.startswith("Work Time"), "Work Time").when(header.startswith("Closing"), "Closing and Assessment")
    filled = fill_forward(lines, "doc", "line_no", known, "section")
    item = F.col("line").rlike(r"^[A-Z]\.\s*.+") & F.col("section").isNotNull()
    body = F.regexp_extract("line", r"^[A-Z]\.\s*(.+)", 1)
    minutes = F.regexp_extract(body, r"\((\d+)\s*minutes?\)", 1).try_cast("int")
    title = F.trim(F.regexp_replace(body, r"\(\d+\s*minutes?\).*$", ""))
    return filled.filter(item).select("doc", F.col("line_no").alias("at"), "section", F.substring("line", 1, 1).alias("letter"), title.alias("title"), minutes.alias("minutes"))


def section_bodies(lines: DataFrame, sections: list[str]) -> DataFrame:
    """doc, section, items: the lines under each section's header, in order, without page furniture and preparation notes."""
    from braidmark.operators.records import is_noise

    named = F.when(F.trim("line").isin(*sections), F.trim("line"))
    filled = fill_forward(lines, "doc", "line_no", named, "section").filter(F.col("section").isNotNull() & named.isNull() & ~is_noise(F.col("line")))
    return filled.groupBy("doc", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("x")))), lambda r: r["x"]).alias("items"))


def attached_steps(body: DataFrame, blocks: DataFrame, ahead: int = 3, least: int = 12, part_lines: int = 256, fan: int = 64) -> DataFrame:
    """doc, line_no, block: the block that each body line belongs to (null before the first).

    A line opens one of the next `ahead` blocks after the last opened one if its key (letters and
    digits) equals the block's, or else shares a beginning of `least` characters with it, the
    longest and then the nearest first. body: doc, line_no (from 0 or 1), line; blocks: doc, block
    (from 0, without gaps), title. Lines without a doc, and those of a doc without blocks, get null.

    Which blocks are next depends on those opened before: a line is a function from the last opened
    block to the next one, and all but a few values stay as they are. Lines are dealt to parts by
    number, the functions of a part's lines are composed to one, those of `fan` parts to one, and so
    on up; then each part is told the block it begins with. No task holds a document's lines.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    titled = blocks.select("doc", F.col("block").cast("int").alias("at"), key("title").alias("t")).filter("t != ''").withColumn("b", F.substring("t", 1, least))
    keyed = body.select("doc", F.col("line_no").cast("bigint").alias("line_no"), key("line").alias("k"))
    # one row for each different line of a document; equal lines share its function
    asked = keyed.filter("k != ''").select("doc", "k").distinct().withColumn("b", F.substring("k", 1, least)).join(titled, ["doc", "b"])
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("k"), F.length("t"))), lambda i: F.substring("k", F.lit(1), i) == F.substring("t", F.lit(1), i)))
    opens = asked.withColumn("shared", shared).filter(f"k = t OR shared >= {least}")
    opens = opens.groupBy("doc", "k").agg(F.collect_list(F.struct((F.col("k") == F.col("t")).alias("same"), "shared", (-F.col("at")).alias("near"))).alias("opens"))
    numbered = keyed.filter("doc IS NOT NULL").join(opens, ["doc", "k"], "left").withColumn("part", F.floor(F.col("line_no") / part_lines).cast("bigint"))

    def after_line(last: Column, line: Column) -> Column:
        near = F.filter(line["opens"], lambda x: (-x["near"] > last) & (-x["near"] <= last + ahead))
        return F.coalesce(-F.array_max(near)["near"], last)

    def after_part(last: Column, part: Column) -> Column:
        return F.coalesce(F.get(F.filter(part["moves"], lambda m: m["from"] == last), F.lit(0))["to"], last)

    def composed(items: Column, states: Column, after) -> Column:
        """The values that the functions of all items, one after another, change."""
        to = lambda s: F.aggregate(items, s, after)
        return F.filter(F.transform(F.array_distinct(states), lambda s: F.struct(s.alias("from"), to(s).alias("to"))), lambda m: m["from"] != m["to"])

    low = lambda line: F.flatten(F.transform(line["opens"], lambda x: F.sequence(F.greatest(-x["near"] - ahead, F.lit(-1)), -x["near"] - 1)))
    items = F.array_sort(F.collect_list(F.struct("line_no", "opens")))
    states = F.flatten(F.transform(F.filter("items", lambda x: x["opens"].isNotNull()), low))
    levels = [written(numbered.groupBy("doc", "part").agg(items.alias("items")).withColumn("moves", composed(F.col("items"), states, after_line)), "parts")]
    parts = int(body.agg(F.max("line_no")).first()[0] or 0) // part_lines + 1
    while parts > 1:
        of = levels[-1].select("doc", "part", "moves").groupBy("doc", F.floor(F.col("part") / fan).cast("bigint").alias("up")).agg(F.array_sort(F.collect_list(F.struct("part", "moves"))).alias("items"))
        begins = F.flatten(F.transform("items", lambda p: F.transform(p["moves"], lambda m: m["from"])))
        levels.append(written(of.select("doc", F.col("up").alias("part"), "items", composed(F.col("items"), begins, after_part).alias("moves")), "parts"))
        parts = -(-parts // fan)

    def told(after, ended: int) -> Column:
        """item, last: each item with the block that it begins (or, with ended = 1, ends) with, from the one that the part begins with."""
        ends = F.aggregate("items", F.array("last"), lambda acc, x: F.concat(acc, F.array(after(F.element_at(acc, -1), x))))
        return F.zip_with("items", F.slice(ends, 1 + ended, F.size("items")), lambda x, end: F.struct(x.alias("item"), end.alias("last")))

    at = levels[-1].select("doc", "part", F.lit(-1).alias("last"))
    for level in reversed(levels[1:]):
        below = level.join(at, ["doc", "part"]).select("doc", F.inline(told(after_part, 0)).alias("item", "last"))
        at = below.select("doc", "item.part", "last")
    lines = levels[0].join(at, ["doc", "part"]).select("doc", F.inline(told(after_line, 1)).alias("item", "block"))
    out = lines.select("doc", "item.line_no", "block")
    out = out.unionByName(keyed.filter("doc IS NULL").select("doc", "line_no", F.lit(-1).alias("block")))
    return out.select("doc", F.col("line_no").cast(body.schema["line_no"].dataType).alias("line_no"), F.when(F.col("block") >= 0, F.col("block").cast("bigint")).alias("block"))
