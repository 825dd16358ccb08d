"""The correlation package: citations with fallback pages, parent statements, cell texts, mirror rows, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Notes and numerals of the report.
PARTIAL_NOTE = "The standard is partially met."
FULL_NOTE = "The standard is fully met."
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
CONTRAST = r"(?i)partial|not met|however|missing|only|does not|never|but "


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def joined(items: Column, word: str) -> Column:
    """a; a and b; a, b, and c."""
    n, head = F.size(items), F.array_join(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    last = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, f" {word} ")).otherwise(F.concat(head, F.lit(f", {word} "), last))


def skill_phrase(text: Column) -> Column:
    """A skill's plain name: without (I/C) tags and the final stop, the first clause of a long one, its first letter small."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(_text(text), r"\(\s*[IC](?:\s*[,/]\s*[IC])*\s*\)", ""), r"\s+", " ")), r"\.+$", "")
    t = F.when((F.length(t) > 160) & F.contains(t, F.lit(";")), F.regexp_replace(F.trim(F.substring_index(t, ";", 1)), r"\.+$", "")).otherwise(t)
    return F.trim(F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def parent_label(code: Column, label: Column, text: Column) -> Column:
    label, text = _text(label), _text(text)
    both = (label != "") & (text != "")
    return F.when(both & F.startswith(F.lower(text), F.lower(label)), text).when(both, F.concat(label, F.lit(": "), text)).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.nullif(label, F.lit("")), code))


def short_name(code: Column, label: Column, text: Column) -> Column:
    head = _text(F.substring_index(_text(text), ":", 1))
    head = F.when(F.length(head) > 80, F.concat(F.substring(head, 1, 77), F.lit("…"))).otherwise(head)
    name = F.coalesce(F.nullif(_text(label), F.lit("")), head)
    return F.when((code != "") & (name != ""), F.concat_ws(" — ", code, name)).otherwise(F.coalesce(F.nullif(code, F.lit("")), name))


def domain_section(code: Column, names: dict[str, str]) -> Column:
    key = F.substring_index(code, ".", 2)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map(F.lit(""), F.lit(""))
    return F.coalesce(F.element_at(table, key), F.nullif(key, F.lit("")), F.lit("Standards"))


def short_explanation(rationales: Column, most: int = 280) -> Column:
    """From the first rationale that isn't blank: its contrasting sentences up to 120 characters and more, else its first, cut at a word."""
    first = F.get(F.filter(F.transform(rationales, lambda r: F.trim(F.regexp_replace(F.replace(_text(r), F.lit("⚑ REVIEW:"), F.lit("")), r"\s+", " "))), lambda r: r != ""), F.lit(0))
    parts = F.filter(F.transform(F.split(F.replace(first, F.lit("? "), F.lit(". ")), r"\. "), lambda p: F.trim(p)), lambda p: p != "")
    stop = lambda p: F.when(F.endswith(p, F.lit(".")), p).otherwise(F.concat(p, F.lit(".")))
    chosen = F.aggregate(parts, F.lit(""), lambda acc, p: F.when((F.length(acc) < 120) & p.rlike(CONTRAST), F.concat_ws(" ", F.nullif(acc, F.lit("")), stop(p))).otherwise(acc))
    said = F.when(chosen != "", chosen).otherwise(stop(F.get(parts, F.lit(0))))
    cut = F.concat(F.regexp_replace(F.substring(said, 1, most - 1), r" \S*$", ""), F.lit("…"))
    return F.coalesce(F.when(F.length(said) > most, cut).otherwise(said), F.lit(""))


def page_fallback(entities: DataFrame) -> DataFrame:
    """entity_id, page_start of entities that have one."""
    return entities.filter("page_start > 0").groupBy("entity_id").agg(F.min("page_start").alias("page_start"))


def teacher_pages(rows: DataFrame, fallback: DataFrame, include_partial: bool = True) -> DataFrame:
    """doc_id, full_n, partial_n, pages, entities, caveats, missing_pages, rationales of each cited document.

    rows: entity_id, doc_id, i, status, page, caveat, rationale. A row without a page and without a
    fallback counts, but adds no page or caveat; the first three rationales (in order of entity and
    place) of partial rows are kept.
    """
    status = F.lower(F.trim("status"))
    used = rows.filter(status.isin("full", "partial") if include_partial else status == "full").filter(_text(F.col("doc_id").cast("string")) != "")
    met = used.join(fallback, "entity_id", "left")
    own = F.when(F.col("page") > 0, F.col("page").cast("bigint"))
    page = F.coalesce(own, F.col("page_start").cast("bigint"))
    said = F.when((status == "partial") & (_text(F.col("rationale")) != ""), F.struct("entity_id", "i", F.trim("rationale").alias("t")))
    met = met.withColumns({"__page": page, "__said": said, "__turn": F.row_number().over(W.partitionBy("doc_id", said.isNull()).orderBy("entity_id", "i"))})
    kept = F.array_sort(F.collect_list(F.when(F.col("__turn") <= 3, F.col("__said"))))
    caveat = F.when(F.col("__page").isNotNull() & (_text(F.col("caveat")) != ""), F.trim("caveat"))
    return met.groupBy("doc_id").agg(
        F.count_if(status == "full").alias("full_n"),
        F.count_if(status == "partial").alias("partial_n"),
        F.array_sort(F.collect_set("__page")).alias("pages"),
        F.array_sort(F.collect_set("entity_id")).alias("entities"),
        F.array_sort(F.collect_set(caveat)).alias("caveats"),
        F.array_sort(F.collect_set(F.when(own.isNull(), F.col("entity_id")))).alias("missing_pages"),
        F.transform(kept, lambda x: x["t"]).alias("rationales"),
    )


def pages_text(pages: Column) -> Column:
    """Page numbers as runs: pp. 74, 84, 91–92."""
    last = lambda i: F.get(pages, i + 1)
    starts = F.filter(pages, lambda p, i: F.coalesce(F.get(pages, i - 1) != p - 1, F.lit(True)))
    ends = F.filter(pages, lambda p, i: F.coalesce(last(i) != p + 1, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("–", a.cast("string"), b.cast("string"))))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, F.concat(F.lit("pp. "), F.array_join(runs, ", "))).otherwise("")


def parent_statements(standards: DataFrame, cited: DataFrame, guide: str = "Module 2") -> DataFrame:
    """parent_code, supported, partial, missing (skills in order of code), alignment, statement.

    standards: code, level, parent_code, text; cited: doc_id, full_n, pages.
    """
    kids = standards.filter("level = 'substandard' AND trim(coalesce(parent_code, '')) != ''").select("code", F.trim("parent_code").alias("parent_code"), F.coalesce(F.nullif(skill_phrase(F.col("text")), F.lit("")), "code").alias("skill"))
    met = kids.join(cited.select(F.col("doc_id").alias("code"), "full_n", F.size("pages").alias("np")), "code", "left")
    state = F.when(F.coalesce("np", F.lit(0)) <= 0, "missing").when(F.col("full_n") > 0, "supported").otherwise("partial")
    skills = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("__s") == s, F.struct("code", "skill")))), lambda x: x["skill"]).alias(s)
    out = met.withColumn("__s", state).groupBy("parent_code").agg(skills("supported"), skills("partial"), skills("missing"))
    has = lambda c: F.size(c) > 0
    alignment = F.when(~has("supported") & ~has("partial"), "beyond_scope").when(~has("missing") & ~has("partial"), "fully_met").otherwise("partially_met")
    covered = F.concat("supported", "partial")
    beyond = F.concat(F.lit(f"This standard is beyond the scope of {guide}."), F.when(has("missing"), F.concat(F.lit(" None of the cited lessons ask students to "), joined(F.col("missing"), "or"), F.lit("."))).otherwise(""))
    full = F.concat(F.lit(f"{FULL_NOTE} Citations show students "), joined(covered, "and"), F.lit("."))
    partly = F.concat(
        F.lit(f"{PARTIAL_NOTE} Citations show students "),
        joined(covered, "and"),
        F.lit("."),
        F.when(has("missing"), F.concat(F.lit(" However, none of the cited lessons ask students to "), joined(F.col("missing"), "or"), F.lit("."))).otherwise(""),
        F.when(has("partial"), " Where a covered skill appears only in part, student performance is incomplete relative to the full skill named by the standard.").otherwise(""),
    )
    return out.withColumn("alignment", alignment).withColumn("statement", F.when(F.col("alignment") == "beyond_scope", beyond).when(F.col("alignment") == "fully_met", full).otherwise(partly))


def mirror_rows(standards: DataFrame, cited: DataFrame, guide: str = "Module 2") -> DataFrame:
    """One row per leaf: its citation cell, counts, entities, and notes on caveats and missing pages."""
    leaf = standards.filter("level = 'substandard'").select("code", "level", F.trim("text").alias("text"))
    met = leaf.join(cited.withColumnRenamed("doc_id", "code"), "code", "left").fillna(0, ["full_n", "partial_n"])
    pages, beyond = pages_text(F.col("pages")), F.lit(f"This standard is beyond the scope of {guide}.")
    said = F.concat(F.lit(f"{guide}: "), pages)
    partly = (F.col("partial_n") > 0) & (F.col("full_n") == 0)
    note = F.trim(F.concat_ws(" ", F.lit(PARTIAL_NOTE), F.nullif(short_explanation(F.col("rationales")), F.lit(""))))
    many = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    other = F.when(many("caveats"), "Supporting Materials / Read-aloud Guides were not included in the provided Teacher Guide PDF; some comprehension alignments may be understated pending those materials.").otherwise("")
    missing = F.when(many("missing_pages"), F.concat(F.lit("missing evidence_page lessons (Stage-1 page_start used when available): "), F.array_join(F.col("missing_pages").cast("array<string>"), ", ")))
    notes = F.concat_ws("; ", F.when(many("caveats"), "input_scope_caveat present on one or more lesson rows"), missing)
    return met.select(
        "code",
        "level",
        "text",
        F.when(pages == "", beyond).when(partly, F.concat_ws("\n", note, said)).otherwise(said).alias("citation"),
        "full_n",
        "partial_n",
        F.coalesce(F.array_join(F.col("entities").cast("array<string>"), ", "), F.lit("")).alias("entities"),
        F.when(pages == "", beyond).otherwise(other).alias("other_note"),
        notes.alias("qa_notes"),
    )


def package_counts(rows: DataFrame, standards: DataFrame, cited: DataFrame, parents: DataFrame, source: str) -> DataFrame:
    """One row: the source, alignment rows, cited leaves, all leaves, parents partially met."""
    one = rows.agg(F.count(F.lit(1)).alias("alignment_rows"))
    counts = [
        cited.agg(F.count_if(F.size("pages") > 0).alias("cited")),
        standards.agg(F.count_if(F.col("level") == "substandard").alias("leaves")),
        parents.agg(F.count_if(F.col("alignment") == "partially_met").alias("parents_partially_met")),
    ]
    for c in counts:
        one = one.join(F.broadcast(c))  # one row each
    return one.withColumn("source", F.lit(source))


def first_source(judged: DataFrame | None, csv: DataFrame | None, master: DataFrame | None) -> tuple[DataFrame, str]:
    """The rows of the best source given, with its name."""
    for name, df in (("judge", judged), ("csv", csv), ("master", master)):
        if df is not None:
            return df, name
    raise ValueError("no source of alignment rows")


def big_idea_headings(standards: DataFrame, domain: str, code: str, label: str, text: str) -> DataFrame:
    """Adds heading: a Roman number inside the domain, the label (else the text up to a colon) and the code's last part if it is a short word."""
    at = F.row_number().over(W.partitionBy(domain).orderBy(code))
    number = F.coalesce(F.get(F.array(*map(F.lit, ROMAN)), at - 1), at.cast("string"))
    name = F.coalesce(F.nullif(_text(F.col(label)), F.lit("")), F.nullif(_text(F.substring_index(_text(F.col(text)), ":", 1)), F.lit("")))
    tail = F.substring_index(F.col(code), ".", -1)
    shown = F.when(name.isNull(), F.col(code)).when(tail.rlike("^[A-Za-z]{1,4}$"), F.concat(name, F.lit(" ("), tail, F.lit(")"))).otherwise(name)
    return standards.withColumn("heading", F.concat(number, F.lit(". BIG IDEA: "), shown))
