"""Evidence grounding and repair, verdict finalisation, review flags, consistency, reports."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, IntegerType, StringType

# Typographic characters folded before texts are compared; limits; patterns; notes.
FOLD_FROM, FOLD_TO = "‘’“”–— ", "''\"\"-- "
STATUSES = ("full", "partial", "none")
LEAST_CHARS, LEAST_PART = 24, 12
STITCH, NOT_ASCII = r";|\.\.\.|…", r"[^\x00-\x7F]"
BRACKETS = r"\[[^\]]*(\]|$)"
PAGE_LINE = r"(?im)(?=^[^\n]*\(\s*page\s+\d+\s*\))"
PAGE_NUMBER = r"(?i)\(\s*page\s+(\d+)\s*\)"
WAFFLE_OR = r"(?i)\b(or[- ]?list|or[- ]like|any one|interchangeable|one of the|under one .*umbrella|range[- ]of[- ]target)\b"
WAFFLE_ALL = r"(?i)\b(separable|all (?:four|required|of the)|each names a distinct|must (?:all )?co-occur|all collaborative acts|require all)\b"
TIMING_GATE = (
    r"(?i)((?:while|during)\s+reading.{0,100}(?:\bafter\b|not after)|after\s+(?:the\s+)?reading.{0,100}(?:while|during|not during)|"
    r"(?:only|must|required|needs?\s+to|should)\s+(?:occur\s+|happen\s+|be\s+)?(?:while|during|after)\s+reading|"
    r"(?:because|since|as)\s+it\s+(?:occurs|happens|is\s+done|takes\s+place)\s+(?:only\s+)?after\s+reading|"
    r"(?:not|never)\s+(?:done|practiced|performed)\s+while\s+reading|"
    r"(?:while|during)\s+reading.{0,80}(?:partial|none|not\s+(?:fully\s+)?met|insufficient)|"
    r"(?:partial|none|not\s+(?:fully\s+)?met|insufficient).{0,80}(?:while|during|after)\s+reading)"
)
TIMING_WORDS = r"(?i)\b(?:while|during|after)\s+reading\b"
SCORE_WORDS = r"(?i)\b(?:partial|none|not\s+(?:fully\s+)?met|only|must|required|because|since)\b"
TIMING_EMPTY = "Timing while/after reading is not a scoring requirement; score on whether students perform the target skill."
TIMING_NOTE = "[P5: invented while-reading vs after-reading timing disregarded — score on the skill only]"
REJECTED = " [REJECTED: evidence missing or not found in lesson raw text]"
GUIDE = r"(?i)\b(?:close|focused)[\s-]*read[\s-]*aloud\s+guide\b"
GUIDE_TITLE = r"(?i)^\s*(?:\[.*?\])?\s*(?:close|focused)[\s-]*read[\s-]*aloud\s+guide\b"
GUIDE_POINTER = r"(?i)\busing the\b.{0,80}\b(?:close|focused)[\s-]*read[\s-]*aloud\s+guide\b|\b(?:close|focused)[\s-]*read[\s-]*aloud\s+guide\b.{0,80}\bfor teacher reference\b|\bsee (?:the )?(?:close|focused)[\s-]*read[\s-]*aloud\s+guide\b"
QUESTION_LINE = r"(?i)^\s*(?:[-*]\s*)?(?:ask(?:\s+students)?\s*[:.]|“?[\"']?(?:what|why|how|who|where)\b)"
SCOPE_CAVEAT = "scored on provided lesson text; likely understated pending the Read-aloud Guides."


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(text: Column) -> Column:
    """NFKC; only texts with other than ASCII characters leave the JVM."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(_composed(F.when(text.rlike(NOT_ASCII), text)), text)


def folded(text: Column) -> Column:
    """Of a composed text: folded dashes, lower case, no quote marks, underscores or bullets, single spaces."""
    plain = F.translate(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), "_'\"", "   ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?m)^\s*-\s*", " "), r"\s+", " "))


def normalized(text: Column) -> Column:
    return folded(composed(text))


def parts_of(quote: Column) -> Column:
    """A folded quote's parts between ; and ellipses, of enough characters."""
    return F.filter(F.transform(F.split(quote, STITCH), lambda p: F.trim(p)), lambda p: F.length(p) >= LEAST_PART)


def grounded(evidence: Column, source: Column, least: int = LEAST_CHARS) -> Column:
    """Evidence of enough characters that the source contains whole, or in all parts between ; and ellipses."""
    raw, source = F.trim(F.coalesce(evidence, F.lit(""))), F.coalesce(source, F.lit(""))
    quote, hay = folded(raw), folded(source)
    parts = parts_of(quote)
    stitched = quote.rlike(STITCH) & (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(hay, p))
    plain = (quote != "") & (hay != "") & (F.contains(hay, quote) | stitched)
    odd = raw.rlike(NOT_ASCII) | source.rlike(NOT_ASCII)

    @F.pandas_udf(BooleanType())
    def composed_first(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([None if q is None else _contained(_fold(q), _fold(s)) for q, s in zip(quotes, sources, strict=True)], dtype=object)

    return (F.length(raw) >= least) & F.when(odd, composed_first(F.when(odd, raw), F.when(odd, source))).otherwise(plain)


def grounding_note(evidence: Column, is_grounded: Column, none: Column) -> Column:
    empty = F.trim(F.coalesce(evidence, F.lit(""))) == ""
    return (
        F.when(empty & none, "no evidence required for none")
        .when(empty, "empty evidence quote rejected for positive claim")
        .when(is_grounded, "evidence quote found in lesson raw text")
        .otherwise("evidence quote NOT found in lesson raw text (possible fabrication)")
    )


def evidence_key(evidence: Column, tokens: int = 12) -> Column:
    """First words (of two characters or more) of the folded evidence; null for short evidence."""
    quote = normalized(evidence)
    words = F.filter(F.split(quote, " "), lambda w: F.length(w) > 1)
    return F.when((F.length(quote) >= 40) & (F.size(words) >= 5), F.array_join(F.slice(words, 1, tokens), " "))


def scrub_brackets(text: Column) -> Column:
    """Without [notes], closed or not; single spaces, none before punctuation."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), BRACKETS, " "), r"\s+", " "))
    return F.regexp_replace(plain, r"\s+([.,;:!?])", "$1")


def _fold(text: str) -> str:
    t = unicodedata.normalize("NFKC", text or "").translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()
    return " ".join(re.sub(r"(?m)^\s*-\s*", " ", t.translate(str.maketrans("_'\"", "   "))).split())


def longest_window(quote: str, hay: str, least: int = LEAST_CHARS) -> str | None:
    """The longest run of the quote's words that the folded source has.

    What holds for a run holds for its parts, so the end never goes back as the start advances.
    """
    words, best, end = quote.split(), "", 0
    for start in range(len(words)):
        end = max(end, start)
        while end < len(words) and _fold(" ".join(words[start : end + 1])) in hay:
            end += 1
        run = " ".join(words[start:end])
        if len(run) > len(best):
            best = run
    return best if len(best) >= least else None


def widened(quote: str, source: str, hay: str, least: int = LEAST_CHARS) -> str | None:
    """A short quote that the source has, with the source's next words (then those before) until it is long enough."""
    needle = _fold(quote)
    if len(quote) >= least or len(needle) < LEAST_PART or needle not in hay:
        return None
    words, best, start = source.split(), None, 0
    for end in range(1, len(words) + 1):  # least span: advance the start while the rest still has the needle
        if needle in _fold(" ".join(words[start:end])):
            while needle in _fold(" ".join(words[start + 1 : end])):
                start += 1
            if best is None or end - start < best[1] - best[0]:
                best = (start, end)
            start += 1
    if best is None:
        return None
    i, j = best
    while len(" ".join(words[i:j])) < least and (j < len(words) or i > 0):
        i, j = (i, j + 1) if j < len(words) else (i - 1, j)
    out = " ".join(words[i:j])
    return out if len(out) >= least and _fold(out) in hay else None


def _parts(needle: str) -> list[str]:
    return [p for p in map(str.strip, re.split(STITCH, needle)) if len(p) >= LEAST_PART]


def _contained(needle: str, hay: str) -> bool:
    parts = _parts(needle) if re.search(STITCH, needle) else []
    return bool(needle) and (needle in hay or (bool(parts) and all(p in hay for p in parts)))


def _page_of(quote: str, source: str) -> int | None:
    needle = _fold(quote)
    if re.search(STITCH, needle):
        needle = next(iter(_parts(needle)), "")
    for section in re.split(PAGE_LINE, source) if needle else ():
        if (m := re.search(PAGE_NUMBER, section)) and needle in _fold(section):
            return int(m[1])
    return None


def first_grounded(quotes: list[str], source: str) -> str | None:
    """The first quote that the source bears out: as it is, without notes, its longest run of words, its stitched pieces, or widened."""
    hay, tried = _fold(source), {}
    for quote in (q.strip() for q in quotes if q and q.strip()):
        clean = re.sub(r"\s+([.,;:!?])", r"\1", " ".join(re.sub(BRACKETS, " ", quote).split()))
        for base in (quote, clean, longest_window(clean or quote, hay)):
            for piece in (base, *re.split(r"\s+/\s+", base), *re.split(STITCH, base)) if base else ():
                tried.setdefault(_fold(piece), piece.strip())
    for key, piece in tried.items():
        if key and len(piece) >= LEAST_CHARS and _contained(key, hay):
            return piece
        if key and (wide := widened(piece, source, hay)):
            return wide
    return None


def repaired(quotes: Column, source: Column) -> Column:
    """First grounded form of a row's quotes; null if there is none."""

    @F.pandas_udf(StringType())
    def run(lists: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([first_grounded([] if q is None else list(q), s or "") for q, s in zip(lists, sources, strict=True)])

    return run(quotes, source)


def page_of(evidence: Column, source: Column) -> Column:
    """The page of the first section, from a line with (page N) on, that has the quote or the first of its parts."""
    evidence, source = F.coalesce(evidence, F.lit("")), F.coalesce(source, F.lit(""))
    quote = folded(evidence)
    needle = F.when(quote.rlike(STITCH), F.get(parts_of(quote), F.lit(0))).otherwise(quote)
    sections = F.filter(F.split(source, PAGE_LINE), lambda s: s.rlike(PAGE_NUMBER))
    hit = F.filter(sections, lambda s: F.contains(folded(s), needle))
    plain = F.when(needle != "", F.regexp_extract(F.get(hit, F.lit(0)), PAGE_NUMBER, 1).try_cast("int"))
    odd = evidence.rlike(NOT_ASCII) | source.rlike(NOT_ASCII)

    @F.pandas_udf(IntegerType())
    def composed_first(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([None if q is None else _page_of(q, s) for q, s in zip(quotes, sources, strict=True)], dtype="Int32")

    return F.when(odd, composed_first(F.when(odd, evidence), F.when(odd, source))).otherwise(plain)


def invents_timing(rationale: Column) -> Column:
    return F.coalesce(rationale, F.lit("")).rlike(TIMING_GATE)


def scrubbed_timing(rationale: Column) -> Column:
    """Without the sentences that make reading time a condition, and with a note if there were any."""
    text = F.trim(F.coalesce(rationale, F.lit("")))
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(TIMING_GATE) & ~(p.rlike(TIMING_WORDS) & p.rlike(SCORE_WORDS)))
    left = F.array_join(sentences, " ")
    body = F.when(left == "", TIMING_EMPTY).otherwise(left)
    return F.when(invents_timing(text), F.concat_ws(" ", body, F.lit(TIMING_NOTE))).otherwise(text)


def list_waffle(rationale: Column, code: Column, status: Column, lists: list[str]) -> Column:
    """A rationale that argues both any-of and all-of, or either on a list document that is partial."""
    text = F.coalesce(rationale, F.lit(""))
    a, b = text.rlike(WAFFLE_OR), text.rlike(WAFFLE_ALL)
    return (a & b) | (F.trim(F.coalesce(code, F.lit(""))).isin(*lists) & (status == "partial") & (a | b))


def distinct_reasons(reasons: Column) -> Column:
    """Reasons that aren't null, the first of those that differ in case only, joined."""
    given = F.array_compact(reasons)
    first = F.filter(given, lambda r, i: ~F.exists(F.slice(given, F.lit(1), i), lambda q: F.lower(q) == F.lower(r)))
    return F.array_join(first, "; ")


def review_flags(df: DataFrame, lists: list[str] = ()) -> DataFrame:
    """Sets needs_review and review_reason from confidence, rejection, list waffle and timing.

    df: needs_review, review_reason, confidence, rejected, invented_timing, doc_id, rationale, status.
    """
    own = F.trim(F.coalesce("review_reason", F.lit("")))
    confidence = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    reasons = F.array(
        F.when(F.col("needs_review"), F.when(own != "", own).otherwise("overlay review trigger")),
        F.when(confidence.isin("low", "medium"), F.concat(F.lit("confidence="), confidence)),
        F.when(F.col("rejected"), "grounding rejection"),
        F.when(list_waffle(F.col("rationale"), F.col("doc_id"), F.col("status"), list(lists)), "list-standard waffle (OR vs separable)"),
        F.when(F.col("invented_timing"), "invented while/after-reading timing (P5)"),
    )
    flagged = df.withColumn("review_reason", distinct_reasons(reasons))
    return flagged.withColumn("needs_review", F.col("review_reason") != "")


def scope_caveat(code: Column, source: Column, affected: list[str]) -> Column:
    """A caveat where an affected document's source cites a guide whose questions (three lines or more in its section) it lacks."""
    lines = F.split(F.coalesce(source, F.lit("")), "\n")
    state = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def step(acc, line):
        title = line.rlike(GUIDE_TITLE) & ~line.rlike(GUIDE_POINTER)
        left = line.startswith("[") & F.contains(F.substring(line, 1, 40), F.lit("]"))
        inside = title | (acc["inside"] & ~left)
        return F.struct(inside.alias("inside"), (acc["n"] + (inside & ~title & line.rlike(QUESTION_LINE)).cast("int")).alias("n"))

    questions = F.aggregate(lines, state, step)["n"]
    return F.when(F.trim(code).isin(*affected) & F.coalesce(source, F.lit("")).rlike(GUIDE) & (questions < 3), SCOPE_CAVEAT).otherwise("")


def escalates(status: Column, confidence: Column, needs_review: Column, evidence: Column, clauses: Column) -> Column:
    """Drafts to judge again: flagged, partial, unsure, positive without a quote, or full with a clause unmet or none given."""
    blank = F.trim(F.coalesce(evidence, F.lit(""))) == ""
    inconsistent = (F.coalesce(F.size(clauses), F.lit(0)) <= 0) | F.exists(clauses, lambda c: ~c["met"])
    return F.coalesce(needs_review, F.lit(False)) | (status == "partial") | confidence.isin("low", "medium") | (status.isin("full", "partial") & blank) | ((status == "full") & F.coalesce(inconsistent, F.lit(True)))


def draft_of(df: DataFrame) -> DataFrame:
    """A client's answer (alignment, clauses of clause, judgment, why, student_quote; evidence, location, needs_review, review_reason) as a draft."""
    why = lambda c: F.trim(F.coalesce(c["why"], F.lit("")))
    note = lambda c: F.when((c["judgment"] == "met") | (why(c) != ""), why(c)).when(c["judgment"] == "partially_met", "partially met").otherwise("not met")
    clauses = F.transform("clauses", lambda c: F.struct(c["clause"].alias("clause"), (c["judgment"] == "met").alias("met"), note(c).alias("note")))
    quotes = F.when(F.col("alignment") != "none", F.filter(F.transform("clauses", lambda c: F.trim(F.coalesce(c["student_quote"], F.lit("")))), lambda q: q != "")).otherwise(F.array().cast("array<string>"))
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return df.withColumns(
        {
            "status": F.col("alignment"),
            "rationale": F.coalesce(full(F.col("evidence")), full(F.col("review_reason")), F.concat(F.lit("alignment="), "alignment")),
            "evidence_candidates": quotes,
            "evidence_page": F.regexp_extract(F.coalesce("location", F.lit("")), r"(?i)page\s+(\d+)", 1).try_cast("int"),
            "confidence": F.when(F.col("needs_review"), "low").otherwise("high"),
        }
    ).withColumns({"clauses": clauses, "evidence": F.coalesce(F.get("evidence_candidates", F.lit(0)), F.lit(""))})


def finalize(drafts: DataFrame, source: str, lists: list[str] = (), repair: str | None = None) -> DataFrame:
    """Adds grounded, grounding_note, final_status; sets evidence, confidence, rationale, needs_review and review_reason.

    none clears the evidence; a positive without grounds becomes none with low confidence and a
    note; a flagged high becomes low. repair: a column of further quotes to try when the first
    isn't grounded. drafts: doc_id, status, confidence, evidence; rationale, needs_review and
    review_reason may be absent.
    """
    given = {"rationale": F.lit(""), "needs_review": F.lit(False), "review_reason": F.lit("")}
    d = drafts.withColumns({c: v for c, v in given.items() if c not in drafts.columns})
    d = d.withColumns({"invented_timing": invents_timing(F.col("rationale")), "evidence": F.trim(F.coalesce("evidence", F.lit("")))})
    if repair:
        found = repaired(F.when(F.col("status") != "none", F.concat(F.array("evidence"), F.coalesce(repair, F.array().cast("array<string>")))), F.col(source))
        d = d.withColumn("evidence", F.coalesce(found, "evidence"))
    none = F.col("status") == "none"
    d = d.withColumn("evidence", F.when(none, "").otherwise(F.col("evidence")))
    d = d.withColumn("grounded", F.when(none, True).otherwise(grounded(F.col("evidence"), F.col(source))))
    d = d.withColumns({"grounding_note": grounding_note(F.col("evidence"), F.col("grounded"), none), "rejected": ~F.col("grounded"), "rationale": scrubbed_timing(F.col("rationale"))})
    d = d.withColumns({"confidence": F.when(F.col("rejected"), "low").otherwise(F.col("confidence")), "rationale": F.when(F.col("rejected"), F.concat("rationale", F.lit(REJECTED))).otherwise(F.col("rationale"))})
    d = review_flags(d, lists)
    return d.withColumns({"final_status": F.when(F.col("rejected"), "none").otherwise(F.col("status")), "confidence": F.when(F.col("needs_review") & (F.col("confidence") == "high"), "low").otherwise(F.col("confidence"))}).drop("rejected", "invented_timing")


def reconcile(verdicts: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """Labels that disagree inside a group: conflict flags, and the strict majority where there is one.

    Adds group_size, conflict, majority, final_status. Counts come from two-stage aggregates and
    are joined back, so a large group costs no single task its rows.
    """
    label = F.lower(F.trim(F.col(status)))
    usable = F.lit(True)
    for k in key:
        usable = usable & F.col(k).isNotNull()
    per = verdicts.filter(usable).groupBy(*key, label.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    groups = per.groupBy(*key).agg(F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__labels"), F.max_by("__s", F.struct("__n", "__s")).alias("__top"), F.max("__n").alias("__most"))
    groups = groups.withColumns({"conflict": F.col("__labels") > 1, "majority": F.when((F.col("__labels") > 1) & (2 * F.col("__most") > F.col("group_size")), F.col("__top"))})
    out = verdicts.join(groups.drop("__labels", "__top", "__most"), key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return out.withColumn("final_status", F.coalesce("majority", label))


def flag_conflicts(reconciled: DataFrame, doc: str, confidence: str = "confidence", reason: str = "review_reason") -> DataFrame:
    """Rows of a conflict: flagged, high confidence made low, the reason and a note of the change added."""
    hit, old = F.col("conflict"), F.lower(F.trim(F.col("status")))
    said = F.concat(F.lit("cross-lesson inconsistency: "), F.col(doc).cast("string"), F.when(F.col("majority").isNotNull(), F.concat(F.lit("; reconciled→"), "majority")).otherwise(""))
    note = F.when(hit & (old != F.col("final_status")), F.concat(F.lit("[P3 CONSISTENCY: was "), old, F.lit(", aligned to "), "final_status", F.lit("]")))
    return reconciled.withColumns(
        {
            "needs_review": F.coalesce("needs_review", F.lit(False)) | hit,
            reason: F.when(hit, F.concat_ws("; ", F.nullif(F.trim(reason), F.lit("")), said)).otherwise(F.col(reason)),
            confidence: F.when(hit & (F.lower(confidence) == "high"), "low").otherwise(F.col(confidence)),
            "consistency_note": note,
        }
    )


def report(verdicts: DataFrame, entity: str, status: str, is_grounded: str) -> DataFrame:
    """Status counts per entity and the grounding rate over positives (null without positives)."""
    of = lambda s: F.count(F.when(F.col(status) == s, 1)).alias(f"n_{s}")
    positive = F.col(status) != "none"
    rate = F.bround(F.try_divide(F.count(F.when(positive & F.col(is_grounded), 1)), F.count(F.when(positive, 1))), 6)
    return verdicts.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *map(of, STATUSES), rate.alias("grounding_rate"))


def with_completeness(reports: DataFrame, expected: DataFrame, failed: DataFrame, entity: str) -> DataFrame:
    """Adds expected and failed counts, and complete: nothing failed and as many verdicts as candidates."""
    n = lambda df, name: df.groupBy(entity).agg(F.count(F.lit(1)).alias(name))
    met = n(expected, "expected").join(reports, entity, "left").join(n(failed, "failed"), entity, "left").fillna(0, ["n", "failed"])
    return met.withColumn("complete", (F.col("failed") == 0) & (F.col("n") == F.col("expected")))


def filtered_report(verdicts: DataFrame, statuses: list[str] | None, grounded_only: bool) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, one row of counts): `grounded_only` never drops none; missing confidence never drops a row."""
    out_status = F.lit(False) if statuses is None else ~F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    out_ground = ~out_status & F.lit(grounded_only) & (F.col("status") != "none") & ~F.coalesce("grounded", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    counts = verdicts.agg(*[n(F.col("status") == s).alias(f"all_{s}") for s in STATUSES], n(out_status).alias("filtered_by_status"), n(out_ground).alias("filtered_ungrounded"), n(~out_status & ~out_ground).alias("row_count"))
    return verdicts.filter(~out_status & ~out_ground), counts


#: Columns of the flat report, in order.
REPORT_COLUMNS = (
    "resource_id", "standard_code", "matched_status", "needs_review", "review_reason", "confidence", "grounded", "evidence", "evidence_page", "rationale", "standard_raw_text", "judge_model",
    "prompt_version", "escalated", "rerank_score", "rrf_score", "dense_score", "bm25_score", "dense_rank", "bm25_rank", "coverage_pass", "grounding_note", "input_scope_caveat",
)


def flat_report(verdicts: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Verdict records with a nested retrieval struct as the flat report; a record's missing id is its file's."""
    fields = {f.name for f in verdicts.schema["retrieval"].dataType.fields}
    trimmed = {"standard_code", "matched_status", "confidence"}
    blank = {"review_reason", "evidence", "rationale", "standard_raw_text", "judge_model", "prompt_version", "grounding_note", "input_scope_caveat"}

    def one(name: str) -> Column:
        if name == "resource_id":
            return F.trim(F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(file_id)))
        if name in fields:
            return F.coalesce(F.col(f"retrieval.{name}"), F.lit(False)) if name == "coverage_pass" else F.col(f"retrieval.{name}")
        if name not in verdicts.columns:
            return F.lit("") if name in blank else F.lit(None)
        return F.trim(F.coalesce(name, F.lit(""))) if name in trimmed else F.coalesce(name, F.lit("")) if name in blank else F.col(name)

    return verdicts.select(*[one(c).alias(c) for c in REPORT_COLUMNS])


def key_violations(drafts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, extra or repeated among the drafts."""
    got = drafts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    met = expected.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(got, keys, "full_outer")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return met.withColumn("violation", kind).filter("violation IS NOT NULL").select(*keys, "violation")


def loaded_and_failed(rows: DataFrame, texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their text, rows whose text is missing or blank, with a reason)."""
    met = rows.join(texts.select(key, F.col(text).alias("__t"), F.lit(True).alias("__have")), key, "left")
    good = F.trim(F.coalesce("__t", F.lit(""))) != ""
    reason = F.when(F.col("__have").isNull(), "missing").otherwise("blank")
    return met.filter(good).withColumnRenamed("__t", text).drop("__have"), met.filter(~good).withColumn("reason", reason).drop("__t", "__have")


def uncovered(claimed: Column, covered: Column) -> Column:
    return F.array_sort(F.array_except(claimed, covered))


def add_families(selected: DataFrame, texts: DataFrame, families: list[tuple[str, str, list]], available: DataFrame, most: int = 8) -> DataFrame:
    """Documents of activity families whose pattern an entity's text has, if available and not selected yet."""
    found = None
    for turn, (name, pattern, codes) in enumerate(families):
        hit = texts.filter(F.col("text").rlike(pattern)).select("entity_id", F.posexplode(F.array(*map(F.lit, codes))).alias("at", "doc_id"))
        hit = hit.select("entity_id", "doc_id", F.lit(turn).alias("turn"), "at", F.lit(name).alias("family"))
        found = hit if found is None else found.unionByName(hit)
    new = found.join(selected.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti").join(available.select("doc_id").distinct(), "doc_id", "left_semi")
    new = new.groupBy("entity_id", "doc_id").agg(F.min(F.struct("turn", "at", "family")).alias("f"))
    return new.withColumn("place", F.row_number().over(W.partitionBy("entity_id").orderBy("f"))).filter(F.col("place") <= most).select("entity_id", "doc_id", "f.family", "place")


def judged_set(ranked: DataFrame, extras: DataFrame, limit: int) -> DataFrame:
    """The first `limit` ranked rows of each entity, then its coverage extras in their order (flagged coverage_pass)."""
    head = ranked.filter(F.col("rank") <= limit).select("entity_id", "doc_id", "rank", F.lit(False).alias("coverage_pass"))
    new = extras.join(head.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti").select("entity_id", "doc_id", (F.col("place") + limit).alias("rank"), F.lit(True).alias("coverage_pass"))
    return head.unionByName(new).withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy("rank", "doc_id")))
