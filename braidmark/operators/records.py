"""Clean-up of nested records: codes, evidence, actions, vocabulary, query arms. Expressions over columns and arrays; joins where sources are needed."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from braidmark.session import written

# Code patterns, sections, roles, patterns of readiness, written work and phonics.
STANDARD_CODE = r"\b([A-Z]{1,4}\.(?:K|\d+)\.\d+[a-z]{0,3})\b"
_ONE = r"(?:W|L|(?![IVX]{2,4}\.)[A-Z]{2,4})\.(?:K|\d+)\.\d+[a-z]{0,3}"
CODE_LIST = rf"\b{_ONE}(?:\s*,\s*{_ONE})*(?:\s*,?\s*and\s+{_ONE})?\b"
LESSON_CODE = r"^G(\d+)M(\d+)U(\d+)L(\d+)"
SECTIONS = (("Opening", "Opening"), ("Work Time", "Work Time"), ("Closing", "Closing and Assessment"))
FURNITURE = r"(?i)^\d{1,4}$|Unit\s+\d+\s*:\s*Lesson\s+\d+|Curriculum\s+\d{1,4}\s*$"
PREPARATION = r"(?i)^\s*[-–—•]?\s*(?:Post\s*:|In advance\b|During (?:Opening|Work Time|Closing)\b|Circulate\b|Prepare\b|Refer to the Classroom Protocols\b)|^\s*[-–—•]\s*.*\b(?:routine|protocols?)\b"
ACTORS = {"directive_prompt": "student", "elicitation_check": "student", "student_production": "student", "teacher_model": "teacher", "teacher_scribe": "teacher"}
READINESS = r"(?is)thumbs[- ]up.{0,80}ready to begin|ready to begin (?:writing|drawing|reading|listening)|are you ready\b|show (?:me |a )?thumbs[- ]up if (?:you|they) are ready"
WRITTEN = r"(?is)white\s*boards?.{0,160}?record\s*\([^)]*(?:drawing|writing)|(?:invite|have)\s+students\s+to\s+(?:write|begin\s+writing|begin\s+drawing)\b|(?:invite|have)\s+students\s+to\s+draw\b(?!\s+from\b)(?!\s+on\b)(?!\s+upon\b)|invite\s+students\s+to\s+complete.{0,80}?response\s+sheet|students\s+begin\s+(?:writing|drawing)\b|begin\s+working.{0,60}?(?:response\s+sheet|writing\s+and\s+drawing)|tell\s+students\s+that\s+today\s+they\s+will\s+(?:write|draw|complete.{0,40}?response\s+sheet)"
NOT_WRITTEN = r"(?is)\bnext\s+lesson\b|\bsubsequent\s+lesson\b|\bnext\s+few\s+lessons\b|\bin\s+a\s+later\s+lesson\b|\bwill\s+soon\s+begin\b|\bprepare\s+to\s+begin\s+writing\b|draw\s+students['’]?\s+attention\b|authors?\s+write\b|writers?\s+use\b|why\s+do\s+(?:authors|writers)\b|what\s+does\s+a\s+writer\b|if\s+he\s+can\s+write\b|draw\s+from\s+this\s+language\b|high[- ]quality\s+writing\b|above\s+the\s+target,\s*draw\s+a\s+simple\s+picture|ready\s+to\s+begin\s+(?:writing|drawing)|thumbs[- ]up.{0,80}ready"
OMISSION = r"(?i)\bphonics\b|\bdecoding\b|\bencoding\b|\bdecode\b|\bencode\b"
PHONICS = r"(?is)\bphonics\b|\bdecoding\b|\bencoding\b|\bdecode(?:s|d|ing)?\b|\bencode(?:s|d|ing)?\b|\bsound(?:s|ed|ing)?\s+out\b|\bstretch(?:ed|ing)?\s+and\s+spell|\btricky\s+spelling\b|\bletter[\s-]*sound\b|\bgrapheme\b|\bphoneme\b|\bblend(?:s|ed|ing)?\s+(?:the\s+)?(?:sounds?|word)|\bsegment(?:s|ed|ing)?\s+(?:the\s+)?(?:sounds?|word)|\bCVC\b|\bdigraph\b|\balphabet\s+or\s+letter\s+sound|\bspelled\s+the\s+word\b|\bspell\s+the\s+word\b|\bWord\s+Wall\b.{0,80}?\bspell\b|\bproperly\s+spell\b"
BOILERPLATE = ("classroom", "discussion", "evidence", "lesson", "learn", "objective", "practice", "prompt", "required", "student", "students", "target", "task", "teacher", "will")
NONE_OBSERVED = "NONE OBSERVED"
FOLD_FROM, FOLD_TO = "‘’“”–— ", "''\"\"-- "


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"\s+", " "))


def codes_of(text: Column) -> Column:
    """Distinct codes in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(_text(text), F.lit(STANDARD_CODE), F.lit(1)))


def without_trailing_codes(text: Column) -> Column:
    return F.trim(F.get(F.split(_text(text), r"\s*\(?[A-Z]{1,4}\.(?:K|\d)"), F.lit(0)))


def lesson_numbers(code: Column) -> Column:
    """grade, module, unit, lesson of a code like G1M2U3L4; null otherwise."""
    part = lambda i: F.regexp_extract(_text(code), LESSON_CODE, i).try_cast("int")
    return F.when(_text(code).rlike(LESSON_CODE), F.struct(part(1).alias("grade"), part(2).alias("module"), part(3).alias("unit"), part(4).alias("lesson")))


def redacted(text: Column) -> Column:
    """Without codes and lists of codes; what they leave behind is tidied only if there were any."""
    t = F.regexp_replace(text, CODE_LIST, "")
    for pattern, to in ((r"\s{2,}", " "), (r"\s+([,;:.])", "$1"), (r"\(\s*[,;]*\s*\)", ""), (r"(?i)\b(using|including|with|via)\s+and\s+", "$1 "), (r",\s*,+", ","), (r"(?i)\band\s+and\b", "and"), (r"\s{2,}", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.when(text.rlike(CODE_LIST), F.btrim(t, F.lit(" ,;"))).otherwise(text)


def is_noise(line: Column) -> Column:
    """Page furniture, preparation notes and blank lines."""
    t = F.trim(_text(line))
    return (t == "") | t.rlike(FURNITURE) | t.rlike(PREPARATION)


def canonical_section(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, section in reversed(SECTIONS):
        out = F.when(name.startswith(prefix), section).otherwise(out)
    return out


def lenient_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]", "")


def folded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Typographic quotes, dashes and spaces folded in the text and text-array columns named."""
    fold = lambda c: F.translate(c, FOLD_FROM, FOLD_TO)
    return df.withColumns({c: F.transform(c, fold) if df.schema[c].dataType.typeName() == "array" else fold(F.col(c)) for c in columns})


def distinct_texts(items: Column) -> Column:
    """Array items that aren't blank, single-spaced, the first of those equal but for case and spaces."""
    given = F.filter(F.transform(items, spaced), lambda x: x != "")
    return F.filter(given, lambda x, i: ~F.exists(F.slice(given, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def clean_page_text(text: Column) -> Column:
    """Wrapped words, minutes and codes joined, bullets dropped, spaces collapsed.

    A hyphen at a line's end goes, but stays between numbers and where the text has the hyphened
    form elsewhere.
    """
    t = _text(text)
    wrapped = F.regexp_extract_all(t, F.lit(r"(\w+)-\s*\n\s*(\w+)"), F.lit(0))
    left, right = (lambda w: F.regexp_extract(w, r"^(\w+)-", 1)), (lambda w: F.regexp_extract(w, r"(\w+)$", 1))

    def joined(acc: Column, w: Column) -> Column:
        hyphened = F.concat_ws("-", left(w), right(w))
        keep = F.contains(t, hyphened) | (left(w).rlike(r"^\d+$") & right(w).rlike(r"^\d+$"))
        return F.replace(acc, w, F.when(keep, hyphened).otherwise(F.concat(left(w), right(w))))

    out = F.regexp_replace(F.aggregate(wrapped, t, joined), r"-\s*\n\s*", "")
    out = F.regexp_replace(out, r"\((\d+)\s*\n\s*(minutes?\))", "($1 $2")
    out = F.regexp_replace(out, r"\b([A-Z]{1,4}\.(?:K|\d+)\.)\s*\n\s*(\d+[a-z]?)\b", "$1$2")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("•"), F.lit(" ")), r"\s+", " "))


def total_minutes(agenda: Column) -> Column:
    """Sum of an agenda's printed minutes; null if none is printed."""
    printed = F.filter(F.transform(agenda, lambda a: a["minutes"]), lambda m: m.isNotNull())
    return F.when(F.size(printed) > 0, F.aggregate(printed, F.lit(0), lambda a, x: a + x))


def pacing(agenda: Column) -> Column:
    total = F.coalesce(total_minutes(agenda), F.lit(0))
    return F.when(total > 0, F.concat(total.cast("string"), F.lit(" minutes"))).otherwise("")


def with_role_actors(evidence: Column) -> Column:
    """The actor of each item is the one its role implies, where it implies one."""
    return F.transform(evidence, lambda e: e.withField("actor", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTORS.items() for x in kv]), e["evidence_role"]), e["actor"])))


def without_readiness_actions(evidence: Column) -> Column:
    """Prompts that only ask whether students are ready support no action."""
    none = lambda e: F.slice(e["supports_action"], 1, 0)
    return F.transform(evidence, lambda e: e.withField("supports_action", F.when(_text(e["quote"]).rlike(READINESS), none(e)).otherwise(e["supports_action"])))


def without_contradicted_omissions(omissions: Column, source: Column, strands: Column) -> Column:
    """Claims that phonics was not taught go where the source shows it or a strand names it."""
    shown = _text(source).rlike(PHONICS) | F.array_contains(strands, "Phonics")
    return F.when(F.coalesce(shown, F.lit(False)), F.filter(omissions, lambda o: ~_text(o).rlike(OMISSION))).otherwise(omissions)


def written_steps(steps: DataFrame) -> DataFrame:
    """entity_id and the first step (by block and step place) that has students write or draw: section, letter, step.

    steps: entity_id, block, section, letter, step, text.
    """
    t = F.trim(_text(F.col("text")))
    hit = steps.filter((F.trim(_text(F.col("section"))) != "") & (F.trim(_text(F.col("letter"))) != "") & t.rlike(WRITTEN) & ~t.rlike(NOT_WRITTEN))
    first = F.min_by(F.struct("section", "letter", t.alias("step_text")), F.struct("block", "step"))
    return hit.groupBy("entity_id").agg(first.alias("f")).select("entity_id", "f.*")


def demoted_actions(actions: Column, evidence: Column) -> Column:
    """A map of actions whose unsupported ones are NONE OBSERVED."""
    covered = F.flatten(F.transform(evidence, lambda e: e["supports_action"]))
    return F.transform_values(actions, lambda k, v: F.when((F.trim(_text(v)) != "") & (v != NONE_OBSERVED) & ~F.array_contains(covered, k), NONE_OBSERVED).otherwise(v))


def located(evidence: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with the location of its block, evidence that joins none).

    evidence: entity_id, at, location ("section letter rest"); blocks: entity_id, section, letter.
    A section matches as it is, or as the beginning of the only longer one of that letter.
    """
    parsed = evidence.withColumns({"__hint": F.trim(F.regexp_extract("location", r"^\s*(.+?)\s+([A-Z])\b(.*)$", 1)), "__letter": F.regexp_extract("location", r"^\s*(.+?)\s+([A-Z])\b(.*)$", 2), "__rest": F.trim(F.regexp_extract("location", r"^\s*(.+?)\s+([A-Z])\b(.*)$", 3))})
    known = blocks.filter("trim(section) != '' AND trim(letter) != ''").select("entity_id", F.trim("section").alias("__section"), F.trim("letter").alias("__letter")).distinct()
    met = parsed.join(known, ["entity_id", "__letter"], "left")
    exact = F.col("__section") == F.col("__hint")
    longer = F.col("__section").startswith(F.col("__hint")) & (F.length("__hint") > 0) & F.substr(F.col("__section"), F.length("__hint") + 1, F.lit(1)).isin(" ", "&", "/")
    names = F.array_compact(F.array_distinct(F.collect_list(F.when(longer, F.col("__section")))))
    found = met.groupBy("entity_id", "at", "location", "__letter", "__rest").agg(F.max(F.when(exact, F.col("__section"))).alias("__e"), names.alias("__l"))
    found = found.select("entity_id", "at", "location", "__letter", "__rest", F.coalesce("__e", F.when(F.size("__l") == 1, F.get("__l", F.lit(0)))).alias("__s"))
    found = written(found, "located")  # both sides are read from it
    block = F.concat_ws(" ", "__s", "__letter")
    joined = F.when(F.col("__rest") == "", block).when(F.substring("__rest", 1, 1).isin(*",;:)]}"), F.concat(block, "__rest")).otherwise(F.concat_ws(" ", block, "__rest"))
    return found.filter("__s IS NOT NULL").select("entity_id", "at", joined.alias("location")), found.filter("__s IS NULL").select("entity_id", "at", "location")


def grams_of(text: Column) -> Column:
    """The three-character pieces of a text, in order."""
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def quote_candidates(quotes: DataFrame, lines: DataFrame, least_ratio: float, least_reverse: int) -> DataFrame:
    """q, x: which lines (x, entity_id, __x) a quote (q, entity_id, __q) can equal, be part of, contain, or be similar to; no such pair is missing.

    From an index of each entity's grams, the rarest first. A line that contains a quote has the
    quote's rarest gram, and a quote that contains a line has the line's. Texts of la and lb
    characters with a similarity of r or more have unlike characters s = (1 - r) * (la + lb) at
    most, so at most s + 1 equal stretches, and share (la + lb) * r / 2 - 2 * (s + 1) grams or
    more: of the quote's grams so many but one can be missed, and one of the others, taken from
    the rarest on, must be in the line. Their lengths differ by a factor of r / (2 - r) at most.
    Quotes too short for that meet lines of like lengths.
    """
    factor = least_ratio / (2 - least_ratio)
    index = lines.select("entity_id", "x", F.length("__x").alias("lb"), F.explode(F.array_distinct(grams_of(F.col("__x")))).alias("gram"))
    df = index.groupBy("entity_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    own = quotes.select("entity_id", "q", F.length("__q").alias("la"), F.explode(grams_of(F.col("__q"))).alias("gram")).groupBy("entity_id", "q", "la", "gram").agg(F.count(F.lit(1)).alias("times"))
    own = own.join(df, ["entity_id", "gram"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = W.partitionBy("q").orderBy("df", "gram")
    own = own.withColumns({"turn": F.row_number().over(rare), "before": F.sum("times").over(rare) - F.col("times")})
    least = (2.5 * least_ratio - 2) * F.col("la") * (1 + factor) - 2  # shared grams of the shortest line that is like enough
    own = own.withColumn("needed", F.ceil(least - 1e-9)).withColumn("near", (F.col("needed") >= 1) & (F.col("before") <= F.col("la") - 2 - F.col("needed")))
    met = own.filter("near OR turn = 1").join(index, ["entity_id", "gram"])
    like = F.col("near") & (F.col("lb") >= factor * F.col("la") - 1e-9) & (factor * F.col("lb") <= F.col("la") + 1e-9)
    pairs = met.filter(like | ((F.col("turn") == 1) & (F.col("lb") >= F.col("la")))).select("q", "x")
    first = index.filter(F.col("lb") >= least_reverse).join(df, ["entity_id", "gram"]).groupBy("entity_id", "x").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    pairs = pairs.unionByName(own.join(first, ["entity_id", "gram"]).select("q", "x"))
    # quotes without a gram that must be shared, and those without any gram
    short = quotes.select("entity_id", "q", F.length("__q").alias("la")).filter(least < 1e-9)
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(factor * F.col("la") - 1e-9)).cast("int"), F.floor(F.col("la") / factor + 1e-9).cast("int"))
    by_length = short.select("entity_id", "q", F.explode(lengths).alias("lb")).join(lines.select("entity_id", "x", F.length("__x").alias("lb")), ["entity_id", "lb"]).select("q", "x")
    tiny = short.filter("la < 3").join(lines.select("entity_id", "x"), "entity_id").select("q", "x")
    return pairs.unionByName(by_length).unionByName(tiny).distinct()


def verbatim(quotes: DataFrame, lines: DataFrame, least_ratio: float = 0.88, least_reverse: int = 24, most_pairs: int = 1 << 16) -> DataFrame:
    """Each quote's source line: equal, the shortest that contains it, the longest (of enough characters) that it contains, else the most similar.

    quotes: entity_id, at, quote, block (may be null); lines: entity_id, line_no, line, block. Quote
    marks, case and spaces don't count; among lines of one class those of the quote's block come
    first. Quotes and lines of an entity of at most most_pairs pairs meet as they are, each text
    shuffled once a pass; of larger ones only pairs that an index of grams lets through are looked at
    (see quote_candidates), which shuffles every gram of their texts. Only quotes that no line settles
    are compared by similarity, with lines of like lengths. Null: nothing near enough.
    """
    fold = lambda c: F.lower(F.translate(spaced(c), "\"“”‘’", "'''''"))
    own = written(quotes.select("entity_id", "at", F.col("block").alias("__block"), fold(redacted(F.col("quote"))).alias("__q")).filter("__q != ''").withColumn("q", F.monotonically_increasing_id()), "quotes")
    text = written(lines.select("entity_id", "line_no", "line", F.col("block").alias("__b"), fold(F.col("line")).alias("__x")).filter("__x != ''").withColumn("x", F.monotonically_increasing_id()), "lines")
    n = lambda df, name: df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))
    large = written(n(own, "n").join(n(text, "m"), "entity_id").filter(F.col("n") * F.col("m") > most_pairs).select("entity_id"), "large")
    some = not large.isEmpty()
    of_large = lambda df, how: df.join(F.broadcast(large), "entity_id", how) if some else df
    if some:
        pairs, known = written(quote_candidates(of_large(own, "left_semi"), of_large(text, "left_semi"), least_ratio, least_reverse), "pairs"), of_large(text, "left_semi").drop("entity_id")

    def met_by(asked: DataFrame) -> DataFrame:
        """Quotes with the lines that they may have to do with."""
        columns = [*asked.columns, "line_no", "line", "__b", "__x"]
        plain = of_large(asked, "left_anti").join(of_large(text, "left_anti"), "entity_id").select(columns)
        return plain.unionByName(pairs.join(of_large(asked, "left_semi"), "q").join(known, "x").select(columns)) if some else plain

    met = met_by(own)
    kind = F.when(F.col("__q") == F.col("__x"), 0).when(F.contains("__x", F.col("__q")), 1).when(F.contains("__q", F.col("__x")) & (F.length("__x") >= least_reverse), 2)
    away = F.coalesce((F.col("__block") != F.col("__b")) | (F.col("__block").isNotNull() & F.col("__b").isNull()), F.lit(False)).cast("int")
    size = F.when(kind == 2, -F.length("line")).when(kind == 1, F.length("line")).otherwise(0)
    order = F.struct(kind.alias("k"), F.when(kind > 0, away).otherwise(0).alias("w"), size.alias("s"), "line_no", "line")
    settled = met.filter(kind.isNotNull()).withColumn("__o", order).groupBy("entity_id", "at").agg(F.min("__o").alias("o")).select("entity_id", "at", F.col("o.line").alias("__sure"))

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x: str, y: str) -> float:
            both = SequenceMatcher(None, x, y)
            return both.ratio() if both.quick_ratio() >= least_ratio else 0.0

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)])

    settled = written(settled, "settled")  # read twice
    open_ = own.join(settled, ["entity_id", "at"], "left_anti").select("q", "entity_id", "at", "__q")
    a, b = F.length("__q"), F.length("__x")
    like = 2 * F.least(a, b) >= (least_ratio - 1e-9) * (a + b)
    rest = met_by(open_).filter(like).withColumn("__r", ratio("__q", "__x"))
    near = rest.groupBy("entity_id", "at").agg(F.max(F.struct("__r", (-F.col("line_no")).alias("n"), "line")).alias("b")).filter(F.col("b.__r") >= least_ratio).select("entity_id", "at", F.col("b.line").alias("__near"))
    out = quotes.join(settled, ["entity_id", "at"], "left").join(near, ["entity_id", "at"], "left")
    return out.withColumn("source_line", F.coalesce("__sure", "__near")).drop("__sure", "__near")


def split_vocabulary(terms: DataFrame) -> DataFrame:
    """entity_id, bucket (new or review), terms: each term in the bucket of its last mention, in the order and spelling of the first.

    terms: entity_id, at, bucket, term.
    """
    key = F.lower(spaced(F.col("term")))
    per = terms.filter(spaced(F.col("term")) != "").groupBy("entity_id", key.alias("k")).agg(F.max_by("bucket", "at").alias("bucket"), F.min("at").alias("first"), F.min_by(spaced(F.col("term")), "at").alias("term"))
    return per.groupBy("entity_id", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "term"))), lambda x: x["term"]).alias("terms"))


def concise(text: Column, most: int = 360) -> Column:
    """Single-spaced and cut to `most` characters: after the last sentence end in the second half, else at a word."""
    t = spaced(text)
    head = F.substring(t, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.?;])\s", 1)
    word = F.regexp_replace(head, r"\s\S*$", "")
    return F.when(F.length(t) <= most, t).when(F.length(sentence) > most // 2, sentence).otherwise(F.trim(word))


def query_arms(items: DataFrame, most_queries: int = 24, most_chars: int = 360, least_chars: int = 12, near: float = 0.88) -> DataFrame:
    """entity_id, query_index (from 1), source, text: concise texts of enough characters, near-duplicates of earlier ones dropped, the first by source priority.

    items: entity_id, at, source, priority, text. Whether a text is dropped depends on those kept
    before it, so an entity's texts (some dozens) are one array, folded in the JVM in order of `at`.
    """
    short = items.withColumn("text", concise(F.col("text"), most_chars)).filter(F.length("text") >= least_chars)
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(*BOILERPLATE))
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    lists = short.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "priority", "source", "text", key.alias("key"), words.alias("words")))).alias("items"))

    def same(a: Column, b: Column) -> Column:
        x, y = F.size(a["words"]), F.size(b["words"])
        shared = F.size(F.array_intersect(a["words"], b["words"]))
        return (a["key"] == b["key"]) | ((x > 0) & (y > 0) & ((shared >= near * (x + y - shared)) | (shared >= near * F.least(x, y))))

    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["priority"].alias("priority"), x["at"].alias("at"), x["source"].alias("source"), x["text"].alias("text"))))
    arms = lists.select("entity_id", F.posexplode(F.slice(ordered, 1, most_queries)).alias("i", "x"))
    return arms.select("entity_id", (F.col("i") + 1).alias("query_index"), "x.source", "x.text")


def bridges(entities: DataFrame, table: list[tuple[list[str], str, str]]) -> DataFrame:
    """entity_id, source, text of every bridge (signals, source, text) of which the entity's text has a signal."""
    blob = F.lower(_text(F.col("text")))
    hits = []
    for tokens, source, text in table:
        found = F.lit(False)
        for t in tokens:
            found = found | F.contains(blob, F.lit(t))
        hits.append(F.when(found, F.struct(F.lit(source).alias("source"), F.lit(text).alias("text"))))
    return entities.select("entity_id", F.inline(F.array_compact(F.array(*hits))))


def by_source(source: Column, exact: dict, prefixes: list[tuple], default: object) -> Column:
    """The value of a source: by its name, else by the first prefix that it has, else the default."""
    out = F.lit(default)
    for prefix, value in reversed(prefixes):
        out = F.when(source.startswith(prefix), F.lit(value)).otherwise(out)
    for name, value in exact.items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


def entity_grade(provenance: Column, level: Column, entity: Column) -> Column:
    """The grade from provenance, else from the level's text, else from the id."""
    return F.coalesce(F.trim(provenance.cast("string")).try_cast("int"), F.regexp_extract(_text(level), r"(?i)\bgrade\s*(\d+)\b", 1).try_cast("int"), F.regexp_extract(_text(entity), r"(?i)^G(\d+)", 1).try_cast("int"))


def skill_overlap(pairs: DataFrame, focus: str, text: str, glue: tuple[str, ...] = (), out: str = "skill_overlap") -> DataFrame:
    """Adds the best share of a focus fragment's words that the text has; fragments of few words count less."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0)))
    whole = F.trim(_text(F.col(focus)))
    rough = F.filter(F.transform(F.split(whole, r"[\n;]+|·|\s{2,}|(?<=[.!?])\s+|\s+,\s+and\s+"), lambda p: F.btrim(p, F.lit(" -.\t"))), lambda p: F.length(p) >= 12)
    fragments = F.array_distinct(F.concat(rough, F.array(whole)))
    bags = F.transform(fragments, lambda f: F.array_except(words(f), F.array(*map(F.lit, glue)).cast("array<string>")))

    def cover(bag: Column, own: Column) -> Column:
        n, hit = F.size(bag), F.size(F.array_intersect(bag, own))
        discount = F.when(n <= 2, 0.25).when(n == 3, 0.55).otherwise(1.0)
        return F.when((n < 2) | (hit == 0) | ((hit < 2) & (n >= 4)), 0.0).otherwise(hit / n * discount)

    own = pairs.withColumn("__own", words(F.col(text)))
    return own.withColumn(out, F.coalesce(F.array_max(F.transform(bags, lambda b: cover(b, F.col("__own")))), F.lit(0.0))).drop("__own")


def domain_bonus(domains: Column, primary: Column, secondary: Column) -> Column:
    """1.0 if the document's primary domain is among the entity's, 0.6 if a secondary one is."""
    low = lambda a: F.transform(a, F.lower)
    return F.when(F.array_contains(low(domains), F.lower(primary)), 1.0).when(F.arrays_overlap(low(domains), low(secondary)), 0.6).otherwise(0.0)


def clean_standard(df: DataFrame, lists: list[str]) -> DataFrame:
    """List columns single-spaced without blanks and repeats; exact_codes begins with the own code if it lacks it; secondary domains distinct and other than the primary."""
    out = df.withColumns({c: distinct_texts(F.col(c)) for c in lists})
    codes = F.coalesce("exact_codes", F.array().cast("array<string>"))
    secondary = F.filter(distinct_texts(F.col("domain_secondary")), lambda d: F.lower(d) != F.lower(_text(F.col("domain_primary"))))
    return out.withColumns({"exact_codes": F.when(F.array_contains(codes, F.col("code")), codes).otherwise(F.array_prepend(codes, F.col("code"))), "domain_secondary": secondary})


def audit(records: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """entity_id, issue for every rule (name, condition) that a record meets; one pass over the records."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return records.select("entity_id", F.explode(hits).alias("issue"))


def clean_lesson(df: DataFrame) -> DataFrame:
    """The whole repair of a lesson record in its fixed order, apart from the joins with its source (`located`, `verbatim`, `written_steps`).

    df: agenda, evidence (quote, actor, evidence_role, supports_action), not_taught, source_text,
    strands, materials, actions (a map), objective.
    """
    out = df.withColumn("pacing", pacing(F.col("agenda")))
    out = out.withColumn("evidence", F.filter(F.transform("evidence", lambda e: e.withField("quote", redacted(e["quote"]))), lambda e: spaced(e["quote"]) != ""))
    out = out.withColumn("evidence", without_readiness_actions(with_role_actors(F.col("evidence"))))
    out = out.withColumn("not_taught", without_contradicted_omissions(F.transform("not_taught", redacted), F.col("source_text"), F.col("strands")))
    out = out.withColumns({"objective": redacted(F.col("objective")), "materials": F.transform(distinct_texts(F.filter("materials", lambda m: ~is_noise(m))), redacted), "actions": F.transform_values("actions", lambda _, v: redacted(v))})
    return out.withColumn("actions", demoted_actions(F.col("actions"), F.col("evidence")))
