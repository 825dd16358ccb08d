"""Texts put together from nested records: retrieval, embedding, judging and rerank texts, compact payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE_OBSERVED = "NONE OBSERVED"
#: The action slots in the order of the embed text.
ACTIONS = (
    "recognition_identification", "oral_production", "written_production", "matching_sorting_sequencing", "procedural_application",
    "investigation_handson", "representation_modeling", "reasoning_explanation", "comprehension_response",
)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _given(c: Column) -> Column:
    """Null where the text is blank or says that nothing was observed."""
    return F.when((_text(c) != "") & (F.upper(_text(c)) != NONE_OBSERVED), _text(c))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))


def _listed(items: Column, by: str = "; ") -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), _text), lambda x: x != ""), by)


def embed_text(code: Column, text: Column, domain: Column, behaviors: Column, actions: Column, codes: Column) -> Column:
    """Compact text: code and text, domain, behaviours, the observed actions in fixed order, and the codes."""
    done = [_line(a.replace("_", " "), _given(F.element_at(actions, a))) for a in ACTIONS]
    return F.concat_ws("\n", F.concat_ws(" ", _given(code), _given(text)), _line("Domain", _given(domain)), _line("Behaviors", _listed(behaviors)), *done, _line("Codes", _listed(codes, ", ")))


def retrieval_text(label: Column, raw: Column, competency: Column, terms: Column, clauses: Column, embedded: Column) -> Column:
    """Rich text: label, raw text, competency, terms and clauses, and the embed text unless they contain it."""
    body = F.concat_ws("\n", _given(label), _given(raw), _line("Competency", _given(competency)), _line("Terms", _listed(terms)), _line("Skills", _listed(clauses)))
    return F.when((_text(embedded) != "") & ~F.contains(body, _text(embedded)), F.concat_ws("\n", F.nullif(body, F.lit("")), _text(embedded))).otherwise(body)


def query_text(*parts: Column) -> Column:
    return F.concat_ws("\n", *[_given(p) for p in parts])


def judged_text(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """entity_id, text: the head lines, then each block's title and steps in order, a (page N) line wherever the page changes.

    blocks: entity_id, block, step, title, text, page (0: not found); heads: entity_id, title, targets (array).
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("entity_id").orderBy("block", "step")
    page = F.when(F.col("page") > 0, F.col("page"))
    seen = F.last(page, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    turned = F.when(page.isNotNull() & ~page.eqNullSafe(seen), F.concat(F.lit("(page "), page.cast("string"), F.lit(")")))
    first = F.row_number().over(W.partitionBy("entity_id", "block").orderBy("step")) == 1
    line = F.concat_ws("\n", turned, F.when(first, _given(F.col("title"))), _given(F.col("text")))
    body = blocks.withColumn("__line", line).groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "step", "__line"))), lambda x: x["__line"]), "\n").alias("__body"))
    met = heads.join(body, "entity_id", "left")
    return met.select("entity_id", F.concat_ws("\n", _given(F.col("title")), F.nullif(_listed(F.col("targets"), "\n"), F.lit("")), "__body").alias("text"))


def rerank_text(sections: list[tuple[str, Column]], most: int = 2400) -> Column:
    """Labelled sections that aren't blank, cut to `most` characters."""
    return F.substring(F.concat_ws("\n", *[_line(name, _given(value)) for name, value in sections]), 1, most)


def compact(df: DataFrame, texts: dict[str, int], lists: dict[str, int], dropped: list[str]) -> DataFrame:
    """Without the dropped columns, texts cut to so many characters, lists to so many items."""
    out = df.drop(*dropped)
    return out.withColumns({c: F.substring(c, 1, n) for c, n in texts.items()} | {c: F.slice(c, 1, n) for c, n in lists.items()})


def as_payload(df: DataFrame, columns: list[str], out: str = "payload") -> DataFrame:
    """Adds the columns as JSON, nulls left out."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def stamped(drafts: DataFrame, entities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Drafts with identity columns of their entity, whatever the draft says; the draft's own where the entity has none."""
    own = entities.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    met = drafts.join(own, key, "left")
    return met.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in drafts.columns else F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def candidate_output(df: DataFrame) -> DataFrame:
    """Candidates for output: no text or hit lists, as JSON without null fields."""
    return as_payload(df.drop("text", "arm_hits"), [c for c in df.columns if c not in ("text", "arm_hits")])


def top_rows(ranked: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """The first n rows of each entity with the document's raw text, else its competency, else the first line of its embed text."""
    text = F.coalesce(F.nullif(_text(F.col("raw_text")), F.lit("")), F.nullif(_text(F.col("competency")), F.lit("")), F.substring_index(_text(F.col("embed_text")), "\n", 1))
    return ranked.filter(F.col("rank") <= n).join(documents.select("doc_id", text.alias("text")), "doc_id", "left")


def retrieval_meta(ranked: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates with their retrieval columns as one struct, coverage_pass false where it isn't given."""
    flag = F.coalesce(F.col("coverage_pass"), F.lit(False)) if "coverage_pass" in ranked.columns else F.lit(False)
    own = [c for c in fields if c in ranked.columns and c != "coverage_pass"]
    return ranked.select("entity_id", "doc_id", F.struct(*own, flag.alias("coverage_pass")).alias("retrieval"))


def table_lines(tables: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables of two columns or more; all lines, those of one-column tables among them at their page, page 0 last).

    tables: doc, seq, page, n_cols, cells (array of arrays); lines: doc, page, seq, text.
    """
    single = tables.filter("n_cols < 2").select("doc", "page", "seq", F.posexplode(F.flatten("cells")).alias("at", "text"))
    both = lines.select("doc", "page", F.lit(0).alias("kind"), "seq", F.lit(0).alias("at"), "text").unionByName(single.select("doc", "page", F.lit(1).alias("kind"), "seq", "at", "text"))
    from pyspark.sql import Window as W

    order = W.partitionBy("doc").orderBy(F.when(F.col("page") > 0, F.col("page")).otherwise(1 << 30), "kind", "seq", "at")
    return tables.filter("n_cols >= 2"), both.withColumn("line_no", F.row_number().over(order)).select("doc", "line_no", "page", "text")


def dimensions(df: DataFrame, framework: str, run_id: str, states: dict[str, str]) -> DataFrame:
    """Adds state (the code of the state that a framework's name begins with) and run_date (eight digits of an id)."""
    state = F.lit(None).cast("string")
    for name, code in states.items():
        state = F.when(F.lower(framework).startswith(name.lower()), code).otherwise(state)
    day = F.regexp_extract(run_id, r"(?<!\d)(\d{8})(?!\d)", 1)
    return df.withColumns({"state": state, "run_date": F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")})


def record_violations(lessons: DataFrame, known_actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """code, rule, detail of lessons that break a rule: span order, id of other parts, unknown action keys, claims without evidence, tables with ragged rows.

    lessons: code, grade, module, unit, lesson, page_start, page_end, actions (a map), supported (array), tables (array of arrays of arrays).
    """
    expected = F.concat(F.lit("G"), "grade", F.lit("M"), "module", F.lit("U"), "unit", F.lit("L"), "lesson")
    unknown = F.array_except(F.map_keys("actions"), F.array(*map(F.lit, known_actions)))
    claimed = F.map_keys(F.map_filter("actions", lambda _, v: (_text(v) != "") & (v != NONE_OBSERVED)))
    bare = F.array_except(claimed, F.coalesce("supported", F.array().cast("array<string>")))
    ragged = F.exists("tables", lambda t: F.exists(t, lambda row: F.size(row) != F.size(F.get(t, F.lit(0)))))
    row = lambda rule, bad, detail: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    found = F.array(
        row("span_order", F.col("page_end") < F.col("page_start"), F.concat_ws("-", "page_start", "page_end")),
        row("id_parts", F.col("code") != expected, expected),
        row("unknown_action", F.size(unknown) > 0, F.array_join(F.array_sort(unknown), ",")),
        row("unsupported_action", F.size(bare) > 0, F.array_join(F.array_sort(bare), ",")),
        row("ragged_table", ragged, F.lit("")),
    )
    return lessons.select("code", F.inline(F.array_compact(found)))
