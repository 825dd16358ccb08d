"""Views over entities, documents, verdicts and decisions: listings, queues, details, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STATUSES = ("full", "partial", "none")


def _full(c: Column) -> Column:
    """Null where the text is blank."""
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def _has(c: str, q: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q.lower()))


def alignment_rows(verdicts: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdicts with the entity's title, the document's text where their own is blank, a known status, and an id of entity, document and place.

    verdicts: entity_id, doc_id, i, status, raw_text, ...; entities: entity_id, title; documents: doc_id, text.
    """
    met = verdicts.join(entities.select("entity_id", F.col("title").alias("__t")), "entity_id", "left").join(documents.select("doc_id", F.col("text").alias("__x")), "doc_id", "left")
    key = F.concat_ws(":", F.col("entity_id").cast("string"), F.col("doc_id").cast("string"), F.col("i").cast("string"))
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("none")
    return met.withColumns(
        {"id": key, "title": F.coalesce(_full(F.col("__t")), F.col("entity_id").cast("string")), "doc_text": F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), "__x", F.lit("")), "status": known}
    ).drop("__t", "__x", "raw_text")


def listing(rows: DataFrame, status: str | None = None, entity: object = None, needs_review: bool | None = None, q: str | None = None) -> DataFrame:
    """Rows that meet all filters given; q is looked for, in any case, in ids, evidence, title and text."""
    out = rows
    if status is not None:
        out = out.filter(F.col("status") == status)
    if entity is not None:
        out = out.filter(F.col("entity_id") == entity)
    if needs_review is not None:
        out = out.filter(F.coalesce("needs_review", F.lit(False)) == needs_review)
    if q:
        hit = F.lit(False)
        for c in ("entity_id", "doc_id", "evidence", "title", "doc_text"):
            hit = hit | _has(c, q)
        out = out.filter(hit)
    return out


def page_of_rows(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in order, with the total before paging in each."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def evidence_listing(rows: DataFrame, q: str | None = None) -> DataFrame:
    """Rows with evidence that are positive or flagged; q is looked for in evidence and document."""
    out = rows.filter(_full(F.col("evidence")).isNotNull() & ((F.col("status") != "none") | F.coalesce("needs_review", F.lit(False))))
    return out.filter(_has("evidence", q) | _has("doc_id", q)) if q else out


def review_queue(rows: DataFrame) -> DataFrame:
    """Flagged rows; a reason for each."""
    return rows.filter("needs_review").withColumn("review_reason", F.coalesce(F.nullif(F.col("review_reason"), F.lit("")), F.lit("Flagged for review")))


def search(entities: DataFrame, documents: DataFrame, rows: DataFrame, q: str, limit: int) -> DataFrame:
    """category, label: hits among entities, then documents (the first 120 characters of their text), then evidence, at most limit."""
    e = entities.filter(_has("entity_id", q) | _has("title", q)).select(F.lit(1).alias("o"), F.lit("Lessons").alias("category"), F.concat_ws(" — ", F.col("entity_id").cast("string"), "title").alias("label"))
    d = documents.filter(_has("doc_id", q) | F.contains(F.substring(F.lower("text"), 1, 120), F.lit(q.lower()))).select(F.lit(2).alias("o"), F.lit("Standards").alias("category"), F.col("doc_id").cast("string").alias("label"))
    v = rows.filter(_has("evidence", q)).select(F.lit(3).alias("o"), F.lit("Evidence").alias("category"), F.concat_ws(" · ", F.col("entity_id").cast("string"), F.col("doc_id").cast("string")).alias("label"))
    return e.unionByName(d).unionByName(v).orderBy("o", "label").limit(limit).drop("o")


def status_counts(rows: DataFrame, by: str) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.groupBy(by).agg(*[n(F.col("status") == s, s) for s in STATUSES], n(F.col("needs_review"), "review"))


def entity_details(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Every entity with its counts by status and review (0 without verdicts), and aligned."""
    met = entities.join(status_counts(rows, "entity_id"), "entity_id", "left").fillna(0, [*STATUSES, "review"])
    return met.withColumn("aligned", F.col("full") + F.col("partial"))


def document_coverage(documents: DataFrame, rows: DataFrame, dropped: tuple[str, ...] = ("domain", "big_idea")) -> DataFrame:
    """Documents of levels that can be covered: counts, entities in order, and covered, partial, review or not_found. Unflagged none rows don't count."""
    used = rows.filter((F.col("status") != "none") | F.coalesce("needs_review", F.lit(False)))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counts = used.groupBy("doc_id").agg(n(F.col("status") == "full", "full"), n(F.col("status") == "partial", "partial"), n(F.col("needs_review"), "review"), F.array_sort(F.collect_set(F.when(F.col("status") != "none", F.col("entity_id")))).alias("entities"))
    met = documents.filter(~F.col("level").isin(*dropped)).join(counts, "doc_id", "left").fillna(0, ["full", "partial", "review"])
    none = F.array().cast(counts.schema["entities"].dataType)
    state = F.when(F.col("full") > 0, "covered").when(F.col("partial") > 0, "partial").when(F.col("review") > 0, "review").otherwise("not_found")
    return met.withColumns({"entities": F.coalesce("entities", none), "coverage": state})


def leaf_count(documents: DataFrame, leaf: str = "substandard") -> DataFrame:
    """One row: documents, and leaves: rows of the leaf level or, without any, rows that are nobody's parent."""
    parents = documents.select(F.col("parent").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("__p", F.lit(True))
    met = documents.join(parents, "doc_id", "left")
    counts = met.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("level") == leaf, 1)).alias("__a"), F.count(F.when(F.col("__p").isNull(), 1)).alias("__b"))
    return counts.select("documents", F.when(F.col("__a") > 0, F.col("__a")).otherwise(F.col("__b")).alias("leaves"))


def overview(rows: DataFrame, documents: DataFrame, entities: DataFrame, expected: int | None = None) -> DataFrame:
    """One row: counts by status, review, escalated, grounded, distinct cited documents, coverage of all leaves, rates, readiness and health."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    s = F.col("status")
    one = rows.agg(F.count(F.lit(1)).alias("alignments"), *[n(s == x, x) for x in STATUSES], n(F.col("needs_review"), "review"), n(F.col("escalated"), "escalated"), n(F.col("grounded"), "grounded"), F.count_distinct(F.when(s != "none", F.col("doc_id"))).alias("cited"))
    met = one.join(F.broadcast(leaf_count(documents))).join(F.broadcast(entities.agg(F.count(F.lit(1)).alias("entities"))))  # one row each
    rate = lambda c, digits: F.coalesce(F.bround(F.try_divide(100 * F.col(c), F.col("alignments")), digits), F.lit(0.0))
    whole = F.lit(True) if expected is None else F.col("entities") == expected
    return met.withColumns(
        {
            "coverage_pct": F.coalesce(F.bround(F.try_divide(100 * F.col("cited"), F.col("leaves")), 1), F.lit(0.0)),
            "review_rate": rate("review", 2),
            "escalation_rate": rate("escalated", 2),
            "readiness": F.when(F.col("alignments") > 0, "ready").when(F.col("entities") + F.col("documents") > 0, "running").otherwise("empty"),
            "health": F.when((F.col("alignments") > 0) & whole, "Healthy").when(F.col("alignments") > 0, "Degraded").otherwise("Empty"),
        }
    )


def with_payload(hits: DataFrame, payload: DataFrame, documents: DataFrame, fields: list[str], kept: list[str] = ("grade",)) -> DataFrame:
    """Hits with fields from the index's payload where they aren't blank, else from the document; `kept` fields are the payload's whenever it has the row."""
    p = payload.select("doc_id", F.lit(True).alias("__have"), *[F.col(c).alias(f"__p_{c}") for c in [*fields, *kept]])
    d = documents.select("doc_id", *[F.col(c).alias(f"__d_{c}") for c in [*fields, *kept]])
    met = hits.join(p, "doc_id", "left").join(d, "doc_id", "left")
    own = {c: F.coalesce(_full(F.col(f"__p_{c}")), F.col(f"__d_{c}"), F.lit("")) for c in fields}
    own |= {c: F.when(F.col("__have"), F.col(f"__p_{c}")).otherwise(F.col(f"__d_{c}")) for c in kept}
    return met.withColumns(own).drop("__have", *[f"__{x}_{c}" for x in "pd" for c in [*fields, *kept]])


def leaf_coverage(leaves: DataFrame, coverage: DataFrame, labels: DataFrame) -> DataFrame:
    """Leaves with their coverage (not_found without a row) and their ancestors' domain and group labels.

    leaves: doc_id, domain, group; labels: doc_id, label.
    """
    named = lambda c: labels.select(F.col("doc_id").alias(c), F.col("label").alias(f"{c}_label"))
    met = leaves.join(coverage.select("doc_id", "coverage"), "doc_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit("not_found")))
    return met.join(named("domain"), "domain", "left").join(named("group"), "group", "left")


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """met, partial and gap of a leaf set and their shares in whole per cent: met and gap rounded half up, partial the rest, a negative rest taken off the greater."""
    n = lambda v, name: F.count(F.when(F.col(value) == v, 1)).alias(name)
    out = df.groupBy(*by).agg(n("full", "met"), n("partial", "partial"), n("none", "gap")).withColumn("total", F.col("met") + F.col("partial") + F.col("gap"))
    pct = lambda c: F.coalesce(F.round(F.try_divide(100 * F.col(c), F.col("total"))).cast("int"), F.lit(0))
    out = out.withColumns({"met_pct": pct("met"), "gap_pct": pct("gap")})
    over = F.greatest(F.lit(0), F.col("met_pct") + F.col("gap_pct") - 100)
    more = F.col("met_pct") >= F.col("gap_pct")
    out = out.withColumns({"met_pct": F.when(more, F.col("met_pct") - over).otherwise(F.col("met_pct")), "gap_pct": F.when(more, F.col("gap_pct")).otherwise(F.col("gap_pct") - over)})
    return out.withColumn("partial_pct", F.when(F.col("total") > 0, 100 - F.col("met_pct") - F.col("gap_pct")).otherwise(0))


def national(cells: DataFrame, by: str, value: str) -> DataFrame:
    """One row: the mean of the groups' values, and how many are at 90 and more or below 75."""
    return cells.select(by, value).agg(F.bround(F.avg(value), 6).alias("average"), F.count_if(F.col(value) >= 90).alias("high"), F.count_if(F.col(value) < 75).alias("low"))


def with_decisions(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their decision; pending where there is none."""
    return rows.join(decisions.select(*keys, "decision"), keys, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def pair_view(rows: DataFrame) -> DataFrame:
    """Per entity and document: the strongest status, its pages in order, and how many rows are full."""
    strength = F.when(F.col("status") == "full", 2).when(F.col("status") == "partial", 1).otherwise(0)
    return rows.groupBy("entity_id", "doc_id").agg(F.max_by("status", strength).alias("status"), F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"), F.count_if(F.col("status") == "full").alias("n_full"))


def latest_ready(projects: DataFrame, columns: list[str]) -> DataFrame:
    """The ready project of the latest review, counts only."""
    return projects.filter("readiness = 'ready'").agg(F.max_by(F.struct(*columns), F.struct("last_reviewed", "project_id")).alias("r")).select("r.*").filter(F.col(columns[0]).isNotNull())


def natural_order(df: DataFrame, code: str) -> DataFrame:
    """Adds unit and lesson numbers parsed from codes like G1M2U3L4, and place: the row's place by unit, lesson, code."""
    number = lambda x: F.regexp_extract(code, f"(?i){x}(\\d+)", 1).try_cast("int")
    parsed = df.withColumns({"module": number("M"), "unit": number("U"), "lesson": number("L")})
    return parsed.withColumn("place", F.row_number().over(W.partitionBy("module").orderBy(F.asc_nulls_last("unit"), F.asc_nulls_last("lesson"), code)))
