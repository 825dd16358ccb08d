"""Coverage, hierarchy and decision roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _n(c) -> F.Column:
    return F.count(F.when(c, 1))


def entity_coverage(entities: DataFrame, verdicts: DataFrame, entity: str) -> DataFrame:
    """full, partial, none and review counts of every entity, also of those without a verdict."""
    s = F.col("status")
    counts = verdicts.groupBy(entity).agg(_n(s == "full").alias("full"), _n(s == "partial").alias("partial"), _n(s == "none").alias("none"), _n(F.col("needs_review")).alias("review"))
    return entities.select(entity).join(counts, entity, "left").fillna(0, ["full", "partial", "none", "review"])


def document_coverage(documents: DataFrame, verdicts: DataFrame, doc: str, entity: str) -> DataFrame:
    """Counts and coverage of every document: covered, partial, review or not_found, in that order of precedence."""
    s = F.col("status")
    counts = verdicts.groupBy(doc).agg(_n(s == "full").alias("full"), _n(s == "partial").alias("partial"), _n(F.col("needs_review")).alias("review"), F.countDistinct(F.when(s != "none", F.col(entity))).alias("n_entities"))
    out = documents.select(doc).join(counts, doc, "left").fillna(0, ["full", "partial", "review", "n_entities"])
    state = F.when(F.col("full") > 0, "covered").when(F.col("partial") > 0, "partial").when(F.col("review") > 0, "review").otherwise("not_found")
    return out.withColumn("coverage", state)


def overview(verdicts: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """One row: counts by status, review and grounding, distinct cited documents, share of all documents."""
    s = F.col("status")
    one = verdicts.agg(F.count(F.lit(1)).alias("n"), _n(s == "full").alias("full"), _n(s == "partial").alias("partial"), _n(s == "none").alias("none"), _n(F.col("needs_review")).alias("review"), F.countDistinct(F.when(s != "none", F.col(doc))).alias("cited"))
    total = documents.agg(F.count(F.lit(1)).alias("documents"))
    return one.join(F.broadcast(total)).withColumn("coverage_pct", F.bround(F.try_divide(100 * F.col("cited"), F.col("documents")), 1))


def cube(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """met, partial and gap counts at every level of the hierarchy; null marks a total, level says how many dimensions are totals."""
    v = F.col(value)
    out = df.rollup(*dims).agg(_n(v == "full").alias("met"), _n(v == "partial").alias("partial"), _n(v == "none").alias("gap"), F.grouping_id().cast("bigint").alias("level"))
    return out.withColumn("met_pct", F.bround(F.try_divide(100 * F.col("met"), F.col("met") + F.col("partial") + F.col("gap")), 1))


def citations(rows: DataFrame, doc: str, entity: str, page: str, fallback: str) -> DataFrame:
    """Per document: counts, entities, and the pages of rows that have one or a fallback."""
    at = F.coalesce(F.when(F.col(page) > 0, F.col(page)), F.when(F.col(fallback) > 0, F.col(fallback)))
    s = F.col("status")
    cited = rows.filter(s != "none").withColumn("__page", at)
    return cited.groupBy(doc).agg(_n(s == "full").alias("full"), _n(s == "partial").alias("partial"), F.countDistinct(entity).alias("n_entities"), F.sort_array(F.collect_set("__page")).alias("pages"))


def page_runs(df: DataFrame, by: str, page: str) -> DataFrame:
    """Consecutive pages as runs (gaps and islands): by, first, last."""
    own = df.select(by, page).filter(F.col(page).isNotNull()).distinct()
    island = own.withColumn("__i", F.col(page) - F.row_number().over(W.partitionBy(by).orderBy(page)))
    return island.groupBy(by, "__i").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("__i")


def page_list(runs: DataFrame, by: str) -> DataFrame:
    """Runs as text: pp. 74, 84, 91–92."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("–", "first", "last"))
    rows = runs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))).alias("r"))
    return rows.select(by, F.concat(F.lit("pp. "), F.array_join(F.transform("r", lambda x: x["t"]), ", ")).alias("pages"))


def parent_rollup(children: DataFrame, cited: DataFrame, child: str, parent: str, label: str) -> DataFrame:
    """Each parent's skills: supported, partial, missing; and what follows for it."""
    state = F.when(F.col("full") > 0, "supported").when(F.col("partial") > 0, "partial").otherwise("missing")
    met = children.join(cited.select(child, "full", "partial"), child, "left").withColumn("__s", state)
    n = lambda s: _n(F.col("__s") == s).alias(f"n_{s}")
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("__s") == "missing", F.col(label)))), ", ")
    out = met.groupBy(parent).agg(n("supported"), n("partial"), n("missing"), missing.alias("missing_skills"))
    verdict = F.when(F.col("n_supported") + F.col("n_partial") == 0, "beyond_scope").when(F.col("n_partial") + F.col("n_missing") == 0, "fully_met").otherwise("partially_met")
    return out.withColumn("rollup", verdict)


def latest_decisions(log: DataFrame, keys: list[str], at: str, decision: str) -> DataFrame:
    """The last decision of each item; `pending` withdraws it."""
    last = log.groupBy(*keys).agg(F.max_by(decision, at).alias(decision), F.max(at).alias(at))
    return last.filter(F.col(decision) != "pending")


def verification_state(citations_: DataFrame, decisions: DataFrame, by: str, keys: list[str], decision: str) -> DataFrame:
    """Of each set of citations: all accepted, some, flagged, or none."""
    d = F.coalesce(F.col(decision), F.lit("pending"))
    met = citations_.join(decisions, keys, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n"), _n(d == "accepted").alias("accepted"), _n(d == "rejected").alias("rejected"))
    state = F.when(F.col("rejected") > 0, "flagged").when(F.col("accepted") == F.col("n"), "all").when(F.col("accepted") > 0, "some").otherwise("none")
    return met.withColumn("state", state)


def best_and_worst(df: DataFrame, by: str, value: str, n: int = 4) -> DataFrame:
    """The n groups of greatest and of least value. df has one row per group, so each side is a top-n sort, no window over all."""
    best = df.orderBy(F.desc(value), by).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(df.orderBy(value, by).limit(n).withColumn("side", F.lit("worst")))


def jobs_per_day(events: DataFrame, ts: str, status: str, done: str, failed: str) -> DataFrame:
    s = F.col(status)
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("total"), _n(s == done).alias("completed"), _n(s == failed).alias("failed"))
