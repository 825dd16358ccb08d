"""Job logs: line types, stages, roll-ups and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def line_type(line: Column, rules: list[tuple[str, str]], default: str = "info") -> Column:
    """The first rule (name, pattern) that matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def stage_rollup(rows: DataFrame, job: str, stage: str, item: str, status: str, order: list[str]) -> DataFrame:
    """Per job and stage: items by their status of highest precedence (the first in order); a status that isn't in order never counts."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    items = rows.groupBy(job, stage, item).agg(F.min_by(status, rank).alias(status))
    n = [F.count(F.when(F.col(status) == s, 1)).alias(f"n_{s}") for s in order]
    return items.groupBy(job, stage).agg(F.count(F.lit(1)).alias("n_items"), *n)


def job_states(events: DataFrame) -> DataFrame:
    """job_id, created, status: each job's first time and last status (ties to the greatest); events: job_id, ts, status. Events without a time are left out."""
    at = F.col("ts").cast("timestamp")
    status = F.coalesce("status", F.lit(""))
    return events.filter("ts IS NOT NULL").groupBy("job_id").agg(F.min(at).alias("created"), F.max(F.struct(at.alias("at"), status.alias("status"))).alias("last")).select("job_id", "created", "last.status")


def usage_cost(usage: DataFrame, rates: list[tuple[str, float, float]], model: str) -> DataFrame:
    """Cost by model and in total (null model): rates are (pattern, price per million in, out), the first match counts."""
    price_in, price_out = F.lit(0.0), F.lit(0.0)
    for pattern, i, o in reversed(rates):
        hit = F.col(model).rlike(pattern)
        price_in, price_out = F.when(hit, i).otherwise(price_in), F.when(hit, o).otherwise(price_out)
    priced = usage.withColumn("__c", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)
    return priced.rollup(model).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.bround(F.sum("__c"), 6).alias("cost"))


def stages_done(entities: DataFrame, artifacts: DataFrame, entity: str, stage: str, order: list[str]) -> DataFrame:
    """A stage is done if every entity has its artifact and all stages before are done."""
    every = entities.select(entity, F.posexplode(F.array(*map(F.lit, order))).alias("at", stage))
    have = artifacts.select(entity, stage).distinct().withColumn("__have", F.lit(True))
    own = every.join(have, [entity, stage], "left").groupBy("at", stage).agg(F.every(F.coalesce("__have", F.lit(False))).alias("complete"), F.count("__have").alias("n_done"))
    # one row per stage of a fixed list
    return own.withColumn("done", F.every("complete").over(W.orderBy("at"))).drop("at")


def line_columns(lines: DataFrame) -> DataFrame:
    """lines (with text) and what each says: header ("== name =="), cost and estimate, item progress (i of n), item and its status."""
    get = lambda pattern, i=1: F.nullif(F.regexp_extract("text", pattern, i), F.lit(""))
    return lines.withColumns(
        {
            "header": get(r"^=+\s*(.+?)\s*=+\s*$"),
            "machine_cost": get(r"(?i)\bcost_usd=([0-9.]+)").try_cast("double"),
            "estimated_cost": get(r"(?i)\best(?:imated)? cost:?\s*\$?([0-9.]+)").try_cast("double"),
            "done": get(r"\[(\d+)/(\d+)\]").try_cast("int"),
            "total": get(r"\[(\d+)/(\d+)\]", 2).try_cast("int"),
            "item": get(r"\[\d+/\d+\]\s+(\S+)"),
            "item_status": F.lower(get(r"(?i)\b(error|failed|skip|done|ok|running)\b")),
        }
    )


def parsed_lines(lines: DataFrame, part_lines: int = 100_000) -> DataFrame:
    """job_id, line_no, text with what a line says (see line_columns) and the stage: the last header so far, carried over parts of part_lines line numbers."""
    return carried(line_columns(lines), "job_id", "line_no", "header", "stage", part_lines)


def carried(rows: DataFrame, by: str, order: str, value: str, out: str, part: int = 100_000) -> DataFrame:
    """The last value that isn't null up to each row, as out, for groups of any length.

    A group is cut into parts by its (whole-number) order. Each part's last value is carried over
    to the next parts on a table of a row for each part, and only the rows before a part's first
    value take it from there, so no task holds more than a part. Null groups and orders are groups
    and places of their own (order: first).
    """
    cut = rows.withColumn("__part", F.floor(F.col(order) / F.lit(part)).cast("bigint"))
    inside = cut.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(by, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    # a row for each part, with what stands before it
    parts = cut.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__p")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.coalesce(order, F.lit(-(2**63))))).alias("__last"))
    before = parts.withColumn("__before", F.last("__last", ignorenulls=True).over(W.partitionBy("__by").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).filter("__before IS NOT NULL").drop("__last")
    met = inside.join(before, F.col(by).eqNullSafe(F.col("__by")) & F.col("__part").eqNullSafe(F.col("__p")), "left")
    return met.withColumn(out, F.coalesce(out, "__before")).select(*rows.columns, out)


def stage_costs(parsed: DataFrame, usage: DataFrame) -> DataFrame:
    """job_id, stage, cost: the sum of a stage's machine costs, else its last estimate, else its artifacts' usage; and the job's total (null stage).

    usage: job_id, stage, cost.
    """
    own = parsed.filter("stage IS NOT NULL").groupBy("job_id", "stage").agg(F.sum("machine_cost").alias("__m"), F.max_by("estimated_cost", F.when(F.col("estimated_cost").isNotNull(), F.col("line_no"))).alias("__e"))
    used = usage.groupBy("job_id", "stage").agg(F.sum("cost").alias("__u"))
    met = own.join(used, ["job_id", "stage"], "left").withColumn("cost", F.coalesce("__m", "__e", "__u", F.lit(0.0)))
    return met.rollup("job_id", "stage").agg(F.bround(F.sum("cost"), 6).alias("cost")).filter("job_id IS NOT NULL")


def failure_digest(parsed: DataFrame, errors: DataFrame, hints: list[tuple[str, str]]) -> DataFrame:
    """job_id, failed, total, common_error, last_error_line, hint of each job with failures.

    errors: job_id, entity_id, error (null: no failure). hints: (pattern, hint), the first that matches counts.
    """
    bad = errors.filter("error IS NOT NULL").groupBy("job_id", "error").agg(F.count(F.lit(1)).alias("n"))
    common = bad.groupBy("job_id").agg(F.max_by("error", F.struct("n", "error")).alias("common_error"))
    per = errors.groupBy("job_id").agg(F.count_distinct(F.when(F.col("error").isNotNull(), F.col("entity_id"))).alias("failed"), F.count_distinct("entity_id").alias("total"))
    last = parsed.filter(F.col("item_status").isin("error", "failed")).groupBy("job_id").agg(F.max_by("text", "line_no").alias("last_error_line"))
    hint = F.lit(None).cast("string")
    for pattern, said in reversed(hints):
        hint = F.when(F.concat_ws("\n", "common_error", "last_error_line").rlike(pattern), said).otherwise(hint)
    return per.filter("failed > 0").join(common, "job_id", "left").join(last, "job_id", "left").withColumn("hint", hint)


def cached_usage_cost(usage: DataFrame, rates: list[tuple[str, float, float]], model: str, read: float = 0.1, write: float = 1.25) -> DataFrame:
    """usage_cost with cache tokens: those read cost `read`, those written `write` times the input price."""
    weighed = usage.withColumn("tokens_in", F.col("tokens_in") + read * F.col("cache_read") + write * F.col("cache_write"))
    return usage_cost(weighed, rates, model)


def file_states(files: DataFrame, version: str) -> DataFrame:
    """state (kept, stale, unreadable), n, bytes of cache files: path, length, found_version (null: can't be read)."""
    state = F.when(F.col("found_version").isNull(), "unreadable").when(F.col("found_version") == version, "kept").otherwise("stale")
    return files.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def cache_files(spark, path: str, pattern: str = r'"version"\s*:\s*"([^"]*)"') -> DataFrame:
    """path, length, found_version of the files under a folder."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("found_version"))


def is_fresh(files: DataFrame, slack: str = "1 second") -> DataFrame:
    """One row: the newest report and judge times (files: kind, modified, cut), whether reports aren't older, and whether all cuts agree."""
    newest = lambda k: F.max(F.when(F.col("kind") == k, F.col("modified")))
    one = files.agg(newest("report").alias("report"), newest("judge").alias("judge"), (F.count_distinct("cut") <= 1).alias("cuts_agree"))
    return one.withColumn("fresh", F.coalesce(F.col("report") >= F.col("judge") - F.expr(f"INTERVAL {slack}"), F.lit(False)))


def score_health(candidates: DataFrame) -> DataFrame:
    """entity_id, n, n_dense_rank, n_dense_score, health: empty, ok, logging_artifact (ranks without scores), dense_arm_missing (neither) or unknown.

    candidates: entity_id, doc_id (null: an entity without candidates), dense_rank, dense_score.
    """
    per = candidates.groupBy("entity_id").agg(F.count("doc_id").alias("n"), F.count("dense_rank").alias("n_dense_rank"), F.count("dense_score").alias("n_dense_score"))
    r, s = F.col("n_dense_rank") > 0, F.col("n_dense_score") > 0
    return per.withColumn("health", F.when(F.col("n") == 0, "empty").when(r & s, "ok").when(r, "logging_artifact").when(~s, "dense_arm_missing").otherwise("unknown"))


def health_report(health: DataFrame) -> DataFrame:
    return health.groupBy("health").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entity_id")).alias("entities"))
