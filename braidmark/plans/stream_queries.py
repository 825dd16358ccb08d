"""Streams over events, read to the end: each table equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidmark.plans.book import Book
from braidmark.plans.work_queries import LINES, log_lines_of
from braidmark.session import checkpoint_dir
from braidmark.streaming import jobs

BOOK = Book()
query = BOOK.query

STATUSES = ["error", "failed", "done", "skip", "ok", "running"]


def events(spark, d):
    """The table as a stream of files."""
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_N = ", ".join(f"count(*) FILTER (k = {i}) AS n_{s}" for i, s in enumerate(STATUSES))


@query(f"""WITH {LINES}, it AS (SELECT job_id, stage, item, coalesce(min(list_position(['error', 'failed', 'done', 'skip', 'ok', 'running'], item_status)), 99) - 1 AS k FROM ps WHERE stage IS NOT NULL AND item IS NOT NULL GROUP BY ALL)
SELECT job_id, stage, count(*) AS n_items, {_N} FROM it GROUP BY ALL""")
def live_stage_rollup(spark, d):
    jobs.keyed_state(spark)
    # a job's lines come in order of number, but their times don't rise with it: lines wait until all are read
    lines = log_lines_of(events(spark, d), F.col("ts"))
    table = jobs.stages_table(spark, folder(spark, "stages"), STATUSES)
    jobs.run_to_end(jobs.stage_rollup_stream(lines, STATUSES, "1000 days"), jobs.keep_stages(table), folder(spark, "stages-read"))
    return table.read().filter("n_items > 0").drop("epoch")


@query("""WITH j AS (SELECT user_id, min(ts)::DATE AS day, max((ts, event_type))[2] AS status FROM events GROUP BY 1)
SELECT day, count(*) AS total, count(*) FILTER (status = 'purchase') AS completed, count(*) FILTER (status = 'error') AS failed FROM j GROUP BY 1""")
def live_jobs_per_day(spark, d):
    jobs.keyed_state(spark)
    rows = events(spark, d).select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("status"))
    table = jobs.jobs_per_day_table(spark, folder(spark, "days"))
    jobs.run_to_end(jobs.job_changes(rows), table.fold, folder(spark, "days-read"))
    return jobs.jobs_by_day(table, "purchase", "error")


@query("""WITH l AS (SELECT user_id AS item, max((event_id, CASE event_type WHEN 'view' THEN 'pending' ELSE event_type END)) AS r FROM events GROUP BY 1) SELECT item, r[1] AS at, r[2] AS decision FROM l WHERE r[2] != 'pending'""")
def live_decisions(spark, d):
    log = events(spark, d).select(F.col("user_id").alias("item"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("decision"))
    table = jobs.decisions_table(spark, folder(spark, "decisions"), log.schema, ["item"], "at")
    jobs.run_to_end(log, table.fold, folder(spark, "decisions-read"))
    return jobs.decided(table)
