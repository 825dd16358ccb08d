"""Structured Streaming forms of the log and decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.operators.rollups import latest_decisions


def typed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are left out."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return stamped.groupBy(F.window("__ts", window), F.col(kind)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def stage_status(lines: DataFrame, ts: str, text: str, late: str = "1 day") -> DataFrame:
    """Per stage of the lines' own "stage=<name>" and hour: how many lines say error, done, or something else."""
    stage = F.regexp_extract(text, r"stage=(\S+)", 1)
    said = F.when(F.lower(text).rlike(r"\berror\b"), "error").when(F.lower(text).rlike(r"\bdone\b"), "done").otherwise("other")
    stamped = lines.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).withColumns({"stage": stage, "status": said})
    return stamped.groupBy(F.window("__ts", "1 hour"), "stage").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("error", "done", "other")]).select(F.col("window.start").alias("start"), "stage", "n_error", "n_done", "n_other")


def keep_latest(keys: list[str], at: str, decision: str, path: str):
    """A foreachBatch function that folds each batch into the table of latest decisions at path.<epoch>.

    A batch's result depends on the last one's only, so a batch that is run again gives the same;
    tables older than that are deleted. The table has one row an item, so a batch costs its own rows
    and the number of items.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, at, decision)
        if epoch > 0:
            rows = spark.read.parquet(f"{path}.{epoch - 1}").unionByName(rows)
        last = rows.groupBy(*keys).agg(F.max_by(decision, at).alias(decision), F.max(at).alias(at))
        last.select(*keys, at, decision).write.mode("overwrite").parquet(f"{path}.{epoch}")
        if epoch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{epoch - 2}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return fold


def current(df: DataFrame, keys: list[str], at: str, decision: str) -> DataFrame:
    return latest_decisions(df, keys, at, decision)
