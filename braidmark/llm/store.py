"""Tables written to the shared folder, so that later steps don't recompute them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from braidmark.session import checkpoint_dir

BATCH_BYTES = 2 << 20
_UNBOUNDED = 1 << 28


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that long texts don't fill a task's memory; a smaller limit of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(_UNBOUNDED))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the folder in spark.checkpoint.dir and reads it back.

    Cuts the lineage; a lost executor costs nothing that was written.
    """
    bound_batches(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes settled tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
