"""A keyed table that a stream keeps up to date, rewriting only the buckets that a batch touches.

Rows lie in buckets by the low bits of a hash of their keys. A bucket that grows past most_rows is
split by more bits when it is next rewritten, so a batch writes at most its own keys' buckets of
bounded size, however large the table is. Each epoch writes its buckets to a folder of its own and
then a manifest (a row for each bucket), which makes it visible; a batch that is run again starts
from the manifest before its epoch and gives the same. The last two manifests and what they name
are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, list[str]], DataFrame]
_MANIFEST = "depth int, id long, epoch long, n_rows long"


def latest_by(at: str) -> Merge:
    """Of each key's rows the one of the greatest `at`; ties go to the row that is greatest column by column."""

    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, at)]
        last = F.max(F.struct(at, *rest)).alias("__r")
        return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])

    return merge


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of all other columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest]).select(*rows.columns)


class BucketTable:
    """A table at a path that all executors share; keys: its columns that name a row."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], merge: Merge, most_rows: int = 1_000_000):
        self.spark, self.path, self.keys, self.merge, self.most_rows = spark, path.rstrip("/"), list(keys), merge, most_rows
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.bytes_written = 0  # of the last fold

    # folders
    def _at(self, folder: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _epochs(self) -> list[int]:
        fs, at = self._at("manifest")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def _manifest(self, epoch: int) -> list[tuple]:
        """A row for each bucket: the table's rows over most_rows, so few."""
        return [tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{epoch}").collect()]

    def _folder(self, epoch: int, depth: int, bucket: int) -> str:
        return f"{self.path}/data/{epoch}/bucket={depth}-{bucket}"

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _delete(self, folder: str) -> None:
        fs, at = self._at(folder)
        fs.delete(at, True)

    def fold(self, batch: DataFrame, epoch: int) -> None:
        """Merges a batch (a foreachBatch function); other columns than the table's are ignored."""
        spark, names = self.spark, self.schema.fieldNames()
        before = [e for e in self._epochs() if e < epoch]
        held = self._manifest(before[-1]) if before else [(0, 0, -1, 0)]
        rows = self.merge(batch.select(*names), self.keys).withColumn("__h", self._hash())
        # the bucket of each row: one of the depths in use fits
        entries = spark.createDataFrame(held, _MANIFEST)
        depths = sorted({d for d, *_ in held})
        place = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("__h").bitwiseAND(F.lit((1 << d) - 1)).alias("id")) for d in depths])
        dealt = rows.select("*", F.inline(place)).join(entries.select("depth", "id", F.col("epoch").alias("__e"), F.col("n_rows").alias("__n")), ["depth", "id"]).persist()
        try:
            touched = [tuple(r) for r in dealt.groupBy("depth", "id", "__e", "__n").count().collect()]  # buckets, not rows
            if touched or not before:
                self._rewrite(dealt, touched, held, epoch)
            else:
                self._commit(held, epoch)
        finally:
            dealt.unpersist()
        self._forget(epoch, before)

    def _rewrite(self, dealt: DataFrame, touched: list[tuple], held: list[tuple], epoch: int) -> None:
        spark, names = self.spark, self.schema.fieldNames()
        old = [self._folder(e, d, i) for d, i, e, n, _ in touched if n]
        rows = dealt.select(*names)
        if old:
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(*old).select(*names))
        merged = self.merge(rows, self.keys).withColumn("__h", self._hash())
        # a bucket that may have too many rows is split
        deeper = {(d, i): d + max(0, math.ceil(math.log2(max(1, n + new) / self.most_rows))) for d, i, _, n, new in touched}
        plan = spark.createDataFrame([(d, i, to) for (d, i), to in deeper.items()], "depth int, id long, to int") if deeper else spark.createDataFrame([], "depth int, id long, to int")
        depths = sorted({d for d, _ in deeper})
        place = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("__h").bitwiseAND(F.lit((1 << d) - 1)).alias("id")) for d in depths] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("id"))])
        placed = merged.select("*", F.inline(place)).join(plan, ["depth", "id"])
        bucket = F.concat(F.col("to"), F.lit("-"), F.col("__h").bitwiseAND(F.expr("shiftleft(1L, to) - 1")))
        out = placed.select(*names, bucket.alias("bucket"))
        self._delete(f"data/{epoch}")
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{epoch}")
        written = spark.read.schema(StructType([*self.schema.fields]).add("bucket", "string")).parquet(f"{self.path}/data/{epoch}") if touched else out
        counts = {r.bucket: r["count"] for r in written.groupBy("bucket").count().collect()} if touched else {}
        # all children of a split bucket are named, also those without rows
        fresh = []
        for (d, i), to in deeper.items():
            for k in range(1 << (to - d)):
                child = i + (k << d)
                fresh.append((to, child, epoch, counts.get(f"{to}-{child}", 0)))
        fs, at = self._at(f"data/{epoch}")
        self.bytes_written = fs.getContentSummary(at).getLength() if fs.exists(at) else 0
        self._commit([h for h in held if (h[0], h[1]) not in deeper] + fresh, epoch)

    def _commit(self, entries: list[tuple], epoch: int) -> None:
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{epoch}")

    def _forget(self, epoch: int, before: list[int]) -> None:
        """Deletes what only manifests older than the last two name."""
        kept = {(e, d, i) for m in (epoch, *before[-1:]) for d, i, e, _ in self._manifest(m)}
        for m in before[:-1]:
            for d, i, e, _ in self._manifest(m):
                if (e, d, i) not in kept and e >= 0:
                    self._delete(f"data/{e}/bucket={d}-{i}")
            self._delete(f"manifest/{m}")

    def read(self) -> DataFrame:
        """The table's rows as of the last epoch."""
        epochs = self._epochs()
        folders = [self._folder(e, d, i) for d, i, e, n in self._manifest(epochs[-1]) if n] if epochs else []
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)
