"""Job logs, job states and decisions as streams; each equals its batch form once the input has been read.

The keyed streams hold their state in RocksDB (set by keyed_state). Their tables are kept by
BucketTable: a row for each key, only touched buckets rewritten, an epoch that is run again gives
the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from braidmark.operators.logs import line_columns
from braidmark.streaming.buckets import BucketTable, latest_by, summed

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of any kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class StageStates(StatefulProcessor):
    """Per job: the open stage header, items by status, and the lines that a late line may still come before.

    Lines are settled in order of line number once the watermark has passed them: a header opens
    a stage, an item's status counts if it has a higher precedence than the item's last one in
    that stage. Lines not yet settled are counted for the time being on top of that, each time
    new ones come or a timer finds some settled, so a header that comes late moves the items after
    it to its own stage. A line that comes twice counts once while it waits.

    State: the open header; waiting lines (as many as come in the time that lines may be late);
    a status for each stage and item; counts for each stage; the counts last given out.
    """

    def __init__(self, statuses: list[str]):
        self.statuses = statuses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "stage string, line long")
        self.waiting = handle.getListState("waiting", "line long, at long, header string, item string, rank int")
        self.items = handle.getMapState("items", "stage string, item string", "rank int")
        self.counts = handle.getMapState("counts", "stage string", "n array<long>")
        self.shown = handle.getMapState("shown", "stage string", "n array<long>")

    def close(self) -> None:
        pass

    def _zero(self) -> list[int]:
        return [0] * (len(self.statuses) + 1)

    def _settled(self, stage: str) -> list[int]:
        return list(self.counts.getValue((stage,))[0]) if self.any_settled and self.counts.containsKey((stage,)) else self._zero()

    def _moved(self, counts: dict[str, list[int]], stage: str, old: int | None, new: int) -> None:
        """One item of a stage from a status (none: not seen) to another; the last place counts those without one."""
        n = counts.get(stage)
        if n is None:
            n = counts[stage] = self._settled(stage)
        if old is None:
            n[-1] += 1
        elif old < len(self.statuses):
            n[old] -= 1
        if new < len(self.statuses):
            n[new] += 1

    def _walk(self, stage: str | None, lines: list[tuple], ranks: dict[tuple, int], counts: dict[str, list[int]]) -> str | None:
        """Lines in order: the stage that is open after them; ranks and counts follow."""
        for _, _, header, item, rank in lines:
            if header is not None:
                stage = header
            if item is None or stage is None:
                continue
            key = (stage, item)
            old = ranks.get(key)
            if old is None and self.any_settled and self.items.containsKey(key):
                old = self.items.getValue(key)[0]
            if old is None or rank < old:
                self._moved(counts, stage, old, rank)
                ranks[key] = rank
        return stage

    def _turn(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        # each question to the store is a message: a job without settled lines has neither items nor counts, one that wasn't seen before has shown nothing
        waited, self.any_settled = self.waiting.exists(), self.open.exists()
        seen = waited or self.any_settled
        lines = {r[0]: r for r in (tuple(x) for x in self.waiting.get())} if waited else {}
        for r in new:
            lines.setdefault(r[0], r)
        ordered = [lines[i] for i in sorted(lines)]
        ready = next((i for i, r in enumerate(ordered) if r[1] >= watermark), len(ordered))
        stage = self.open.get()[0] if self.any_settled else None
        if ready:
            ranks, counts = {}, {}
            stage = self._walk(stage, ordered[:ready], ranks, counts)
            for k, rank in ranks.items():
                self.items.updateValue(k, (rank,))
            for s, n in counts.items():
                self.counts.updateValue((s,), (n,))
            self.open.update((stage, ordered[ready - 1][0]))
            self.any_settled = True
        rest = ordered[ready:]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(r[1] for r in rest) + 1)
        elif waited:
            self.waiting.clear()
        # what is true now, with the lines that wait
        now: dict[str, list[int]] = dict(counts) if ready else {}
        self._walk(stage, rest, {}, now)
        old = {k[0]: list(v[0]) for k, v in self.shown.iterator()} if seen else {}
        out = []
        for s in sorted({*now, *old}):
            n = now.get(s) or self._settled(s)
            if n != old.get(s, self._zero()):
                out.append((key[0], s, n[-1], *n[:-1]))
                self.shown.updateValue((s,), (n,))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "stage", "n_items", *[f"n_{s}" for s in self.statuses]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for df in rows:
            for line, at, header, item, rank in df[["line_no", "at", "header", "item", "rank"]].itertuples(index=False):
                new.append((int(line), int(at), header if isinstance(header, str) else None, item if isinstance(item, str) else None, int(rank)))
        yield from self._turn(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, [], timerValues.getCurrentWatermarkInMs())


def stage_rollup_stream(lines: DataFrame, statuses: list[str], late: str = "1 hour") -> DataFrame:
    """job_id, stage, n_items, n_<status> of each stage whenever they change (update mode); all zero where a late header took the stage's items.

    lines: job_id (long), line_no, ts, text. Lines older than the watermark are left out, so
    `late` bounds both how late a line may be and how many lines wait. Once all input is read, the
    last row of each job and stage is that of stage_rollup over parsed_lines (statuses: by
    precedence).
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, statuses)), F.col("item_status")), F.lit(0)) - 1, F.lit(len(statuses))).cast("int")
    told = line_columns(lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)).filter("header IS NOT NULL OR item IS NOT NULL")
    thin = told.select("job_id", "line_no", "ts", F.unix_millis("ts").alias("at"), "header", "item", rank.alias("rank"))
    out = "job_id long, stage string, n_items long, " + ", ".join(f"n_{s} long" for s in statuses)
    return thin.groupBy("job_id").transformWithStateInPandas(StageStates(statuses), out, "Update", "EventTime")


class JobStates(StatefulProcessor):
    """Per job: when it was created and its last status; what changes is given as counts taken from one day and status and added to another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "created long, day date, last long, status string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.state.get()) if self.state.exists() else None
        created, day, last, status = old or (None, None, None, None)
        for df in rows:
            for at, d, s in df[["at", "day", "status"]].itertuples(index=False):
                at, s = int(at), s if isinstance(s, str) else ""
                if created is None or at < created:
                    created, day = at, d
                if last is None or (at, s) > (last, status):
                    last, status = at, s
        self.state.update((created, day, last, status))
        if old is not None and (old[1], old[3]) == (day, status):
            return
        out = [(day, status, 1)] + ([(old[1], old[3], -1)] if old else [])
        yield pd.DataFrame(out, columns=["day", "status", "n"])


def job_changes(events: DataFrame) -> DataFrame:
    """day, status, n: +1 where a job enters a day and status, -1 where it leaves one. events: job_id, ts, status."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    thin = events.filter("ts IS NOT NULL").select("job_id", at.alias("at"), F.to_date("ts").alias("day"), F.coalesce("status", F.lit("")).alias("status"))
    return thin.groupBy("job_id").transformWithStateInPandas(JobStates(), "day date, status string, n long", "Update", "None")


def jobs_per_day_table(spark: SparkSession, path: str) -> BucketTable:
    """The counts that job_changes adds up to, a row for each day and status."""
    return BucketTable(spark, path, "day date, status string, n long", ["day", "status"], summed)


def jobs_by_day(table: BucketTable, done: str, failed: str) -> DataFrame:
    """day, total, completed, failed, as jobs_per_day over job_states gives them."""
    n = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0)).alias
    return table.read().groupBy("day").agg(F.sum("n").alias("total"), n(done)("completed"), n(failed)("failed")).filter("total > 0")


def decisions_table(spark: SparkSession, path: str, schema: str, keys: list[str], at: str, most_rows: int = 1_000_000) -> BucketTable:
    """The last decision of each item; pending ones stay as tombstones, so that a late older one doesn't come back."""
    return BucketTable(spark, path, schema, keys, latest_by(at), most_rows)


def decided(table: BucketTable, decision: str = "decision") -> DataFrame:
    return table.read().filter(F.col(decision) != "pending")


def stages_table(spark: SparkSession, path: str, statuses: list[str]) -> BucketTable:
    """The last row of each job and stage of stage_rollup_stream; `epoch` says which batch gave it."""
    schema = "job_id long, stage string, n_items long, " + ", ".join(f"n_{s} long" for s in statuses) + ", epoch long"
    return BucketTable(spark, path, schema, ["job_id", "stage"], latest_by("epoch"))


def keep_stages(table: BucketTable):
    """A foreachBatch function for stage_rollup_stream."""
    return lambda batch, epoch: table.fold(batch.withColumn("epoch", F.lit(epoch).cast("bigint")), epoch)


def run_to_end(stream: DataFrame, each, checkpoint: str) -> None:
    """Reads all input there is, in batches, and stops; a later call goes on from the checkpoint."""
    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
