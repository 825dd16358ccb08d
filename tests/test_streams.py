"""Streams against their batch forms, restarted and out of order; the bucketed table."""

import random

import pytest
from pyspark.sql import functions as F

from braidmark.operators import logs
from braidmark.operators.rollups import jobs_per_day
from braidmark.sources.tables import read_lines
from braidmark.streaming import jobs
from braidmark.streaming.buckets import BucketTable, latest_by

STATUSES = ["error", "failed", "done", "skip", "ok", "running"]


def log(rng, n_jobs=6, n_lines=60):
    rows = []
    for job in range(n_jobs):
        for i in range(n_lines):
            kind = rng.random()
            text = f"== stage {rng.randrange(4)} ==" if kind < 0.15 else f"[{i}/{n_lines}] L{rng.randrange(5)} {rng.choice(['running', 'done', 'ERROR: bad', 'skip', 'queued', 'ok'])}" if kind < 0.8 else "noise"
            rows.append((job, i, f"2024-03-01 00:{i:02d}:00", text))
    return rows


def batch_rollup(df):
    rows = logs.parsed_lines(df, part_lines=7).filter("item IS NOT NULL AND stage IS NOT NULL")
    return sorted(map(tuple, logs.stage_rollup(rows, "job_id", "stage", "item", "item_status", STATUSES).collect()))


def test_stages_as_lines_arrive_late_and_after_a_restart(spark, tmp_path):
    jobs.keyed_state(spark)
    rng = random.Random(2)
    rows = log(rng)
    # lines come up to ten minutes out of order, in five files, one of them twice
    rows.sort(key=lambda r: int(r[2][14:16]) + rng.randrange(10))
    schema = "job_id long, line_no long, ts string, text string"
    chunk = len(rows) // 5 + 1
    parts = [rows[i : i + chunk] for i in range(0, len(rows), chunk)]
    source = str(tmp_path / "in")
    table = jobs.stages_table(spark, str(tmp_path / "table"), STATUSES)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        jobs.run_to_end(jobs.stage_rollup_stream(stream, STATUSES, "15 minutes"), jobs.keep_stages(table), str(tmp_path / "check"))

    shown = lambda: sorted(tuple(r)[:-1] for r in table.read().filter("n_items > 0").collect())
    for stop in (2, 5):  # stopped after two files, started again from the checkpoint
        for i, part in enumerate(parts[:stop]):
            if not (tmp_path / f"done{i}").exists():
                (tmp_path / f"done{i}").touch()
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
                run()
        assert shown() == batch_rollup(spark.createDataFrame([r for p in parts[:stop] for r in p], schema))
    spark.createDataFrame(parts[-1], schema).coalesce(1).write.mode("append").json(source)
    run()
    assert shown() == batch_rollup(spark.createDataFrame(rows, schema))


def test_jobs_by_day_with_retractions(spark, tmp_path):
    jobs.keyed_state(spark)
    rng = random.Random(4)
    rows = [(rng.randrange(12), f"2024-03-0{rng.randrange(1, 4)} 0{rng.randrange(9)}:00:00", rng.choice(["running", "done", "failed", None])) for _ in range(150)] + [(3, None, "done")]
    schema = "job_id long, ts string, status string"
    table = jobs.jobs_per_day_table(spark, str(tmp_path / "days"))
    for i in range(3):
        spark.createDataFrame(rows[i * 51 : (i + 1) * 51], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.run_to_end(jobs.job_changes(stream), table.fold, str(tmp_path / "check"))
        so_far = logs.job_states(spark.createDataFrame(rows[: (i + 1) * 51], schema))
        want = jobs_per_day(so_far, "created", "status", "done", "failed")
        assert sorted(map(tuple, jobs.jobs_by_day(table, "done", "failed").collect())) == sorted(map(tuple, want.collect()))


def test_bucket_table_writes_no_more_as_it_grows(spark, tmp_path):
    schema = "item long, at long, decision string"
    table = jobs.decisions_table(spark, str(tmp_path / "t"), schema, ["item"], "at", most_rows=400)
    row = lambda a, b, at, d: spark.range(a, b).select(F.col("id").alias("item"), F.lit(at).cast("bigint").alias("at"), F.lit(d).alias("decision"))
    sizes, top = [], 400
    for epoch in range(8):
        if epoch % 2 == 0:  # the table grows
            table.fold(row(0 if epoch == 0 else top // 4, top, epoch, "accepted"), epoch)
            top *= 4 if epoch < 6 else 1
        else:  # a small batch
            table.fold(row(0, 3, epoch, "rejected"), epoch)
            sizes.append(table.bytes_written)
    n = table.read().count()
    assert n == 25600 and max(sizes) < 3 * sizes[0]  # three keys, each in a bucket of bounded size, while the table grows 64-fold
    assert max(r[3] for r in table._manifest(7)) <= 600 and len(table._epochs()) == 2
    # a batch that is run again gives the same, also after one that stopped before its manifest
    before = sorted(map(tuple, table.read().collect()))
    table.fold(row(0, 3, 7, "rejected"), 7)
    assert sorted(map(tuple, table.read().collect())) == before
    (lambda d: d.mkdir(parents=True))(tmp_path / "t" / "data" / "8" / "bucket=0-0")
    table.fold(row(1, 2, 8, "pending").unionByName(row(2, 3, 1, "old")), 8)
    got = {r.item: r.decision for r in jobs.decided(table).filter("item < 4").collect()}
    assert got == {0: "rejected", 2: "rejected", 3: "accepted"}
    table.fold(row(1, 2, 3, "late and older"), 9)
    assert jobs.decided(table).filter("item = 1").isEmpty()
    table.fold(row(0, 0, 1, ""), 10)  # an empty batch
    assert table.read().count() == n


def test_sums_fold_once_per_epoch(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], jobs.summed)
    assert table.read().isEmpty()
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    for epoch in (0, 1, 1):
        table.fold(one, epoch)
    assert sorted(map(tuple, table.read().collect())) == [("a", 8), ("b", 4)]
    assert latest_by("n")(one, ["k"]).count() == 2


@pytest.mark.parametrize("split", ["128m", "300"])
def test_lines_are_numbered_over_splits(spark, tmp_path, split):
    rng = random.Random(1)
    want = []
    for name in ("a", "b", "empty"):
        text = [rng.choice(["== stage 1 ==", "== other ==", "", "[1/2] x done", "long " * 30]) for _ in range(0 if name == "empty" else 400)]
        (tmp_path / f"{name}.log").write_text("".join(x + rng.choice(["\n", "\r\n"]) for x in text))
        want += [(name, i + 1, x) for i, x in enumerate(text)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = read_lines(spark, str(tmp_path / "*.log"))
        assert sorted(map(tuple, lines.collect())) == sorted(want)
        got = {(r.job_id, r.line_no): r.stage for r in logs.parsed_lines(lines, part_lines=37).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    stage = {}
    for job, i, x in sorted(want):
        if x.startswith("=="):
            stage[job] = x.strip("= ")
        assert got[job, i] == stage.get(job)


class Store:
    """States in memory that count what is asked of them; items and counts have only what was settled."""

    def __init__(self):
        self.asked, self.held = {}, {}

    def __getattr__(self, name):
        return (lambda kind, *_: State(self, kind)) if name.startswith("get") else lambda *_: None


class State:
    def __init__(self, store, kind):
        self.store, self.kind, self.d = store, kind, store.held.setdefault(kind, {})

    def _ask(self):
        self.store.asked[self.kind] = self.store.asked.get(self.kind, 0) + 1

    def exists(self):
        self._ask()
        return bool(self.d)

    def containsKey(self, k):
        self._ask()
        return k in self.d

    get = lambda self: self.d[None]
    put = update = lambda self, v: self.d.__setitem__(None, v)
    clear = lambda self: self.d.clear()
    getValue = lambda self, k: self.d[k]
    updateValue = lambda self, k, v: self.d.__setitem__(k, v)

    def iterator(self):
        self._ask()
        return iter(list(self.d.items()))


def test_a_new_job_asks_the_store_no_question_for_each_line():
    store, states = Store(), jobs.StageStates(["failed", "done", "ok"])
    states.init(store)
    lines = [(0, 0, "s", None, 3)] + [(i, i, None, f"i{i % 50}", 1 + i % 2) for i in range(1, 101)]
    turn = lambda new, mark: [tuple(r) for df in states._turn((1,), new, mark) for r in df.itertuples(index=False)]
    assert turn(lines, 0) == [(1, "s", 50, 0, 25, 25)]
    assert not {"items", "counts", "shown"} & set(store.asked) and sum(store.asked.values()) == 2
    assert turn([], 1000) == []  # settled: nothing new to show
    assert turn([(200, 1001, None, "i1", 0), (201, 1002, None, "new", 0)], 1000) == [(1, "s", 51, 2, 25, 24)]
    assert turn([], 2000) == [] and store.held["items"]["s", "i1"] == (0,) and list(store.held["counts"]["s",][0]) == [2, 25, 24, 51]
