"""Carried state (steps, interleave), hash trees, zero-norm pairs and per-entity output against plain loops."""

from __future__ import annotations

import os.path

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidmark.operators import crosswalk as cw
from braidmark.operators import incremental as inc
from braidmark.operators import ranking as rk
from braidmark.operators import structure as st
from braidmark.sources import tables as src


def _loop_steps(keys, titles, ahead=3, least=12):
    current, out = -1, []
    for k in keys:
        best = None
        for at in range(current + 1, min(len(titles), current + 1 + ahead)) if k else ():
            shared = len(os.path.commonprefix([k, titles[at]]))
            if titles[at] and (k == titles[at] or shared >= least):
                best = max(best or (False, -1, 0, -1), (k == titles[at], shared, -at, at))
        current = best[3] if best else current
        out.append(current if current >= 0 else None)
    return out


@pytest.mark.parametrize(("part_lines", "fan"), [(256, 64), (4, 2), (1, 3)])
def test_steps_at_any_size_of_part(spark, part_lines, fan):
    words = ["readingaloud", "workinpairs", "readingaloudsun", "readingaloudmoon", "ab", "readingalouds", "", "reflectingonlearning"]
    rng, body, blocks, want = np.random.default_rng(5), [(None, 1, "ab")], [], {None: [None]}
    for d in range(25):
        titles, lines = ([words[i] for i in rng.integers(0, 8, int(rng.integers(low, high)))] for low, high in ((0, 14), (1, 60)))
        body += [(f"d{d}", i, x) for i, x in enumerate(lines)]
        blocks += [(f"d{d}", i, x) for i, x in enumerate(titles)]
        want[f"d{d}"] = _loop_steps(lines, titles)
    body, blocks = spark.createDataFrame(body, "doc string, line_no int, line string"), spark.createDataFrame(blocks, "doc string, block int, title string")
    got = {}
    for r in sorted(st.attached_steps(body, blocks, part_lines=part_lines, fan=fan).collect(), key=lambda r: r.line_no):
        got.setdefault(r.doc, []).append(r.block)
    assert got == want


def test_steps_of_empty_tables(spark):
    body, blocks = spark.createDataFrame([], "doc string, line_no int, line string"), spark.createDataFrame([], "doc string, block int, title string")
    assert st.attached_steps(body, blocks).count() == 0
    one = spark.createDataFrame([("d", 0, None), ("d", 900, "x")], body.schema)
    assert [r.block for r in st.attached_steps(one, blocks).collect()] == [None, None]


@pytest.mark.parametrize("part_rows", [2, 256])
def test_interleave_over_parts(spark, part_rows):
    rng, rows, want = np.random.default_rng(7), [], {}
    for e in range(10):
        families = [None if x == 3 else f"f{x}" for x in rng.choice(4, int(rng.integers(1, 60)), p=[0.7, 0.1, 0.1, 0.1])]
        left, out, last, length = list(enumerate(families)), [], None, 0
        while left:
            at = next((i for i, (_, f) in enumerate(left) if f != last), 0) if length >= 2 else 0
            i, f = left.pop(at)
            length, last = (length + 1 if f == last else 1), f
            out.append(i)
        rows += [(e, i + 1, i, f) for i, f in enumerate(families)]
        want[e] = out
    got = rk.interleave_families(spark.createDataFrame(rows, "entity_id long, rank long, doc_id long, family string"), most_in_row=2, part_rows=part_rows).toPandas()
    assert {e: list(got[got.entity_id == e].sort_values("rank").doc_id) for e in want} == want
    plan = rk.interleave_families(spark.createDataFrame(rows, "entity_id long, rank long, doc_id long, family string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_hash_trees_name_what_changed(spark):
    schema = "id long, h string, model string"
    new = spark.createDataFrame([(i, f"h{i if i % 97 else i + 1}", "en") for i in range(2000)], schema).repartition(5)
    old = spark.createDataFrame([(i, f"h{i}", None if i == 5 else "en") for i in range(5, 2050)], schema)
    rows = lambda df: {tuple(r) for r in df.collect()}
    want = rows(inc.embed_plan(new, old, "id", ["h", "model"]).filter("action != 'skip'"))
    assert rows(inc.changed_keys(new, old, "id", ["h", "model"])) == want and len(want) > 70
    assert rows(inc.changed_keys(new, old, "id", ["h", "model"], levels=1)) == want
    a, b = inc.hash_tree(new, "id", "h"), inc.hash_tree(new.coalesce(1).orderBy(F.desc("id")), "id", "h")
    assert rows(a) == rows(b) and inc.changed_leaves(a, b).count() == 0
    one = inc.hash_tree(new.withColumn("h", F.when(F.col("id") == 77, "x").otherwise(F.col("h"))), "id", "h")
    assert inc.changed_leaves(a, one).count() == 1
    twice = inc.hash_tree(new.unionByName(new.filter("id = 77")), "id", "h")
    assert inc.changed_leaves(a, twice).count() == 1
    none = inc.hash_tree(new.limit(0), "id", "h")
    assert none.count() == 0 and inc.changed_leaves(a, none).count() == a.filter("level = 2").count()


def test_pairs_without_length_score_zero(spark):
    schema = "id long, v array<float>"
    source = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0])], schema)
    target = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, [1.0, 1.0]), (13, []), (14, [-1.0, 0.1])], schema)
    got = {}
    for r in sorted(cw.embedding_crosswalk(source, target, "id", "v", 3).collect(), key=lambda r: r.rank):
        got.setdefault(r.key, []).append((r.target, round(r.score, 3)))
    assert got[1] == [(10, 1.0), (12, 0.707), (11, 0.0)] and got[2] == got[3] == [(10, 0.0), (11, 0.0), (12, 0.0)]
    assert got[4] == [(14, 0.995), (11, 0.0), (13, 0.0)]


def test_output_of_one_entity_leaves_the_others(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "entity_id string, n long"
    src.write_by_entity(spark.createDataFrame([("a", 1), ("b", 2)], schema), path, "entity_id")
    src.write_by_entity(spark.createDataFrame([("b", 3)], schema), path, "entity_id")
    assert {(r.entity_id, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
