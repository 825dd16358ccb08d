"""Small fixtures of the reference's operators, and oracle SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from braidmark.operators import evaluation as ev
from braidmark.operators import hierarchy as hi
from braidmark.operators import ranking as rk
from braidmark.operators import retrieval as rt
from braidmark.operators import rollups as ru
from braidmark.operators import verdicts as vd
from braidmark.plans import registry
from braidmark.sources import tables as src
from braidmark.streaming import live

SF = "/root/testdata/sf0.001"
ARMS = {1: ("ABC", 1.0), 2: ("BDA", 1.5), 3: ("EBF", 0.8)}


@pytest.fixture(scope="module")
def arms(spark):
    rows = [("e", i, d, r, w) for i, (docs, w) in ARMS.items() for r, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "entity_id string, query_index int, doc_id string, rank int, weight double")


@pytest.mark.parametrize(
    ("mode", "arms_n", "blend", "a", "b"),
    [("sum", 3, 0.0, 0.040202966, 0.053622422), ("max", 3, 0.0, 0.023809524, 0.024590164), ("top_k_sum", 2, 0.0, 0.040202966, 0.040719196), ("log_dampened", 3, 0.0, 0.031860097, 0.035748281), ("top_k_sum", 3, 1.0, 0.064012490, 0.078212586)],
)
def test_fusion_modes(arms, mode, arms_n, blend, a, b):
    got = {r.doc_id: r.score for r in rt.fuse_arms(arms, mode, 60, arms_n, 2.0, blend).collect()}
    assert got["A"] == pytest.approx(a, abs=2e-9) and got["B"] == pytest.approx(b, abs=2e-9)


def test_negative_weight_is_an_error(arms):
    with pytest.raises(Exception, match="negative"):
        rt.fuse_arms(arms.withColumn("weight", F.lit(-1.0))).collect()


def test_pool_union(spark):
    one = spark.createDataFrame([("e", d, s) for d, s in (("DEPTH", 0.05), ("KEEP1", 0.04), ("KEEP2", 0.03), ("KEEP3", 0.01), ("BROAD", 0.005))], "entity_id string, doc_id string, score double")
    two = spark.createDataFrame([("e", d, float(9 - i)) for i, d in enumerate(("BROAD", "KEEP1", "DEPTH", "OTHER", "KEEP2"))], "entity_id string, doc_id string, score double")
    rows = rt.pool_membership(one, two, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [("DEPTH", 0.05), ("KEEP1", 0.04), ("KEEP2", 0.03), ("BROAD", 0.005)]


def test_leaves(spark):
    rows = [("d", None, "domain"), ("p", "d", "standard"), ("c1", "p", "substandard"), ("c2", "p", "substandard")]
    df = spark.createDataFrame(rows, "id string, parent string, level string")
    assert sorted(r.id for r in rt.alignable_leaves(df, "id", "parent", "level").collect()) == ["c1", "c2"]


def test_interleave(spark):
    rows = [("e", i + 1, f"d{i}", "fam" if i < 5 else f"f{i}") for i in range(10)]
    out = rk.interleave_families(spark.createDataFrame(rows, "entity_id string, rank long, doc_id string, family string")).orderBy("rank").collect()
    families = [r.family for r in out]
    assert [r.rank for r in out] == list(range(1, 11)) and families[:4] == ["fam", "fam", "fam", "f5"]


def test_rescue(spark):
    fused = spark.createDataFrame([("e", f"f{i}", i) for i in range(1, 51)], "entity_id string, doc_id string, rank int")
    sums = spark.createDataFrame([("e", "f1", 1), ("e", "f2", 2), ("e", "strong", 3), ("e", "weak", 60)], "entity_id string, doc_id string, rank int")
    out = rk.rescue(fused, sums, 50, 1).orderBy("final_rank").collect()
    assert [r.doc_id for r in out[:49]] == [f"f{i}" for i in range(1, 50)] and (out[49].doc_id, out[49].rescued_via) == ("strong", "sum")
    out = rk.rescue(fused, sums, 50, 3).orderBy("final_rank").collect()
    assert [r.doc_id for r in out] == [*(f"f{i}" for i in range(1, 48)), "strong", "f48", "f49"] and out[47].rescued_via == "sum" and out[48].rescued_via is None
    same = rk.rescue(fused, sums.filter("doc_id != 'strong'"), 50, 3).orderBy("final_rank").collect()
    assert [r.doc_id for r in same] == [f"f{i}" for i in range(1, 51)]
    short = fused.filter("rank <= 20").unionByName(fused.limit(0))
    out = rk.rescue(short, sums, 25, 3).orderBy("final_rank").collect()  # then other documents of the sum ranking
    assert [r.doc_id for r in out[-2:]] == ["strong", "weak"] and len(out) == 22
    with pytest.raises(ValueError, match="slots"):
        rk.rescue(fused, sums, 50, 50)


def _loop_interleave(families, cap):
    left, out, last, length = list(enumerate(families)), [], None, 0
    while left:
        at = next((i for i, (_, f) in enumerate(left) if f != last), 0) if length >= cap else 0
        i, f = left.pop(at)
        length, last = (length + 1 if f == last else 1), f
        out.append(i)
    return out


def test_interleave_matches_a_loop(spark):
    rng, rows, want = np.random.default_rng(11), [], {}
    for e in range(12):
        families = [None if x == 3 else f"f{x}" for x in rng.choice(4, int(rng.integers(1, 40)), p=[0.6, 0.2, 0.1, 0.1])]
        rows += [(f"e{e}", i + 1, f"d{i}", f) for i, f in enumerate(families)]
        want[f"e{e}"] = [f"d{i}" for i in _loop_interleave(families, 3)]
    rows += [("long", i + 1, f"d{i}", "f" if i < 3000 else "g") for i in range(3100)]
    out = rk.interleave_families(spark.createDataFrame(rows, "entity_id string, rank long, doc_id string, family string")).toPandas()
    for e, docs in want.items():
        assert list(out[out.entity_id == e].sort_values("rank").doc_id) == docs
    assert (out.entity_id == "long").sum() == 3100


def test_ancestors_of_deep_trees_and_cycles(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", None), ("a", "b"), ("b", "c"), ("c", "b"), ("s", "s"), ("o", "gone")]
    got = {(r.node, r.ancestor, r.distance) for r in hi.ancestors(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    want = {(f"n{i}", f"n{j}", j - i) for i in range(21) for j in range(i + 1, 21)} | {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("c", "b", 1)}
    assert got == want


def test_unknown_statuses_never_win(spark):
    df = spark.createDataFrame([("a", "odd"), ("a", "full"), ("a", "none"), ("b", "odd")], "k string, s string")
    assert {(r.k, r.s) for r in ev.strongest(df, ["k"], "s", ["full", "partial", "none"]).collect()} == {("a", "full"), ("b", None)}


def test_scaling_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("e", 2.0)], "entity_id string, x double")
    assert sorted((str(r.entity_id), r.scaled) for r in rk.robust_minmax(df, ["entity_id"], "x").collect()) == [("None", 0.0), ("None", 1.0), ("e", 0.5)]


def _loop_preserve(rows, top_n, preserve):
    best = lambda r: (-r["blended_score"], -r["rerank_score"], r["doc_id"])
    order = sorted(rows, key=best)
    chosen = order[:top_n]
    head = sorted((r for r in rows if r["rrf_rank"] <= preserve), key=lambda r: r["rrf_rank"])
    missing = [r for r in head if r not in chosen]
    spare = sorted((r for r in chosen if r not in head), key=lambda r: (r["blended_score"], order.index(r)))
    for new, old in zip(missing, spare):
        chosen.remove(old)
        chosen.append(new)
    return [r["doc_id"] for r in sorted(chosen, key=best)]


def test_preserved_heads_match_a_loop(spark):
    rng, rows = np.random.default_rng(3), []
    for e in range(20):
        n = int(rng.integers(1, 12))
        for i, r in enumerate(rng.permutation(n)):
            rows.append({"entity_id": f"e{e}", "doc_id": f"d{i}", "rrf_rank": int(r) + 1, "rerank_score": float(rng.integers(0, 4)), "blended_score": float(rng.integers(0, 4))})
    out = rk.preserve_heads(spark.createDataFrame(pd.DataFrame(rows)), 5, 3).toPandas()
    for e in {r["entity_id"] for r in rows}:
        want = _loop_preserve([r for r in rows if r["entity_id"] == e], 5, 3)
        assert list(out[out.entity_id == e].sort_values("rerank_rank").doc_id) == want


def test_shortlist_keeps_what_it_must(spark):
    rows = [("e", f"d{i}", i, 51 - i, i if i % 2 else None, i if i % 2 else None) for i in range(1, 51)]
    df = spark.createDataFrame(rows, "entity_id string, doc_id string, rrf_rank int, ce_rank int, dense_rank int, bm25_rank int")
    out = rk.shortlist(rk.fusion_score(df, ce_weight=50.0), top_n=10, preserve=4, head=4).orderBy("final_rank").collect()
    assert len(out) == len({r.doc_id for r in out}) == 10 and [r.rrf_rank for r in out[:4]] == [1, 2, 3, 4]


def test_consistency_majority_is_strict(spark):
    df = spark.createDataFrame([("k", "full"), ("k", "Full "), ("k", "partial"), ("t", "full"), ("t", "none")], "key string, status string")
    got = {(r.key, r.final_status, r.conflict) for r in vd.reconcile(df, ["key"]).collect()}
    assert got == {("k", "full", True), ("t", "full", True), ("t", "none", True)}


def test_grounding(spark):
    df = spark.createDataFrame([("Count the “red” apples on the table", True), ("count the apples", False), ("read the story; apples on the table; nothing", False), ("red\" apples on the; count the \"red\"", True)], "q string, want boolean")
    text = F.lit('Please  count the "red" apples on the table. Then read.')
    assert all(r.got == r.want for r in df.select("want", vd.grounded(F.col("q"), text).alias("got")).collect())


def test_grounding_folds_marks_blanks_and_ligatures(spark):
    text = "Say: \u201cThe \ufb01rst of the \u2018frames\u2019 is ________ today\u201d.\n- Count the apples on the big table\nwith a friend, one by one"
    rows = [
        ("The first of the frames is _ today", True),
        ("'the first of the 'frames' is ____ today'", True),
        ("Count the apples on the big table with a friend", True),
        ("count the apples on; with a friend, one by one", True),
        ("count the apples on; with no friend, one by one", False),
        ("the apples", False),
        (None, False),
    ]
    df = spark.createDataFrame(rows, "q string, want boolean")
    assert [r.got for r in df.select(vd.grounded(F.col("q"), F.lit(text)).alias("got")).collect()] == [w for _, w in rows]


def test_evidence_repair_and_page(spark):
    text = "(page 3)\nTell students to read the poem aloud twice.\n(page 4)\nAsk: What do you see in the sky at night? Then draw it."
    rows = [
        (["Tell students to read the poem aloud twice [choral]."], "Tell students to read the poem aloud twice", 3),
        (["Invented words then What do you see in the sky at night? and more"], "What do you see in the sky at night?", 4),
        (["in the sky at"], "in the sky at night? Then", 4),
        (["nothing of the kind was ever said here at all"], None, None),
        ([None, "Ask: What do you see in the sky at night?"], "Ask: What do you see in the sky at night?", 4),
    ]
    df = spark.createDataFrame([(q,) for q, _, _ in rows], "q array<string>")
    out = df.withColumn("e", vd.repaired(F.col("q"), F.lit(text))).withColumn("p", vd.page_of(F.col("e"), F.lit(text))).collect()
    for r, (_, e, p) in zip(out, rows):
        assert (e is None and r.e is None) or r.e.rstrip(".").startswith(e) and r.p == p


def test_review_flags_timing_and_scope(spark):
    df = spark.createDataFrame([("X", "full", "high", "Reads the text well and shows it fully here.", "It is partial because it happens only after reading. Students retell events."), ("X", "full", "high", "Reads the text well and shows it fully here.", "Any one of the items is named; all required acts are separable.")], "doc_id string, status string, confidence string, evidence string, rationale string")
    out = vd.finalize(df.withColumn("src", F.lit("He Reads the text well and shows it fully here.")), "src").collect()
    assert out[0].rationale == "Students retell events. " + vd.TIMING_NOTE and out[0].review_reason == "invented while/after-reading timing (P5)" and out[0].confidence == "low"
    assert out[1].review_reason == "list-standard waffle (OR vs separable)" and out[1].final_status == "full"
    guide = "using the Close Read-aloud Guide (for teacher reference)"
    texts = [guide, "Close Read-aloud Guide\nAsk: one?\nWhat is it?\nWhy so?", "Close Read-aloud Guide\nAsk: one?\n[Work] next\nWhat is it?\nWhy so?", "no guide"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(vd.scope_caveat(F.lit("C"), F.col("t"), ["C"]).alias("c"), vd.scope_caveat(F.lit("D"), F.col("t"), ["C"]).alias("d")).collect()
    assert [bool(r.c) for r in got] == [True, False, True, False] and not any(r.d for r in got)


def test_page_list(spark):
    df = spark.createDataFrame([("a", p) for p in (74, 91, 84, 92, 92)], "d string, p int")
    assert ru.page_list(ru.page_runs(df, "d", "p"), "d").first().pages == "pp. 74, 84, 91–92"


def test_gold_rows_count_as_often_as_they_occur(spark):
    gold = spark.createDataFrame([("e", "a"), ("e", "a"), ("e", "b")], "e string, d string")
    ranked = spark.createDataFrame([("e", "a", 1)], "e string, d string, rank int")
    assert ev.recall_and_mrr(gold, ranked, ["e", "d"], [1]).first().recall_1 == pytest.approx(0.666667)
    assert ev.recall_and_mrr(gold, ranked, ["e", "d"], [1], distinct_gold=True).first().recall_1 == 0.5


def test_scans_and_guard(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code": "1", "text": "x"}')
    (tmp_path / "_b.json").write_text('{"code": "2", "text": "y"}')
    assert [r.code for r in src.read_records(spark, str(tmp_path), "code string, text string").collect()] == ["1"]
    df = spark.createDataFrame([("=1+1",), ("ok",), (None,)], "t string")
    assert [r.g for r in df.select(src.guarded(F.col("t")).alias("g")).collect()] == ["'=1+1", "ok", None]
    with pytest.raises(ValueError, match="repeated"):
        src.assert_unique(df.unionByName(df), ["t"])


def test_stream_counts_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parque[t]")
    q = live.typed_counts(source, "ts", "event_type").writeStream.format("memory").queryName("typed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.to_date("ts").alias("day"), "event_type").count().count()
    assert spark.table("typed").count() == batch


def test_latest_decision_batches(spark, tmp_path):
    fold = live.keep_latest(["item"], "at", "decision", str(tmp_path / "latest"))
    fold(spark.createDataFrame([(1, 1, "accepted"), (2, 1, "accepted")], "item int, at int, decision string"), 0)
    fold(spark.createDataFrame([(1, 2, "pending")], "item int, at int, decision string"), 1)
    now = live.current(spark.read.parquet(f"{tmp_path}/latest.1"), ["item"], "at", "decision").collect()
    assert [(r.item, r.decision) for r in now] == [(2, "accepted")]


def _rows(df):
    plain = lambda x: "NULL" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else (round(float(x), 9) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)[:10] if hasattr(x, "year") else x)
    return sorted(map(str, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert _rows(got) == _rows(duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
