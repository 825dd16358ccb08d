"""The block-max index, order statistics, page maps and trees against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from braidmark.operators import hierarchy as hi
from braidmark.operators import ranking as rk
from braidmark.operators import retrieval as rt
from braidmark.operators import structure as st
from braidmark.operators.index import BM25, hits_of, skipped_share


@pytest.mark.parametrize("block_docs", [2048, 20])
def test_search_equals_scoring_every_document(spark, block_docs):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 30])))) for i in range(300)] + [(400, None), (401, "..."), (402, "W1 w1 w3"), (403, "W1 w1 w3")]
    asked = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12])))) for i in range(40)] + [(50, "unknown"), (51, ""), (52, None), (53, "w1 w1 w1")]
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, terms string").repartition(3)
    corpus = rt.Corpus(frame(docs), "id", "text")
    corpus.index.blocks = rt.Index(corpus.tokens.select("id", F.greatest(F.lit(1), F.size("tokens")).alias("len"), rt.hashed(F.col("tokens")).alias("terms")), block_docs).blocks
    tokens = {i: [w for w in (t or "").lower().split() if w != "..."] for i, t in docs}
    n, avg = len(tokens), sum(max(1, len(t)) for t in tokens.values()) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    value = BM25(avg)
    want = {}
    for q, text in asked:
        scores = []
        for i, t in tokens.items():
            tf = Counter(t)
            parts = [c * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * value(tf[w], max(1, len(t))) for w, c in sorted(Counter((text or "").split()).items()) if tf[w]]
            if parts:
                scores.append((-sum(parts), i))
        scores.sort()
        want |= {(q, r): (i, round(-s, 6)) for r, (s, i) in enumerate(scores[:7], 1)}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in corpus.bm25(frame(asked), "id", "text", 7).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    found = corpus.index.search(rt.packed_queries(corpus.bm25_terms(frame(asked), "id", "text")), 1, value, group_terms=20)
    assert hits_of(found).count() >= 40 and 0.0 < skipped_share(found) < 1.0
    empty = rt.Corpus(frame(docs).limit(0), "id", "text")
    assert empty.bm25(frame(asked), "id", "text", 3).count() == 0 and corpus.bm25(frame(asked).limit(0), "id", "text", 3).count() == 0


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    groups = {"wide": rng.normal(0, 1e9, 3000), "same": np.full(2500, 7.0), "steps": rng.integers(0, 4, 2600).astype(float), "skew": np.concatenate([np.full(1500, 1e-300), rng.exponential(1, 1500) ** 40]), "one": np.array([3.5]), "few": np.array([2.0, 1.0, 2.0]), "ends": np.array([-1.7e308, 1.7e308, 0.0, 5.0] * 400)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {(r.g, r["at"]): r.x for r in rk.order_statistics(df, "array(0L, n div 3, n div 2, n - 1)", most_rows=300, bins=16).collect()}
    for g, v in groups.items():
        ordered = np.sort(v)
        for at in {0, len(v) // 3, len(v) // 2, len(v) - 1}:
            assert got[g, at] == ordered[at]
    assert rk.order_statistics(df.limit(0), "array(0L)").count() == 0


def test_page_map_of_long_spans(spark):
    rng = random.Random(1)
    spans = [("a", 0, 0), ("a", 5, 4), ("a", 3, 1_000_000), ("a", 999_990, 2_000_000), ("b", 7, 7), ("c", -9, 12)] + [("a", s, s + rng.randrange(60)) for s in (rng.randrange(300) for _ in range(40))]
    pages = {("a", p): str(1000 + p) for p in rng.sample(range(400), 90)} | {("a", 1_000_000): "last", ("b", 8): "no", ("c", -9): "first", ("c", 12): None}
    spans = sorted(set(spans))
    df = spark.createDataFrame(spans, "doc string, start int, end int")
    got = {(r.doc, r.start, r.end): (r.printed_first, r.printed_last) for r in st.printed_range(df, spark.createDataFrame([(*k, v) for k, v in pages.items()], "doc string, page int, printed string"), "doc").collect()}
    want = {}
    for d, s, e in spans:
        inside = sorted(p for (x, p) in pages if x == d and s <= p <= e)
        if inside:
            want[d, s, e] = (pages[d, inside[0]], pages[d, inside[-1]])
    assert got == want


def test_deep_chains_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(hi, "written", lambda df, name, real=hi.written: rounds.append(name) or real(df, name))
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("own", "own"), ("lost", "nowhere")]
    up = hi.ancestors(spark.createDataFrame(chain, "id string, parent string"), "id", "parent")
    found = defaultdict(dict)
    for r in up.collect():
        found[r.node][r.ancestor] = r.distance
    assert found["n299"] == {f"n{i}": 299 - i for i in range(299)} and found["x"] == {"y": 1, "z": 2}
    assert "own" not in found and "lost" not in found and len(rounds) <= 2 * 10 + 1


def test_a_task_reads_one_block_at_a_time(spark):
    docs = spark.range(60).selectExpr("id", "4D AS len", "array(id % 7, id % 5, 1L, 1L) AS terms").repartition(2)
    index = rt.Index(docs.repartition(4), block_docs=5)
    found = index.search(spark.createDataFrame([(i, [1, i], [1.0, 2.0]) for i in range(5)], "id long, terms array<long>, weights array<double>"), 3, BM25(4.0), group_hits=4)
    groups, blocks = 0, 0
    for path in (f.removeprefix("file:") for f in index.blocks.inputFiles()):
        meta = pq.ParquetFile(path).metadata
        groups, blocks = groups + meta.num_row_groups, blocks + meta.num_rows
    assert groups == blocks >= 12
    best = rt.top_k(hits_of(found), ["query_id"], [F.desc("score"), "doc_id"], 3).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in best) == [(i, 3) for i in range(5)]
    assert found.filter("query_id IS NULL").count() % 4 == 0
