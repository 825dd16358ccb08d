"""The retrieval funnel from queries to reranked candidates, for all entities in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.operators import ranking as rk
from braidmark.operators import retrieval as rt
from braidmark.session import written


def single_query(dense: DataFrame, sparse: DataFrame, scores: DataFrame | None, hybrid_k: int = 60, rerank_k: int = 10, blend: float = 0.3, preserve: int = 0) -> DataFrame:
    """One query per entity: both arms (query_id, rank, doc_id, score) fused to hybrid_k rows, then blended with scores (query_id, doc_id, rerank_score) to rerank_k; without scores the hybrid list."""
    fused = rt.hybrid(dense, sparse, hybrid_k)
    if scores is None:
        return fused
    named = fused.withColumnsRenamed({"query_id": "entity_id", "rank": "rrf_rank"}).join(scores.withColumnRenamed("query_id", "entity_id"), ["entity_id", "doc_id"], "left")
    return rk.preserve_heads(rk.blend(named, blend), rerank_k, preserve)


def multi_query(arms: DataFrame, corpus: DataFrame | None, scores: DataFrame | None, merge_k: int = 200, rerank_k: int = 120, mode: str = "top_k_sum", union: bool = True, rrf_k: int = 60, ceiling: int = 200, blend: float = 0.3, preserve: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final, merged, diagnostics) of several queries per entity.

    arms: entity_id, query_index, source, weight, covers, doc_id, rank, score and the arms' own
    dense_rank, bm25_rank, dense_score, bm25_score: the hybrid list of each query. They are merged,
    fused by mode (with the hit bonus of the sum mode), cut to a pool of merge_k (united with the
    plain sum's head if union), widened to an entity's whole grade where that is small (corpus:
    doc_id, grade; arms then have a grade), and blended with scores (entity_id, doc_id,
    rerank_score). Without scores, final is merged.
    """
    arms = written(arms, "arms")
    merged = rt.merge_queries(arms)
    fused = rt.fuse_arms(arms, mode, rrf_k).select("entity_id", "doc_id", "score")
    plain = rt.fuse_arms(arms, "sum", rrf_k, max_blend=0.0).select("entity_id", "doc_id", "score")
    if mode == "sum":
        none = plain.limit(0)
        fused = rt.sum_extras(merged, fused, none, none, rrf_k).select("entity_id", "doc_id", "score")
    pool = rt.pool_membership(fused, plain if union and mode != "sum" else None, merge_k)
    pool = pool.select("entity_id", "doc_id", F.col("rank").alias("rrf_rank"), F.col("score").alias("rrf_score"), "added")
    merged = written(pool.join(merged, ["entity_id", "doc_id"]), "merged")
    diagnostics = arms.groupBy("entity_id", "query_index").agg(F.first("source").alias("source"), F.first("weight").alias("query_weight"), F.count(F.lit(1)).alias("n_hybrid"), F.count("dense_rank").alias("n_dense"), F.count("bm25_rank").alias("n_bm25"))
    if scores is None:
        return merged, merged, diagnostics
    candidates = merged if corpus is None else rt.exhaustive_pool(merged, corpus, "grade", ceiling)
    scored = candidates.join(scores.select("entity_id", "doc_id", "rerank_score"), ["entity_id", "doc_id"], "left")
    return rk.preserve_heads(rk.blend(scored, blend), rerank_k, preserve), merged, diagnostics
