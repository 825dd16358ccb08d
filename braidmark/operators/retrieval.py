"""Sparse and dense retrieval, and the fusion of ranked lists, for all entities in one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType, StructType

from braidmark.operators.index import BM25, Index, Once, hits_of
from braidmark.session import written

TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens; dotted codes stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def alignable_leaves(docs: DataFrame, doc_id: str, parent: str, level: str, dropped: tuple[str, ...] = ("domain", "big_idea")) -> DataFrame:
    """Rows that are nobody's parent in the whole table, of a level that can be aligned."""
    parents = docs.select(F.col(parent).alias(doc_id)).filter(F.col(doc_id).isNotNull()).distinct()
    usable = docs.filter(F.col(doc_id).isNotNull() & (F.trim(F.col(doc_id).cast("string")) != "") & ~F.col(level).isin(*dropped))
    return usable.join(parents, doc_id, "left_anti")


def of_grade(docs: DataFrame, grade: str, wanted: str) -> DataFrame:
    """Documents of a grade, and those of none."""
    return docs.filter(F.col(grade).isNull() | (F.col(grade) == wanted))


def of_grade_or_error(docs: DataFrame, grade: str, wanted: str) -> DataFrame:
    """of_grade, but an error where nothing remains."""
    kept = of_grade(docs, grade, wanted)
    if kept.isEmpty():
        raise ValueError(f"no document of grade {wanted}")
    return kept


def scorable(docs: DataFrame, level: str, levels: tuple[str, ...] = ("standard", "substandard")) -> DataFrame:
    return docs.filter(F.col(level).isin(*levels))


def allowed_hits(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, score) of allowed documents only, ranked anew."""
    kept = hits.drop("rank").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).select("query_id", "rank", "doc_id", "score")


_HITS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _best_of(score: np.ndarray, asked: np.ndarray, docs: np.ndarray, k: int, digits: int) -> pa.Table:
    """The k best columns of each row, ties to the smaller document; docs ascend."""
    score = np.round(score, digits)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(asked)), best.shape[1])
    found = score[rows, best.ravel()]
    return pa.Table.from_arrays([pa.array(asked[rows]), pa.array(docs[best.ravel()]), pa.array(found)], schema=_HITS)


def hashed(tokens: Column) -> Column:
    """64-bit hashes of tokens."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def packed_queries(terms: DataFrame) -> DataFrame:
    """id, terms (hashes), weights of rows id, term, w: a row for each query, terms in their own order."""
    own = F.array_sort(F.collect_list(F.struct("term", "w")))
    return terms.groupBy("id").agg(own.alias("t")).select("id", F.transform("t", lambda x: F.xxhash64(x["term"])).alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights"))


class Corpus:
    """A corpus's index, written once and shared by the sparse arms; doc_id is a long."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        tokens = docs.select(F.col(doc_id).alias("id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        self.tokens = tokens
        self.index = Index(tokens.select("id", F.greatest(F.lit(1), F.size("tokens")).alias("len"), hashed(F.col("tokens")).alias("terms")))
        self.n_docs, total = self.index.totals()
        self.avg_len = total / self.n_docs if self.n_docs else 1.0

    def statistics(self) -> DataFrame:
        """term, df."""
        return self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def _asked(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        terms = queries.select(F.col(query_id).alias("id"), F.explode(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("term"))
        return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("times"))

    def _best(self, asked: DataFrame, k: int, value) -> DataFrame:
        best = hits_of(self.index.search(packed_queries(asked), k, value))
        return top_k(best, ["query_id"], [F.desc("score"), "doc_id"], k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))

    def bm25_terms(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """id, term, w of each query's terms that the corpus has: times asked * idf."""
        idf = F.log(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = self.index.df().withColumnRenamed("term", "__t")
        met = self._asked(queries, query_id, text).withColumn("__t", F.xxhash64("term")).join(known, "__t")
        return met.select("id", "term", (F.col("times") * idf).alias("w"))

    def bm25(self, queries: DataFrame, query_id: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, rank, doc_id, score: the best k documents of each query (long ids) by BM25 over shared terms.

        Repeated query terms count again; scores must exceed 0. Ranked by the scores as they are,
        ties to the smaller id; shown to six digits.
        """
        return self._best(self.bm25_terms(queries, query_id, text), k, BM25(self.avg_len, k1, b))

    def term_overlap(self, queries: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
        """The best k documents of each query by number of distinct shared terms."""
        return self._best(self._asked(queries, query_id, text).select("id", "term", F.lit(1.0).alias("w")), k, Once())


def _cosine_block(k: int, digits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        matrix = lambda t: np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks]).reshape(t.num_rows, -1)
        docs, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(docs, kind="stable")
        return _best_of(matrix(right) @ matrix(left)[order].T, asked, docs[order], k, digits)

    return run


def dense_top_k(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, vector: str, k: int, block_rows: int = 8192, group_queries: int = 512, digits: int = 9) -> DataFrame:
    """query_id, rank, doc_id, score: exact cosine top-k; blocks of rows meet groups of queries, k rows a block remain.

    Null, empty and zero vectors take no part. Ids are longs.
    """

    def unit(df: DataFrame, key: str) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        usable = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), norm.alias("norm")).filter("norm > 0 AND NOT isnan(norm)")
        return usable.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").alias("dim"))

    rows, asked = written(unit(docs, doc_id), "vectors"), written(unit(queries, query_id), "asked")
    blocks, groups = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // group_queries))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", deal(blocks).alias("block"), upto(groups).alias("part")).groupBy("dim", "block", "part")
    right = asked.select("*", upto(blocks).alias("block"), deal(groups).alias("part")).groupBy("dim", "block", "part")
    best = left.cogroup(right).applyInArrow(_cosine_block(k, digits), "query_id long, doc_id long, score double")
    return top_k(best, ["query_id"], [F.desc("score"), "doc_id"], k).select("query_id", "rank", "doc_id", "score")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Full outer join of two ranked arms: each arm's rank and score stay null where it has no hit."""
    both = dense.selectExpr("query_id", "doc_id", "rank AS dense_rank", "score AS dense_score").join(sparse.selectExpr("query_id", "doc_id", "rank AS bm25_rank", "score AS bm25_score"), ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    return top_k(scored, ["query_id"], [F.desc("rrf_score"), "doc_id"], k)


def fuse_arms(hits: DataFrame, mode: str | Column = "top_k_sum", rrf_k: int | Column = 60, top_arms: int | Column = 3, base: float = 2.0, max_blend: float = 1.0, by: list[str] = ()) -> DataFrame:
    """entity_id, doc_id, score, n_arms, arm_hits of weighted ranked lists.

    hits: entity_id, query_index, doc_id, rank, weight. A document counts once per list, at its
    first place; blank ids and lists of weight 0 are skipped; a negative weight is an error.
    The settings may be columns that are constant in each group of `by`.
    """
    mode, rrf_k, top_arms = (x if isinstance(x, Column) else F.lit(x) for x in (mode, rrf_k, top_arms))
    good = hits.filter(F.col("doc_id").isNotNull() & (F.col("weight") != 0))
    checked = good.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative arm weight"))).otherwise(F.col("weight")))
    settled = checked.select(*by, "entity_id", "query_index", "doc_id", "rank", "weight", mode.alias("__mode"), rrf_k.alias("__k"), top_arms.alias("__top"))
    first = settled.groupBy(*by, "entity_id", "query_index", "doc_id").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("weight", "__mode", "__k", "__top")])
    parts = first.withColumn("part", F.col("weight") / (F.col("__k") + F.col("rank")))
    order = W.partitionBy(*by, "entity_id", "doc_id").orderBy(F.desc("part"), "rank", "query_index")
    placed = parts.withColumn("place", F.row_number().over(order))
    n, kind = F.count(F.lit(1)), F.first("__mode")
    score = (
        F.when(kind == "sum", F.sum("part"))
        .when(kind == "max", F.max("part"))
        .when(kind == "top_k_sum", F.sum(F.when(F.col("place") <= F.col("__top"), F.col("part"))))
        .when(kind == "log_dampened", F.sum("part") * F.log(1.0 + n) / F.log(F.lit(base)) / n)
        .otherwise(F.raise_error(F.concat(F.lit("no such mode: "), kind)).cast("double"))
    )
    hit = F.struct("place", "query_index", "rank", "weight", "part")
    return placed.groupBy(*by, "entity_id", "doc_id").agg(F.round(score + max_blend * F.max("part"), 9).alias("score"), n.alias("n_arms"), F.sort_array(F.collect_list(hit)).alias("arm_hits"))


def pool_membership(primary: DataFrame, secondary: DataFrame | None, k: int) -> DataFrame:
    """Top k of primary, then those of secondary's top k that it lacks, by primary score (nulls as 0).

    Both: entity_id, doc_id, score. Without a secondary list the pool is primary's top k alone.
    """
    if secondary is None:
        return top_k(primary, ["entity_id"], [F.desc("score"), "doc_id"], k).select("entity_id", "rank", "doc_id", "score", F.lit(False).alias("added"))
    order = [F.desc("score"), "doc_id"]
    one = top_k(primary, ["entity_id"], order, k, "p_rank").select("entity_id", "doc_id", "p_rank")
    two = top_k(secondary, ["entity_id"], order, k, "s_rank").select("entity_id", "doc_id", "s_rank")
    pool = one.join(two, ["entity_id", "doc_id"], "full_outer").join(primary.select("entity_id", "doc_id", "score"), ["entity_id", "doc_id"], "left")
    pool = pool.withColumns({"score": F.coalesce("score", F.lit(0.0)), "added": F.col("p_rank").isNull()})
    place = F.row_number().over(W.partitionBy("entity_id").orderBy("added", F.desc("score"), "doc_id"))
    return pool.withColumn("rank", place).select("entity_id", "rank", "doc_id", "score", "added")


def merge_queries(hits: DataFrame, coverage_top: int = 12) -> DataFrame:
    """Per entity and document: least ranks, greatest scores, and how many coverage queries hit it near the top.

    hits: entity_id, query_index, doc_id, rank, score, weight, covers; where the arms' own
    dense_rank, bm25_rank, dense_score and bm25_score are given, they are merged as well and all
    hits kept in order of query. Other columns come from the first query that hit the document.
    """
    counted = F.col("covers") & (F.col("rank") <= coverage_top)
    given = [c for c in ("dense_rank", "bm25_rank", "dense_score", "bm25_score") if c in hits.columns]
    arms = [(F.min(c) if c.endswith("rank") else F.max(c)).alias(c) for c in given]
    own = ("entity_id", "query_index", "doc_id", "rank", "score", "weight", "covers", *given)
    rest = [F.min_by(c, "query_index").alias(c) for c in hits.columns if c not in own]
    kept = [F.array_sort(F.collect_list(F.struct("query_index", "rank", "weight"))).alias("arm_hits")] if given else []
    return hits.groupBy("entity_id", "doc_id").agg(
        F.min("rank").alias("best_rank"),
        F.max("score").alias("best_score"),
        F.count(F.when(counted, 1)).alias("query_hits"),
        F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)).alias("query_hit_weight"),
        F.min_by("score", "query_index").alias("first_score"),
        *arms,
        *kept,
        *rest,
    )


def sum_extras(merged: DataFrame, fused: DataFrame, dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, arm_weight: float = 0.0, agree_most: int = 10) -> DataFrame:
    """Merge scores of the sum mode, for merged documents only.

    The fused score, plus 0.55 * hit weight / k; with an arm weight also the weighted sums of the
    two arms' own lists (dense, sparse: entity_id, doc_id, score) and a bonus of 1.5 (2.5 more up
    to agree_most) over k + the worse of both ranks where both arms hit the document.
    """
    one = lambda df, name: df.select("entity_id", "doc_id", F.col("score").alias(name))
    met = merged.drop("score").join(one(fused, "__f"), ["entity_id", "doc_id"], "left").join(one(dense, "__d"), ["entity_id", "doc_id"], "left").join(one(sparse, "__s"), ["entity_id", "doc_id"], "left")
    worse = F.when(F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull(), F.greatest("dense_rank", "bm25_rank"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bonus = zero(1.5 / (rrf_k + worse)) + zero(F.when(worse <= agree_most, 2.5 / (rrf_k + worse)))
    extras = arm_weight * (zero(F.col("__d")) + zero(F.col("__s")) + bonus)
    return met.withColumn("score", F.round(zero(F.col("__f")) + extras + 0.55 * F.col("query_hit_weight") / rrf_k, 9)).drop("__f", "__d", "__s")


def exhaustive_pool(merged: DataFrame, corpus: DataFrame, grade: str, ceiling: int = 200) -> DataFrame:
    """Adds a grade's unseen documents, without a prior, where the grade has at most `ceiling` of them.

    merged: entity_id, grade, doc_id, score. corpus: doc_id, grade.
    """
    small = corpus.groupBy(grade).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= ceiling).select(grade)
    every = merged.select("entity_id", grade).distinct().join(corpus.join(small, grade, "left_semi"), grade)
    unseen = every.join(merged.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti")
    return merged.unionByName(unseen.select("entity_id", grade, "doc_id"), allowMissingColumns=True)


def embed_with(docs: DataFrame, text: str, embed_fn, out: str = "embedding", dims: int | None = None) -> DataFrame:
    """Adds vectors by a caller's function over lists of texts: one for each text, all of one length, none zero."""
    schema = StructType([*docs.schema.fields]).add(out, ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            vectors = embed_fn(texts)
            if len(vectors) != len(texts) or len({len(v) for v in vectors} | ({dims} if dims else set())) > 1:
                raise ValueError("embed_fn must give one vector of the same length for each text")
            if any(not np.any(np.asarray(v)) for v in vectors):
                raise ValueError("embed_fn gave an empty or zero vector")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def score_with(pairs: DataFrame, query: str, text: str, score_fn, out: str = "rerank_score") -> DataFrame:
    """Adds scores by a caller's function over lists of queries and texts: one number for each pair."""
    schema = StructType([*pairs.schema.fields]).add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (query, text))
            scores = list(score_fn(asked, texts))
            if len(scores) != len(texts):
                raise ValueError("score_fn must give one score for each pair")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return pairs.mapInArrow(run, schema)
