"""Retrieval, ranking and evaluation over the given tables.

documents is the corpus (lang: grade, source: family), benchmark holds the queries, whose
sentences are the arms of an entity; embeddings with vec_id % 50 = 0 are dense queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import evaluation as ev
from braidmark.operators import ranking as rk
from braidmark.operators import retrieval as rt
from braidmark.plans.book import Book
from braidmark.session import table, written

BOOK = Book()
query = BOOK.query

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)*')"
POSTINGS = f"""
tok AS (SELECT doc_id, {TOKENS} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len
         FROM (SELECT doc_id, greatest(1, len(t)) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(greatest(1, len(t))) AS al FROM tok),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def bm25_sql(asked: str, keys: str, k: int) -> str:
    """CTEs up to `hit`: the best k documents for each row of asked (keys, text)."""
    return f"""{POSTINGS},
q AS (SELECT {keys}, term, count(*) AS times FROM (SELECT {keys}, unnest({TOKENS}) AS term FROM {asked}) GROUP BY ALL),
sc AS (SELECT {keys}, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) ORDER BY term) AS raw
       FROM q JOIN dfs USING (term) JOIN post USING (term), tot GROUP BY ALL),
hit AS (SELECT * EXCLUDE (raw), round(raw, 6) AS score, row_number() OVER (PARTITION BY {keys} ORDER BY raw DESC, doc_id) AS rank FROM sc WHERE raw > 0
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY raw DESC, doc_id) <= {k})"""


ARMS_SQL = """arms AS (SELECT item_id, i - 1 AS query_index, trim(s[i]) AS text, CASE WHEN i = 1 THEN 1.5 ELSE 1.0 END AS weight
FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id, string_split(text, '.') AS s FROM benchmark)) WHERE length(trim(s[i])) >= 12)"""
ARM_HITS_SQL = ARMS_SQL + ", " + bm25_sql("arms", "item_id, query_index, weight", 50)


def docs(spark, d):
    return table(spark, d, "documents")


def items(spark, d):
    return table(spark, d, "benchmark")


def corpus(spark, d):
    return rt.Corpus(docs(spark, d), "doc_id", "text")


def bm25_top(spark, d, k=20):
    return corpus(spark, d).bm25(items(spark, d), "item_id", "text", k)


def arms(spark, d):
    """All sentences of 12 characters or more of each item, the first weighted more."""
    s = items(spark, d).select("item_id", F.posexplode(F.split("text", r"\.")).alias("query_index", "text"))
    return s.withColumn("text", F.trim("text")).filter(F.length("text") >= 12).withColumn("weight", F.when(F.col("query_index") == 0, 1.5).otherwise(1.0))


def arm_hits(spark, d, k=50):
    a = written(arms(spark, d).withColumn("key", F.xxhash64("item_id", "query_index")), "arms")
    hit = corpus(spark, d).bm25(a, "key", "text", k)
    hit = hit.join(a.select(F.col("key").alias("query_id"), F.col("item_id").alias("entity_id"), "query_index", "weight"), "query_id")
    return written(hit.select("entity_id", "query_index", "weight", "rank", "doc_id", "score"), "arm-hits")


def vectors(spark, d):
    """All rows, and those that are queries."""
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 50 = 0")


@query(f"WITH {POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(al, 6) AS avg_len FROM dfs, tot")
def corpus_statistics(spark, d):
    c = corpus(spark, d)
    n, df = c.n_docs, F.col("df")
    return c.statistics().select("term", "df", F.round(F.log(1 + (n - df + 0.5) / (df + 0.5)), 6).alias("idf"), F.round(F.lit(c.avg_len), 6).alias("avg_len"))


@query(f"WITH {bm25_sql('benchmark', 'item_id', 20)} SELECT item_id AS query_id, rank, doc_id, score FROM hit")
def bm25_top20(spark, d):
    return bm25_top(spark, d)


_OVERLAP = f"""ov AS (SELECT item_id, doc_id, count(*)::DOUBLE AS score FROM (SELECT item_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark) JOIN post USING (term) GROUP BY ALL),
ohit AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ov QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20)"""


@query(
    f"""WITH {bm25_sql('benchmark', 'item_id', 20)}, {_OVERLAP},
j AS (SELECT coalesce(h.item_id, o.item_id) AS query_id, coalesce(h.doc_id, o.doc_id) AS doc_id, o.rank AS dense_rank, o.score AS dense_score, h.rank AS bm25_rank, h.score AS bm25_score
      FROM ohit o FULL JOIN hit h ON o.item_id = h.item_id AND o.doc_id = h.doc_id),
s AS (SELECT *, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 9) AS rrf_score FROM j)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) <= 20"""
)
def hybrid_top20(spark, d):
    c = corpus(spark, d)
    return rt.hybrid(c.term_overlap(items(spark, d), "item_id", "text", 20), c.bm25(items(spark, d), "item_id", "text", 20), 20)


_V = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id != q.vec_id)"""


@query(f"WITH {_V} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def dense_top10(spark, d):
    every, asked = vectors(spark, d)
    hit = rt.dense_top_k(every, asked, "vec_id", "vec_id", "embedding", 11, digits=6).filter("query_id != doc_id").drop("rank")
    return rt.top_k(hit, ["query_id"], [F.desc("score"), "doc_id"], 10).select("query_id", "rank", "doc_id", "score")


_FUSE = ARM_HITS_SQL + """,
p AS (SELECT item_id, doc_id, query_index, rank, weight / (60 + rank) AS part FROM hit),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY part DESC, rank, query_index) AS place FROM p)"""


@query(f"WITH {_FUSE} SELECT item_id AS entity_id, doc_id, round(sum(part) FILTER (place <= 3) + max(part), 9) AS score, count(*) AS n_arms FROM o GROUP BY ALL")
def fuse_top_k_sum(spark, d):
    return rt.fuse_arms(arm_hits(spark, d)).drop("arm_hits")


@query(f"WITH {_FUSE} SELECT item_id AS entity_id, doc_id, round(sum(part), 9) AS score, count(*) AS n_arms FROM o GROUP BY ALL")
def fuse_sum(spark, d):
    return rt.fuse_arms(arm_hits(spark, d), "sum", max_blend=0.0).drop("arm_hits")


@query(f"WITH {_FUSE} SELECT item_id AS entity_id, doc_id, round(max(part), 9) AS score, count(*) AS n_arms FROM o GROUP BY ALL")
def fuse_max(spark, d):
    return rt.fuse_arms(arm_hits(spark, d), "max", max_blend=0.0).drop("arm_hits")


@query(f"WITH {_FUSE} SELECT item_id AS entity_id, doc_id, round(sum(part) * ln(1.0 + count(*)) / ln(2.0) / count(*), 9) AS score, count(*) AS n_arms FROM o GROUP BY ALL")
def fuse_log_dampened(spark, d):
    return rt.fuse_arms(arm_hits(spark, d), "log_dampened", max_blend=0.0).drop("arm_hits")


_SCORES = f"""{_FUSE},
a AS (SELECT item_id, doc_id, round(sum(part) FILTER (place <= 3) + max(part), 9) AS score FROM o GROUP BY ALL),
b AS (SELECT item_id, doc_id, round(sum(part), 9) AS score FROM o GROUP BY ALL),
ar AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)"""


@query(
    f"""WITH {_SCORES}, one AS (SELECT * FROM ar WHERE rank <= 20), two AS (SELECT * FROM br WHERE rank <= 20),
u AS (SELECT item_id, doc_id, false AS added FROM one UNION ALL SELECT item_id, doc_id, true FROM two WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM one))
SELECT u.item_id AS entity_id, row_number() OVER (PARTITION BY u.item_id ORDER BY added, a.score DESC, u.doc_id) AS rank, u.doc_id, a.score, added FROM u JOIN a ON a.item_id = u.item_id AND a.doc_id = u.doc_id"""
)
def pool_union(spark, d):
    hits = arm_hits(spark, d)
    pick = ("entity_id", "doc_id", "score")
    return rt.pool_membership(rt.fuse_arms(hits).select(*pick), rt.fuse_arms(hits, "sum", max_blend=0.0).select(*pick), 20)


@query(
    f"""WITH {ARM_HITS_SQL} SELECT item_id AS entity_id, doc_id, min(rank) AS best_rank, max(score) AS best_score,
count(*) FILTER (query_index > 0 AND rank <= 12) AS query_hits, coalesce(sum(weight::DOUBLE) FILTER (query_index > 0 AND rank <= 12), 0) AS query_hit_weight, arg_min(score, query_index) AS first_score FROM hit GROUP BY ALL"""
)
def multi_query_merge(spark, d):
    return rt.merge_queries(arm_hits(spark, d).withColumn("covers", F.col("query_index") > 0))


@query(
    f"""WITH {bm25_sql('benchmark', 'item_id', 20)}, m AS (SELECT item_id AS entity_id, lang, hit.doc_id, score FROM hit JOIN documents USING (doc_id)),
s AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) <= 150),
x AS (SELECT DISTINCT entity_id, m.lang FROM m JOIN s USING (lang))
SELECT * FROM m UNION ALL SELECT entity_id, x.lang, d.doc_id, NULL FROM x JOIN documents d USING (lang) WHERE (entity_id, d.doc_id) NOT IN (SELECT (entity_id, doc_id) FROM m)"""
)
def grade_exhaustive_pool(spark, d):
    corpus = docs(spark, d).select("doc_id", "lang")
    merged = bm25_top(spark, d).join(corpus, "doc_id").select(F.col("query_id").alias("entity_id"), "lang", "doc_id", "score")
    return rt.exhaustive_pool(merged, corpus, "lang", 150)


@query("WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, 'domain' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'standard' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'substandard' FROM customer) SELECT id, parent, level FROM n WHERE level NOT IN ('domain', 'big_idea') AND id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)")
def alignable_leaves(spark, d):
    return rt.alignable_leaves(tree(spark, d), "id", "parent", "level").select("id", "parent", "level")


def tree(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("domain").alias("level"))
    n = table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.lit("standard").alias("level"))
    c = table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.lit("substandard").alias("level"))
    return r.unionByName(n).unionByName(c)


@query("WITH p AS (SELECT l_orderkey, count(*) AS n, min(l_quantity) AS a, max(l_quantity) AS b, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1), q AS (SELECT *, CASE WHEN n >= 5 THEN p5 ELSE a END AS lo, CASE WHEN n >= 5 THEN p95 ELSE b END AS hi FROM p) SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN hi > lo THEN greatest(0, least(1, (l_quantity - lo) / (hi - lo))) ELSE 0.5 END, 9) AS scaled FROM lineitem JOIN q USING (l_orderkey)")
def robust_minmax(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rk.robust_minmax(rows, ["l_orderkey"], "l_quantity", few=5)


def reranked(spark, d):
    """Candidates with a prior and a rerank score (term overlap stands in for the model's score)."""
    h = hybrid_top20(spark, d)
    c = h.select(F.col("query_id").alias("entity_id"), "doc_id", F.col("rank").alias("rrf_rank"), "rrf_score", "dense_rank", "bm25_rank", (F.coalesce("dense_score", F.lit(0.0)) - F.col("doc_id") % 7).alias("rerank_score"))
    return rk.blend(c, 0.3)


_RERANKED = BOOK.sql["hybrid_top20"].replace("SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM s QUALIFY", ", h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM s QUALIFY") + """),
c AS (SELECT query_id AS entity_id, doc_id, rank AS rrf_rank, rrf_score, dense_rank, bm25_rank, coalesce(dense_score, 0) - doc_id % 7 AS rerank_score FROM h),
pp AS (SELECT entity_id, count(*) AS n, min(rerank_score) AS a1, max(rerank_score) AS b1, quantile_cont(rerank_score, 0.05) AS l1, quantile_cont(rerank_score, 0.95) AS h1, min(rrf_score) AS a2, max(rrf_score) AS b2, quantile_cont(rrf_score, 0.05) AS l2, quantile_cont(rrf_score, 0.95) AS h2 FROM c GROUP BY 1),
lim AS (SELECT entity_id, CASE WHEN n >= 10 THEN l1 ELSE a1 END AS lo1, CASE WHEN n >= 10 THEN h1 ELSE b1 END AS hi1, CASE WHEN n >= 10 THEN l2 ELSE a2 END AS lo2, CASE WHEN n >= 10 THEN h2 ELSE b2 END AS hi2 FROM pp),
bl AS (SELECT c.*, round(0.7 * round(CASE WHEN hi1 > lo1 THEN greatest(0, least(1, (rerank_score - lo1) / (hi1 - lo1))) ELSE 0.5 END, 9) + 0.3 * round(CASE WHEN hi2 > lo2 THEN greatest(0, least(1, (rrf_score - lo2) / (hi2 - lo2))) ELSE 0.5 END, 9), 9) AS blended_score FROM c JOIN lim USING (entity_id))"""


@query(f"{_RERANKED} SELECT entity_id, doc_id, rrf_rank, round(blended_score, 6) AS blended_score FROM bl")
def rerank_blend(spark, d):
    return reranked(spark, d).select("entity_id", "doc_id", "rrf_rank", F.round("blended_score", 6).alias("blended_score"))


_SWAPPED = """"in" AND NOT (NOT must AND gone <= m)) OR (must AND NOT "in" AND let <= m)"""


@query(
    f"""{_RERANKED}, ra AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY blended_score DESC, rerank_score DESC, doc_id) AS pos FROM bl),
rb AS (SELECT *, pos <= 10 AS "in", rrf_rank <= 4 AS must FROM ra),
rc AS (SELECT *, least(count(*) FILTER (must AND NOT "in") OVER (PARTITION BY entity_id), count(*) FILTER ("in" AND NOT must) OVER (PARTITION BY entity_id)) AS m,
      row_number() OVER (PARTITION BY entity_id, must AND NOT "in" ORDER BY rrf_rank) AS let, row_number() OVER (PARTITION BY entity_id, "in" AND NOT must ORDER BY blended_score, pos) AS gone FROM rb)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY blended_score DESC, rerank_score DESC, doc_id) AS rerank_rank, doc_id, rrf_rank, round(blended_score, 6) AS blended_score FROM rc WHERE ({_SWAPPED}"""
)
def rerank_preserve(spark, d):
    return rk.preserve_heads(reranked(spark, d), 10, 4).select("entity_id", "rerank_rank", "doc_id", "rrf_rank", F.round("blended_score", 6).alias("blended_score"))


def fused(spark, d):
    from pyspark.sql import Window as W

    ce = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("blended_score"), F.desc("rerank_score"), "doc_id"))
    return rk.fusion_score(reranked(spark, d).withColumn("ce_rank", ce))


@query(
    f"""{_RERANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY blended_score DESC, rerank_score DESC, doc_id) AS ce_rank FROM bl),
f AS (SELECT *, round(1 / (60 + ce_rank) + 10 / (60 + rrf_rank) + CASE WHEN rrf_rank BETWEEN 12 AND 35 AND ce_rank <= 26 THEN 3 / (60 + ce_rank) ELSE 0 END, 9) AS fused_score,
      dense_rank IS NOT NULL AND bm25_rank IS NOT NULL AND greatest(dense_rank, bm25_rank) <= 10 AS both_arms, greatest(dense_rank, bm25_rank) AS worse, rrf_rank <= least(4, 8, count(*) OVER (PARTITION BY entity_id)) AS kept FROM r),
t AS (SELECT *, CASE WHEN both_arms THEN worse END AS agree, row_number() OVER (PARTITION BY entity_id, both_arms AND NOT kept ORDER BY CASE WHEN both_arms THEN worse END NULLS FIRST, doc_id) AS turn FROM f),
p AS (SELECT *, kept OR (both_arms AND NOT kept AND turn <= 2) AS must, row_number() OVER (PARTITION BY entity_id ORDER BY fused_score DESC, doc_id) <= 10 AS "in" FROM t),
sw AS (SELECT *, least(count(*) FILTER (must AND NOT "in") OVER (PARTITION BY entity_id), count(*) FILTER ("in" AND NOT must) OVER (PARTITION BY entity_id)) AS m,
      row_number() OVER (PARTITION BY entity_id, must AND NOT "in" ORDER BY rrf_rank, agree NULLS FIRST, doc_id) AS let, row_number() OVER (PARTITION BY entity_id, "in" AND NOT must ORDER BY fused_score, doc_id DESC) AS gone FROM p)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN rrf_rank <= 4 THEN rrf_rank END NULLS LAST, fused_score DESC, doc_id) AS final_rank, doc_id, rrf_rank, fused_score FROM sw WHERE ({_SWAPPED}"""
)
def judge_shortlist(spark, d):
    return rk.shortlist(fused(spark, d), top_n=10, preserve=4, head=4).select("entity_id", "final_rank", "doc_id", "rrf_rank", "fused_score")


@query(
    f"""WITH RECURSIVE {bm25_sql("benchmark", "item_id", 20)}, r AS (SELECT item_id AS entity_id, rank AS spot, doc_id, lang AS family FROM hit JOIN documents USING (doc_id)),
w AS (SELECT entity_id, 0::BIGINT AS n, list({{'spot': spot, 'doc_id': doc_id, 'family': family}} ORDER BY spot) AS rest, NULL::VARCHAR AS last, 0::BIGINT AS run, NULL::BIGINT AS doc_id FROM r GROUP BY 1
UNION ALL SELECT entity_id, n + 1, list_filter(rest, lambda x: x.spot != p.spot), p.family, CASE WHEN p.family IS NOT DISTINCT FROM last THEN run + 1 ELSE 1 END, p.doc_id
FROM (SELECT *, CASE WHEN run >= 3 THEN coalesce(list_filter(rest, lambda x: x.family IS DISTINCT FROM last)[1], rest[1]) ELSE rest[1] END AS p FROM w WHERE len(rest) > 0))
SELECT entity_id, n AS rank, doc_id, last AS family FROM w WHERE n > 0"""
)
def family_interleave(spark, d):
    rows = bm25_top(spark, d).join(docs(spark, d).select("doc_id", F.col("lang").alias("family")), "doc_id").select(F.col("query_id").alias("entity_id"), "rank", "doc_id", "family")
    return rk.interleave_families(rows)


@query(
    f"""WITH {_FUSE}, x AS (SELECT item_id, doc_id, round(2 * max(part), 9) AS mx, round(sum(part), 9) AS sm FROM o GROUP BY ALL),
g AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY mx DESC, doc_id) AS rf, row_number() OVER (PARTITION BY item_id ORDER BY sm DESC, doc_id) AS rs FROM x),
h AS (SELECT item_id, doc_id, CASE WHEN rf <= 30 THEN rf END AS rf, CASE WHEN rs <= 30 THEN rs END AS rs FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rs, doc_id) AS turn FROM h WHERE coalesce(rf, 99) > 20 AND rs <= 20 QUALIFY turn <= 3),
u AS (SELECT item_id, doc_id, CASE WHEN rf <= 17 THEN 0 WHEN rf <= 20 THEN 2 ELSE 4 END AS src, rf AS pos, NULL AS via FROM h WHERE rf IS NOT NULL
      UNION ALL SELECT item_id, doc_id, 1, rs, 'sum' FROM l
      UNION ALL SELECT item_id, doc_id, 3, rs, 'sum' FROM h WHERE rs IS NOT NULL AND coalesce(rf, 99) > 20 AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM l)),
b AS (SELECT * FROM u WHERE item_id IN (SELECT item_id FROM l) OR src IN (0, 2) QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY src, pos) = 1)
SELECT item_id AS entity_id, row_number() OVER (PARTITION BY item_id ORDER BY src, pos, doc_id) AS final_rank, doc_id, via AS rescued_via FROM b QUALIFY final_rank <= 20"""
)
def shortlist_rescue(spark, d):
    hits = arm_hits(spark, d)
    rank = lambda df: rt.top_k(df, ["entity_id"], [F.desc("score"), "doc_id"], 30).select("entity_id", "doc_id", "rank")
    return rk.rescue(rank(rt.fuse_arms(hits, "max")), rank(rt.fuse_arms(hits, "sum", max_blend=0.0)), 20, 3)


@query(
    f"""WITH {_SCORES}, g AS (SELECT item_id, doc_id, rank FROM ar WHERE rank <= 50), s AS (SELECT item_id, doc_id, rank FROM br WHERE rank <= 20)
SELECT coalesce(g.item_id, s.item_id) AS entity_id, coalesce(g.doc_id, s.doc_id) AS doc_id, g.rank AS merged_rank, s.rank AS summed_rank, CASE WHEN s.rank IS NOT NULL THEN 'summed' ELSE 'merged' END AS deepest FROM g FULL JOIN s ON g.item_id = s.item_id AND g.doc_id = s.doc_id"""
)
def stage_ranks(spark, d):
    hits = arm_hits(spark, d)
    rank = lambda df, k: rt.top_k(df, ["entity_id"], [F.desc("score"), "doc_id"], k)
    return rk.stage_ranks({"merged": rank(rt.fuse_arms(hits), 50), "summed": rank(rt.fuse_arms(hits, "sum", max_blend=0.0), 20)}, ["entity_id", "doc_id"])


@query(
    f"""WITH {bm25_sql('benchmark', 'item_id', 20)}, r AS (SELECT item_id, rank, hit.doc_id, source, lang FROM hit JOIN documents USING (doc_id)),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY rank) = 1), two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY item_id, lang ORDER BY rank) = 1)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS new_rank FROM two QUALIFY new_rank <= 3"""
)
def unique_ranked(spark, d):
    rows = bm25_top(spark, d).withColumnRenamed("query_id", "item_id").join(docs(spark, d).select("doc_id", "source", "lang"), "doc_id")
    return rk.unique_ranked(rows.select("item_id", "rank", "doc_id", "source", "lang"), "item_id", "source", "lang", "rank", 3)


@query(
    """WITH g AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 50 = 0), """
    + _V
    + """, h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
gold AS (SELECT g.vec_id AS query_id, e.vec_id AS doc_id FROM g JOIN embeddings e USING (label) WHERE e.vec_id != g.vec_id)
SELECT count(*) AS n_gold, count(rank) AS n_found, round_even(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round_even(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round_even(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr FROM gold LEFT JOIN h USING (query_id, doc_id)"""
)
def recall_and_mrr(spark, d):
    every, asked = vectors(spark, d)
    gold = asked.select(F.col("vec_id").alias("query_id"), "label").join(every.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("query_id != doc_id").select("query_id", "doc_id")
    return ev.recall_and_mrr(gold, dense_top10(spark, d), ["query_id", "doc_id"], [5, 10])


CONFIGS = [(f"{m}-{k}-{n}", m, k, n) for k in (10, 30, 60) for m, n in (("sum", 3), ("max", 3), ("log_dampened", 3), ("top_k_sum", 2), ("top_k_sum", 3), ("top_k_sum", 5))]


@query(
    f"""WITH {ARM_HITS_SQL}, cfg(config, mode, k, n) AS (VALUES {", ".join(str(c) for c in CONFIGS)}),
p AS (SELECT config, mode, cfg.n, item_id, doc_id, query_index, rank, weight / (k + rank) AS part FROM hit, cfg),
o AS (SELECT *, row_number() OVER (PARTITION BY config, item_id, doc_id ORDER BY part DESC, rank, query_index) AS place FROM p),
x AS (SELECT config, item_id, doc_id, round(max(part) + CASE mode WHEN 'sum' THEN sum(part) WHEN 'max' THEN max(part) WHEN 'top_k_sum' THEN sum(part) FILTER (place <= n) ELSE sum(part) * ln(1.0 + count(*)) / ln(2.0) / count(*) END, 9) AS score FROM o GROUP BY config, mode, item_id, doc_id),
r AS (SELECT config, item_id, doc_id, row_number() OVER (PARTITION BY config, item_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 10),
wq AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
ws AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (tot.n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)))), 6) AS score FROM wq JOIN dfs USING (term) JOIN post USING (term), tot GROUP BY ALL),
gold AS (SELECT item_id, doc_id FROM ws WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 3)
SELECT config, count(*) AS n_gold, count(rank) AS n_found, round_even(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_1, round_even(count(*) FILTER (rank <= 3) / count(*), 6) AS recall_3, round_even(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10,
round_even(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr FROM gold CROSS JOIN (SELECT config FROM cfg) LEFT JOIN r USING (config, item_id, doc_id) GROUP BY config"""
)
def fusion_sweep(spark, d):
    """The 18 settings of three constants, four modes and, for the capped one, three numbers of arms."""
    gold = bm25_top(spark, d, 3).select(F.col("query_id").alias("entity_id"), "doc_id")
    return ev.sweep(arm_hits(spark, d), gold, CONFIGS, [1, 3, 10])
