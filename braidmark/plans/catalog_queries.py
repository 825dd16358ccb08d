"""Catalogue queries: orders are the entities, parts the documents (level by size, parent by brand), lineitem the verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import catalog as cg
from braidmark.operators import rollups as ru
from braidmark.plans.book import Book
from braidmark.plans.rollup_queries import D, decision_log
from braidmark.session import table

BOOK = Book()
query = BOOK.query

ROWS = """ent AS (SELECT o_orderkey AS entity_id, o_orderpriority AS title FROM orders),
doc AS (SELECT p_partkey AS doc_id, p_name AS text, CASE WHEN p_size % 5 = 0 THEN 'domain' WHEN p_size % 2 = 0 THEN 'standard' ELSE 'substandard' END AS level, CASE WHEN p_size > 10 THEN p_partkey // 7 END AS parent FROM part),
rws AS (SELECT l_orderkey || ':' || l_partkey || ':' || l_linenumber AS id, l_orderkey AS entity_id, l_partkey AS doc_id, l_linenumber AS i, CASE l_returnflag WHEN 'R' THEN 'full' WHEN 'A' THEN 'partial' ELSE 'none' END AS status,
 l_linestatus = 'O' AS needs_review, CASE WHEN l_tax < 0.02 THEN 'only a part' ELSE '' END AS review_reason, CASE WHEN l_discount < 0.03 THEN '' ELSE coalesce(p_type, '') END AS evidence, l_discount < 0.08 AS grounded, l_quantity > 45 AS escalated,
 (l_linenumber - 2)::BIGINT AS page, coalesce(nullif(trim(o_orderpriority), ''), l_orderkey::VARCHAR) AS title, coalesce(p_name, '') AS doc_text
 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""


def entities(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("title"))


def documents(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    level = F.when(size % 5 == 0, "domain").when(size % 2 == 0, "standard").otherwise("substandard")
    return table(spark, d, "part").select(key.alias("doc_id"), F.col("p_name").alias("text"), level.alias("level"), F.when(size > 10, F.floor(key / 7)).alias("parent"))


def rows(spark, d):
    li = table(spark, d, "lineitem")
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    status = F.when(F.col("l_returnflag") == "R", "full").when(F.col("l_returnflag") == "A", "partial").when(F.col("l_returnflag") == "N", "no match")
    v = li.join(kinds, "l_partkey", "left").select(
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_partkey").alias("doc_id"),
        F.col("l_linenumber").alias("i"),
        status.alias("status"),
        F.lit("").alias("raw_text"),
        (F.col("l_linestatus") == "O").alias("needs_review"),
        F.when(F.col("l_tax") < 0.02, "only a part").otherwise("").alias("review_reason"),
        F.when(F.col("l_discount") < 0.03, "").otherwise(F.coalesce("p_type", F.lit(""))).alias("evidence"),
        (F.col("l_discount") < 0.08).alias("grounded"),
        (F.col("l_quantity") > 45).alias("escalated"),
        (F.col("l_linenumber") - 2).cast("bigint").alias("page"),
    )
    return cg.alignment_rows(v, entities(spark, d), documents(spark, d))


@query(f"WITH {ROWS} SELECT * FROM rws")
def alignment_rows(spark, d):
    return rows(spark, d)


_LISTED = "SELECT * FROM rws WHERE status = 'partial' AND needs_review AND (contains(lower(evidence), 'st') OR contains(lower(title), 'st') OR contains(lower(doc_text), 'st') OR contains(entity_id::VARCHAR, 'st') OR contains(doc_id::VARCHAR, 'st'))"


@query(f"WITH {ROWS} {_LISTED}")
def alignments_listing(spark, d):
    return cg.listing(rows(spark, d), status="partial", needs_review=True, q="ST")


@query(f"WITH {ROWS}, l AS ({_LISTED}) SELECT id, (SELECT count(*) FROM l) AS total FROM l ORDER BY entity_id, i, doc_id LIMIT 50 OFFSET 100")
def alignments_page(spark, d):
    found = cg.listing(rows(spark, d), status="partial", needs_review=True, q="ST")
    return cg.page_of_rows(found, ["entity_id", "i", "doc_id"], 100, 50).select("id", "total")


@query(f"WITH {ROWS} SELECT id, evidence, status FROM rws WHERE trim(evidence) != '' AND (status != 'none' OR needs_review) AND (contains(lower(evidence), 'a') OR contains(doc_id::VARCHAR, 'a'))")
def evidence_listing(spark, d):
    return cg.evidence_listing(rows(spark, d), "A").select("id", "evidence", "status")


@query(f"WITH {ROWS} SELECT id, status, coalesce(nullif(review_reason, ''), 'Flagged for review') AS review_reason FROM rws WHERE needs_review")
def review_queue(spark, d):
    return cg.review_queue(rows(spark, d)).select("id", "status", "review_reason")


@query(
    f"""WITH {ROWS}, u AS (SELECT 1 AS o, 'Lessons' AS category, entity_id || ' — ' || title AS label FROM ent WHERE contains(lower(title), 'zz') OR contains(entity_id::VARCHAR, 'zz')
UNION ALL SELECT 2, 'Standards', doc_id::VARCHAR FROM doc WHERE contains(doc_id::VARCHAR, 'zz') OR contains(substr(lower(text), 1, 120), 'zz') UNION ALL SELECT 3, 'Evidence', entity_id || ' · ' || doc_id FROM rws WHERE contains(lower(evidence), 'zz'))
SELECT category, label FROM u ORDER BY o, label LIMIT 40""".replace("'zz'", "'an'")
)
def three_source_search(spark, d):
    return cg.search(entities(spark, d), documents(spark, d), rows(spark, d), "an", 40)


_COUNTS = "count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'none') AS \"none\", count(*) FILTER (needs_review) AS review"


@query(f"WITH {ROWS}, c AS (SELECT entity_id, {_COUNTS} FROM rws GROUP BY 1) SELECT ent.entity_id, title, coalesce(\"full\", 0) AS \"full\", coalesce(partial, 0) AS partial, coalesce(\"none\", 0) AS \"none\", coalesce(review, 0) AS review, coalesce(\"full\", 0) + coalesce(partial, 0) AS aligned FROM ent LEFT JOIN c USING (entity_id)")
def entity_details(spark, d):
    return cg.entity_details(entities(spark, d), rows(spark, d))


@query(
    f"""WITH {ROWS}, c AS (SELECT doc_id, count(*) FILTER (status = 'full') AS f, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (needs_review) AS r, list_sort(list(DISTINCT entity_id) FILTER (status != 'none')) AS e FROM rws WHERE status != 'none' OR needs_review GROUP BY 1)
SELECT doc.doc_id, level, coalesce(f, 0) AS "full", coalesce(p, 0) AS partial, coalesce(r, 0) AS review, coalesce(array_to_string(e, ','), '') AS entities, CASE WHEN f > 0 THEN 'covered' WHEN p > 0 THEN 'partial' WHEN r > 0 THEN 'review' ELSE 'not_found' END AS coverage FROM doc LEFT JOIN c USING (doc_id) WHERE level NOT IN ('domain', 'big_idea')"""
)
def standard_coverage(spark, d):
    out = cg.document_coverage(documents(spark, d), rows(spark, d))
    return out.select("doc_id", "level", "full", "partial", "review", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"), "coverage")


_LEAVES = "lf AS (SELECT count(*) AS documents, CASE WHEN count(*) FILTER (level = 'substandard') > 0 THEN count(*) FILTER (level = 'substandard') ELSE count(*) FILTER (doc_id NOT IN (SELECT parent FROM doc WHERE parent IS NOT NULL)) END AS leaves FROM doc)"


@query(f"WITH {ROWS}, {_LEAVES} SELECT * FROM lf")
def project_summary(spark, d):
    return cg.leaf_count(documents(spark, d))


@query(
    f"""WITH {ROWS}, {_LEAVES}, o AS (SELECT count(*) AS alignments, {_COUNTS}, count(*) FILTER (escalated) AS escalated, count(*) FILTER (grounded) AS grounded, count(DISTINCT doc_id) FILTER (status != 'none') AS cited FROM rws)
SELECT o.*, documents, leaves, (SELECT count(*) FROM ent) AS entities, round_even(100 * cited / leaves, 1) AS coverage_pct, round_even(100 * review / alignments, 2) AS review_rate, round_even(100 * escalated / alignments, 2) AS escalation_rate, 'ready' AS readiness, 'Healthy' AS health FROM o, lf"""
)
def overview_metrics(spark, d):
    return cg.overview(rows(spark, d), documents(spark, d), entities(spark, d))


@query(
    """WITH h AS (SELECT DISTINCT l_partkey AS doc_id FROM lineitem), p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE ' ' END AS domain, toxic::BIGINT AS grade FROM labels),
d AS (SELECT doc_id, lang AS domain, n_chars::BIGINT AS grade FROM documents) SELECT h.doc_id, coalesce(nullif(trim(p.domain), ''), d.domain, '') AS domain, CASE WHEN p.doc_id IS NOT NULL THEN p.grade ELSE d.grade END AS grade FROM h LEFT JOIN p USING (doc_id) LEFT JOIN d USING (doc_id)"""
)
def payload_enrichment(spark, d):
    """The index holds the labelled documents; hits may name documents that neither side has."""
    index = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("domain"), F.col("toxic").cast("bigint").alias("grade"))
    disk = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("n_chars").cast("bigint").alias("grade"))
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id")).distinct()
    return cg.with_payload(hits, index, disk, ["domain"])


@query(
    """WITH leaf AS (SELECT c_custkey AS doc_id, n_regionkey AS domain, c_nationkey AS "group" FROM customer JOIN nation ON c_nationkey = n_nationkey), cov AS (SELECT o_custkey AS doc_id, CASE WHEN count(*) > 5 THEN 'covered' ELSE 'partial' END AS coverage FROM orders GROUP BY 1)
SELECT leaf.doc_id, domain, "group", coalesce(coverage, 'not_found') AS coverage, r_name AS domain_label, n_name AS group_label FROM leaf LEFT JOIN cov USING (doc_id) LEFT JOIN region ON r_regionkey = domain LEFT JOIN nation ON n_nationkey = "group" """
)
def leaf_coverage(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    leaves = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.col("n_regionkey").alias("domain"), F.col("c_nationkey").alias("group"))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    coverage = n.select("doc_id", F.when(F.col("n") > 5, "covered").otherwise("partial").alias("coverage"))
    named = lambda df, k, x, c: df.select(F.col(k).alias(c), F.col(x).alias(f"{c}_label"))
    met = cg.leaf_coverage(leaves, coverage, nation.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("label"))).drop("domain_label")
    return met.join(named(region, "r_regionkey", "r_name", "domain"), "domain", "left").select("doc_id", "domain", "group", "coverage", "domain_label", "group_label")


@query(
    f"""WITH {ROWS}, g AS (SELECT o_orderpriority AS kind, count(*) FILTER (status = 'full') AS met, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'none') AS gap, count(*) AS total FROM rws JOIN orders ON o_orderkey = entity_id GROUP BY 1),
p AS (SELECT *, round(100 * met / total)::INTEGER AS m, round(100 * gap / total)::INTEGER AS x FROM g), q AS (SELECT *, greatest(0, m + x - 100) AS over FROM p)
SELECT kind, met, partial, gap, total, m - CASE WHEN m >= x THEN over ELSE 0 END AS met_pct, x - CASE WHEN m >= x THEN 0 ELSE over END AS gap_pct, 100 - (m - CASE WHEN m >= x THEN over ELSE 0 END) - (x - CASE WHEN m >= x THEN 0 ELSE over END) AS partial_pct FROM q"""
)
def coverage_shares(spark, d):
    return cg.shares(rows(spark, d).withColumn("kind", F.col("title")), ["kind"], "status")


@query(f"WITH {ROWS}, g AS (SELECT title, round_even(100.0 * count(*) FILTER (status != 'none') / count(*), 1) AS pct FROM rws GROUP BY 1) SELECT round_even(avg(pct), 6) AS average, count(*) FILTER (pct >= 90) AS high, count(*) FILTER (pct < 75) AS low FROM g")
def national_average(spark, d):
    cells = rows(spark, d).groupBy("title").agg(F.bround(100 * F.count(F.when(F.col("status") != "none", 1)) / F.count(F.lit(1)), 1).alias("pct"))
    return cg.national(cells, "title", "pct")


@query(f"WITH {D}, r AS (SELECT DISTINCT user_id, event_id % 20 AS item FROM events) SELECT r.user_id, r.item, coalesce(CASE WHEN decision != 'pending' THEN decision END, 'pending') AS decision FROM r LEFT JOIN last USING (user_id, item)")
def rows_with_decisions(spark, d):
    log = decision_log(spark, d)
    return cg.with_decisions(log.select("user_id", "item").distinct(), ru.latest_decisions(log, ["user_id", "item"], "at", "decision"), ["user_id", "item"])


@query(f"WITH {ROWS} SELECT entity_id, doc_id, ['none', 'partial', 'full'][max(CASE status WHEN 'full' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END)] AS status, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (page > 0)), ','), '') AS pages, count(*) FILTER (status = 'full') AS n_full FROM rws GROUP BY 1, 2")
def pair_view(spark, d):
    return cg.pair_view(rows(spark, d)).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("WITH p AS (SELECT user_id AS project_id, max(ts) AS last_reviewed, count(*) AS alignments, count(*) FILTER (event_type = 'error') AS review, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'ready' ELSE 'running' END AS readiness FROM events GROUP BY 1) SELECT project_id, alignments, review FROM p WHERE readiness = 'ready' ORDER BY last_reviewed DESC, project_id DESC LIMIT 1")
def latest_ready_project(spark, d):
    n = lambda c: F.count(F.when(F.col("event_type") == c, 1))
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("project_id")).agg(F.max("ts").alias("last_reviewed"), F.count(F.lit(1)).alias("alignments"), n("error").alias("review"), F.when(n("purchase") > 0, "ready").otherwise("running").alias("readiness"))
    return cg.latest_ready(p, ["project_id", "alignments", "review"])


@query("WITH c AS (SELECT DISTINCT 'G1M' || (l_linenumber % 3) || 'U' || (l_suppkey % 7) || 'L' || (l_partkey % 30) AS code FROM lineitem), p AS (SELECT code, regexp_extract(code, 'M(\\d+)', 1)::INTEGER AS module, regexp_extract(code, 'U(\\d+)', 1)::INTEGER AS unit, regexp_extract(code, 'L(\\d+)', 1)::INTEGER AS lesson FROM c) SELECT *, row_number() OVER (PARTITION BY module ORDER BY unit, lesson, code) AS place FROM p")
def natural_lesson_order(spark, d):
    code = F.concat(F.lit("G1M"), F.col("l_linenumber") % 3, F.lit("U"), F.col("l_suppkey") % 7, F.lit("L"), F.col("l_partkey") % 30)
    return cg.natural_order(table(spark, d, "lineitem").select(code.alias("code")).distinct(), "code")
