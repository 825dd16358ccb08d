"""Drafts, reports, hierarchy and candidate queries over lineitem, part, nation and benchmark hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import hierarchy as hi
from braidmark.operators import retrieval as rt
from braidmark.operators import texts as tx
from braidmark.operators import verdicts as vd
from braidmark.plans import retrieval_queries as rq
from braidmark.plans.book import Book
from braidmark.plans.catalog_queries import ROWS, rows
from braidmark.plans.rollup_queries import _TREE
from braidmark.session import table

BOOK = Book()
query = BOOK.query


@query(f"WITH {ROWS} SELECT * EXCLUDE (title, doc_text) FROM rws WHERE status IN ('full', 'partial') AND grounded")
def filtered_report(spark, d):
    kept, _ = vd.filtered_report(rows(spark, d), ["full", "partial"], True)
    return kept.drop("title", "doc_text")


@query(f"WITH {ROWS} SELECT count(*) FILTER (status = 'full') AS all_full, count(*) FILTER (status = 'partial') AS all_partial, count(*) FILTER (status = 'none') AS all_none, count(*) FILTER (status = 'none') AS filtered_by_status, count(*) FILTER (status != 'none' AND NOT grounded) AS filtered_ungrounded, count(*) FILTER (status != 'none' AND grounded) AS row_count FROM rws")
def filtered_report_counts(spark, d):
    return vd.filtered_report(rows(spark, d), ["full", "partial"], True)[1]


@query(
    """SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey::VARCHAR ELSE 'f' || l_suppkey END AS resource_id, l_partkey::VARCHAR AS standard_code, 'full' AS matched_status, l_tax > 0.05 AS needs_review, '' AS review_reason, 'high' AS confidence, l_discount < 0.05 AS grounded, l_returnflag AS evidence, l_linenumber AS evidence_page, '' AS rationale,
'' AS standard_raw_text, '' AS judge_model, '' AS prompt_version, l_quantity > 40 AS escalated, l_discount AS rerank_score, l_tax AS rrf_score, l_tax + 1 AS dense_score, l_tax + 2 AS bm25_score, l_linenumber AS dense_rank, l_linenumber + 1 AS bm25_rank, CASE WHEN l_linenumber > 3 THEN true ELSE false END AS coverage_pass, '' AS grounding_note, '' AS input_scope_caveat FROM lineitem"""
)
def flat_report(spark, d):
    n = F.col("l_linenumber")
    meta = F.struct(F.col("l_discount").alias("rerank_score"), F.col("l_tax").alias("rrf_score"), (F.col("l_tax") + 1).alias("dense_score"), (F.col("l_tax") + 2).alias("bm25_score"), n.alias("dense_rank"), (n + 1).alias("bm25_rank"), F.when(n > 3, True).alias("coverage_pass"))
    v = table(spark, d, "lineitem").select(
        F.when(n % 2 == 0, F.col("l_orderkey").cast("string")).alias("resource_id"), F.concat(F.lit("f"), "l_suppkey").alias("file_id"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("standard_code"), F.lit("full ").alias("matched_status"),
        (F.col("l_tax") > 0.05).alias("needs_review"), F.lit("high").alias("confidence"), F.col("l_returnflag").alias("evidence"), meta.alias("retrieval"), (F.col("l_discount") < 0.05).alias("grounded"), n.alias("evidence_page"), (F.col("l_quantity") > 40).alias("escalated"),
    )
    return vd.flat_report(v)


@query(f"WITH {ROWS}, r AS (SELECT entity_id, count(*) AS n, count(*) FILTER (status = 'full') AS n_full, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'none') AS n_none, round_even(count(*) FILTER (status != 'none' AND grounded) / nullif(count(*) FILTER (status != 'none'), 0), 6) AS grounding_rate FROM rws GROUP BY 1) SELECT entity_id, 1 AS expected, coalesce(n, 0) AS n, n_full, n_partial, n_none, grounding_rate, 0 AS failed, coalesce(n, 0) = 1 AS complete FROM ent LEFT JOIN r USING (entity_id)")
def run_completeness(spark, d):
    v = rows(spark, d)
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"))
    return vd.with_completeness(vd.report(v, "entity_id", "status", "grounded"), expected, v.limit(0).select("entity_id"), "entity_id")


@query(f"WITH {ROWS} SELECT id, needs_review OR status = 'partial' OR grounded OR (status != 'none' AND trim(evidence) = '') OR (status = 'full' AND i % 3 = 0) AS escalates FROM rws")
def escalations(spark, d):
    v = rows(spark, d)
    clauses = F.when(F.col("i") % 3 == 0, F.array(F.struct(F.lit(False).alias("met")))).otherwise(F.array(F.struct(F.lit(True).alias("met"))))
    confidence = F.when(F.col("grounded"), "medium").otherwise("high")
    return v.select("id", vd.escalates(F.col("status"), confidence, F.col("needs_review"), F.col("evidence"), clauses).alias("escalates"))


@query(
    """WITH c AS (SELECT l_orderkey AS k, CASE min(l_returnflag) WHEN 'A' THEN 'partial' WHEN 'N' THEN 'none' ELSE 'full' END AS alignment, min(l_tax) < 0.02 AS nr, count(*) FILTER (l_linestatus = 'O') AS met, count(*) AS n, (list(CASE WHEN l_quantity > 25 THEN 'quote ' || l_partkey ELSE ' ' END ORDER BY l_linenumber, l_partkey)) AS q FROM lineitem GROUP BY 1),
f AS (SELECT *, CASE WHEN alignment = 'none' THEN [] ELSE list_filter(list_transform(q, lambda x: trim(x)), lambda x: x != '') END AS e FROM c) SELECT k, alignment AS status, coalesce(e[1], '') AS evidence, len(e) AS candidates, CASE WHEN nr THEN 'low' ELSE 'high' END AS confidence, CASE WHEN nr THEN 'unsure' ELSE 'alignment=' || alignment END AS rationale, met, n - met AS unmet, k % 9 AS evidence_page FROM f"""
)
def mapped_drafts(spark, d):
    quote = F.when(F.col("l_quantity") > 25, F.concat(F.lit("quote "), "l_partkey")).otherwise(" ")
    clause = F.struct("l_linenumber", "l_partkey", F.lit("c").alias("clause"), F.when(F.col("l_linestatus") == "O", "met").otherwise("partially_met").alias("judgment"), F.lit("").alias("why"), quote.alias("student_quote"))
    flag = F.min("l_returnflag")
    drafts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(flag == "A", "partial").when(flag == "N", "none").otherwise("full").alias("alignment"), (F.min("l_tax") < 0.02).alias("needs_review"), F.array_sort(F.collect_list(clause)).alias("clauses"))
    drafts = drafts.withColumns({"evidence": F.lit(" "), "review_reason": F.when(F.col("needs_review"), "unsure").otherwise(""), "location": F.concat(F.lit("Opening A, Page "), F.col("k") % 9)})
    out = vd.draft_of(drafts)
    met = F.size(F.filter("clauses", lambda c: c["met"]))
    partly = F.size(F.filter("clauses", lambda c: ~c["met"] & (c["note"] == "partially met")))
    return out.select("k", "status", "evidence", F.size("evidence_candidates").alias("candidates"), "confidence", "rationale", met.alias("met"), partly.alias("unmet"), "evidence_page")


_FAMS = "fam(turn, family, pattern, codes) AS (VALUES (0, 'first', 'the', [1, 2, 3]), (1, 'second', 'der|les', [2, 900, 10]))"


@query(f"WITH {_FAMS}, {rq.bm25_sql('benchmark', 'item_id', 20)}, x AS (SELECT item_id, turn, family, unnest(codes) AS doc_id, unnest(range(0, len(codes))) AS pos FROM benchmark, fam WHERE regexp_matches(text, pattern)), n AS (SELECT * FROM x WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM hit) AND doc_id IN (SELECT doc_id FROM documents)), m AS (SELECT item_id, doc_id, min((turn, pos, family)) AS f FROM n GROUP BY 1, 2) SELECT item_id AS entity_id, doc_id, f[3] AS family, row_number() OVER (PARTITION BY item_id ORDER BY f) AS place FROM m QUALIFY place <= 8".replace("f[3]", "(SELECT any_value(family) FROM n WHERE n.item_id = m.item_id AND n.doc_id = m.doc_id AND n.turn = struct_extract_at(m.f, 1))"))
def coverage_extras(spark, d):
    return _extras(spark, d)[1]


def _extras(spark, d):
    hits = rq.bm25_top(spark, d).withColumnRenamed("query_id", "entity_id")
    texts = rq.items(spark, d).select(F.col("item_id").alias("entity_id"), "text")
    return hits, vd.add_families(hits, texts, [("first", "the", [1, 2, 3]), ("second", "der|les", [2, 900, 10])], rq.docs(spark, d))


_EXTRAS_SQL = BOOK.sql["coverage_extras"]


@query(f"WITH {rq.bm25_sql('benchmark', 'item_id', 20)}, ex AS ({_EXTRAS_SQL}), head AS (SELECT item_id AS entity_id, doc_id, rank AS spot, false AS coverage_pass FROM hit WHERE rank <= 10), u AS (SELECT * FROM head UNION ALL SELECT entity_id, doc_id, place + 10, true FROM ex WHERE (entity_id, doc_id) NOT IN (SELECT (entity_id, doc_id) FROM head)) SELECT entity_id, doc_id, coverage_pass, row_number() OVER (PARTITION BY entity_id ORDER BY spot, doc_id) AS rank FROM u")
def judged_candidates(spark, d):
    hits, extras = _extras(spark, d)
    return vd.judged_set(hits, extras, 10)


@query("SELECT doc_id, CASE WHEN length(x) >= 40 AND len(w) >= 5 THEN array_to_string(w[1:12], ' ') END AS key FROM (SELECT doc_id, x, list_filter(string_split(x, ' '), lambda y: length(y) > 1) AS w FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(translate(text, '‘’“”–— ', '''''\"\"-- ')), '_''\"', '   '), '(^|\\n)\\s*-\\s*', '\\1 ', 'g'), '\\s+', ' ', 'g')) AS x FROM documents))")
def evidence_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", vd.evidence_key(F.col("text")).alias("key"))


@query(f"WITH {ROWS}, s AS (SELECT doc_id, status, count(*) AS n FROM rws GROUP BY 1, 2), g AS (SELECT doc_id, sum(n)::BIGINT AS group_size, count(*) > 1 AS conflict, CASE WHEN count(*) > 1 AND 2 * max(n) > sum(n) THEN arg_max(status, (n, status)) END AS majority FROM s GROUP BY 1) SELECT id, needs_review OR conflict AS needs_review, CASE WHEN conflict THEN concat_ws('; ', nullif(trim(review_reason), ''), 'cross-lesson inconsistency: ' || doc_id || CASE WHEN majority IS NOT NULL THEN '; reconciled→' || majority ELSE '' END) ELSE review_reason END AS review_reason, CASE WHEN conflict THEN 'low' ELSE 'high' END AS confidence, CASE WHEN conflict AND status != coalesce(majority, status) THEN '[P3 CONSISTENCY: was ' || status || ', aligned to ' || majority || ']' END AS consistency_note FROM rws JOIN g USING (doc_id)")
def flagged_conflicts(spark, d):
    v = rows(spark, d).withColumn("confidence", F.lit("high"))
    return vd.flag_conflicts(vd.reconcile(v, ["doc_id"]), "doc_id").select("id", "needs_review", "review_reason", "confidence", "consistency_note")


@query("SELECT o_orderkey, o_orderpriority AS text, 'ok' AS state FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL, 'blank' FROM orders WHERE o_custkey % 3 = 1 UNION ALL SELECT o_orderkey, NULL, 'missing' FROM orders WHERE o_custkey % 3 = 2")
def loaded_and_failed(spark, d):
    o, kind = table(spark, d, "orders"), F.col("o_custkey") % 3
    texts = o.filter(kind < 2).select("o_orderkey", F.when(kind == 0, F.col("o_orderpriority")).otherwise(" ").alias("text"))
    good, bad = vd.loaded_and_failed(o.select("o_orderkey"), texts, "o_orderkey", "text")
    return good.withColumn("state", F.lit("ok")).unionByName(bad.select("o_orderkey", F.lit(None).cast("string").alias("text"), F.col("reason").alias("state")))


@query(f"WITH {_TREE} SELECT a.id AS node, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS children FROM t a LEFT JOIN t b ON b.parent = a.id GROUP BY 1")
def tree_children(spark, d):
    return hi.children_of(rq.tree(spark, d), "id", "parent").withColumn("children", F.array_join("children", ","))


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT id, parent, id AS node, ''::VARCHAR AS path, 0 AS depth FROM t UNION ALL SELECT t.id, t.parent, p.node, t.id || '/' || p.path, p.depth + 1 FROM p JOIN t ON p.parent = t.id) SELECT node, path, depth FROM p WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)")
def tree_paths(spark, d):
    out = hi.paths(rq.tree(spark, d), "id", "parent")
    return out.select("node", F.concat(F.array_join("path", "/"), F.when(F.col("depth") > 0, "/").otherwise("")).alias("path"), "depth")


@query(f"WITH {_TREE}, k AS (SELECT parent, string_agg(upper(id), ',' ORDER BY id) AS c FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT a.id AS node, upper(a.id) AS label, concat_ws(',', upper(c.id), upper(b.id)) AS ancestors, coalesce(k.c, '') AS children FROM t a LEFT JOIN t b ON b.id = a.parent LEFT JOIN t c ON c.id = b.parent LEFT JOIN k ON k.parent = a.id")
def tree_context(spark, d):
    nodes = rq.tree(spark, d).withColumn("label", F.upper("id"))
    out = hi.context(nodes, "id", "parent", "label")
    return out.select("node", "label", F.array_join("ancestor_labels", ",").alias("ancestors"), F.array_join("child_labels", ",").alias("children"))


@query("WITH t AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN n_regionkey + 100 WHEN n_regionkey = 3 THEN 999 END AS parent FROM nation UNION ALL SELECT r_regionkey + 100, NULL FROM region) SELECT id, parent FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)")
def tree_roots(spark, d):
    key = F.col("n_regionkey")
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(key < 3, key + 100).when(key == 3, 999).alias("parent"))
    nodes = nodes.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.lit(None).cast("int").alias("parent")))
    return hi.roots(nodes, "id", "parent").select("id", "parent")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS label, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'a.b: ' || p_name ELSE p_name END AS body FROM part")
def split_labels(spark, d):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat("p_brand", F.lit(": "), "p_name")).when(size % 3 == 1, F.concat(F.lit("a.b: "), "p_name")).otherwise(F.col("p_name"))
    return hi.split_label(table(spark, d, "part").withColumn("text", text), "text").select("p_partkey", "label", "body")


@query(f"WITH {rq.bm25_sql('benchmark', 'item_id', 20)}, k AS (SELECT item_id, doc_id, score FROM hit JOIN documents USING (doc_id) WHERE lang = 'en') SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM k")
def allowed_hits(spark, d):
    return rt.allowed_hits(rq.bm25_top(spark, d), rq.docs(spark, d).filter("lang = 'en'"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND (source = 'src1' OR source IS NULL)")
def scorable_of_grade(spark, d):
    return rt.of_grade_or_error(rt.scorable(rq.docs(spark, d), "lang", ("en", "fr")), "source", "src1").select("doc_id")


@query("SELECT l_orderkey AS entity_id, l_partkey AS doc_id, l_linenumber AS dense_rank, l_tax AS dense_score, coalesce(CASE WHEN l_linenumber > 4 THEN true END, false) AS coverage_pass FROM lineitem")
def retrieval_meta(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("dense_rank"), F.col("l_tax").alias("dense_score"), F.when(F.col("l_linenumber") > 4, True).alias("coverage_pass"))
    return tx.retrieval_meta(c, ["dense_rank", "dense_score"]).select("entity_id", "doc_id", "retrieval.*")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'GA' WHEN p_size % 3 = 1 THEN 'TX' END AS state, CASE WHEN p_size % 2 = 0 THEN DATE '2024-01-01' + p_size END AS run_date FROM part")
def dimension_columns(spark, d):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, "Georgia Standards").when(size % 3 == 1, "texas TEKS").otherwise("Other")
    run = F.when(size % 2 == 0, F.concat(F.lit("run-"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), size), "yyyyMMdd"), F.lit("-x"))).otherwise("run-123456789")
    return tx.dimensions(table(spark, d, "part").select("p_partkey", name.alias("f"), run.alias("r")), "f", "r", {"Georgia": "GA", "Texas": "TX"}).select("p_partkey", "state", "run_date")


@query("WITH p AS (SELECT 'G' || p_size % 3 || 'M1U1L1' AS code, p_partkey, p_size FROM part) SELECT p_partkey || code AS code, 'span_order' AS rule, '10-' || p_size AS detail FROM p WHERE p_size < 10 UNION ALL SELECT p_partkey || code, 'id_parts', p_partkey || 'G1M1U1L1' FROM p WHERE p_size % 3 != 1 UNION ALL SELECT p_partkey || code, 'unknown_action', 'jump' FROM p WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey || code, 'unsupported_action', CASE WHEN p_size % 5 = 0 THEN 'jump,oral_production' ELSE 'oral_production' END FROM p WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey || code, 'unsupported_action', 'jump' FROM p WHERE p_size % 2 = 1 AND p_size % 5 = 0 UNION ALL SELECT p_partkey || code, 'ragged_table', '' FROM p WHERE p_size % 7 = 0".replace("p_partkey || code AS code", "code || '-' || p_partkey AS code").replace("p_partkey || code,", "code || '-' || p_partkey,").replace("p_partkey || 'G1M1U1L1'", "'G1M1U1L1-' || p_partkey"))
def record_violations(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    tail = F.concat(F.lit("1-"), key)
    actions = F.map_concat(F.create_map(F.lit("oral_production"), F.lit("say it")), F.when(size % 5 == 0, F.create_map(F.lit("jump"), F.lit("up"))).otherwise(F.create_map().cast("map<string,string>")))
    cell = F.array(F.lit("a"), F.lit("b"))
    tables = F.array(F.array(cell, F.when(size % 7 == 0, F.array(F.lit("a"))).otherwise(cell)))
    lessons = table(spark, d, "part").select(F.concat(F.lit("G"), size % 3, F.lit("M1U1L"), tail).alias("code"), F.lit(1).alias("grade"), F.lit(1).alias("module"), F.lit(1).alias("unit"), tail.alias("lesson"), F.lit(10).alias("page_start"), size.alias("page_end"), actions.alias("actions"), F.when(size % 2 == 1, F.array(F.lit("oral_production"))).alias("supported"), tables.alias("tables"))
    return tx.record_violations(lessons)
