"""Queries of carried state, hash trees, projections and per-entity output over orders, lineitem, part, events, documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.operators import incremental as inc
from braidmark.operators import ranking as rk
from braidmark.operators import records as rc
from braidmark.operators import structure as st
from braidmark.operators import texts as tx
from braidmark.operators import verdicts as vd
from braidmark.plans.book import Book
from braidmark.plans.rollup_queries import embed_sides
from braidmark.session import checkpoint_dir, table
from braidmark.sources import tables as src

BOOK = Book()
query = BOOK.query

_KEY = "regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]', '', 'g')"


@query(
    f"""WITH RECURSIVE k AS (SELECT l_orderkey AS doc, l_linenumber AS line_no, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2), p AS (SELECT p_partkey AS pk, {_KEY} AS k FROM part),
l AS (SELECT doc, line_no, p.k, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS n FROM k LEFT JOIN p USING (pk)), b AS (SELECT doc, pk, row_number() OVER (PARTITION BY doc ORDER BY pk) - 1 AS spot FROM (SELECT DISTINCT doc, pk FROM k)),
m AS (SELECT l.doc, n, l.k = p.k AS same, coalesce(list_max(list_filter(range(1, least(length(l.k), length(p.k)) + 1), lambda i: left(l.k, i) = left(p.k, i))), 0) AS shared, spot FROM l JOIN b ON b.doc = l.doc JOIN p ON p.pk = b.pk),
c AS (SELECT doc, n, list({{'same': same, 'shared': shared, 'near': -spot}} ORDER BY same, shared, -spot) AS c FROM m WHERE same OR shared >= 12 GROUP BY 1, 2),
w AS (SELECT doc, 0::BIGINT AS n, NULL::BIGINT AS line_no, -1::BIGINT AS cur FROM l GROUP BY 1
UNION ALL SELECT w.doc, l.n, l.line_no, coalesce(-(list_filter(c, lambda x: -x.near > cur AND -x.near <= cur + 3)[-1]).near, cur) FROM w JOIN l ON l.doc = w.doc AND l.n = w.n + 1 LEFT JOIN c ON c.doc = l.doc AND c.n = l.n)
SELECT doc, line_no, CASE WHEN cur >= 0 THEN cur END AS block FROM w WHERE n > 0"""
)
def steps_in_blocks(spark, d):
    """An order's lines as body, its parts by number as blocks."""
    name = F.concat_ws(" ", "p_name", "p_type")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no")).agg(F.min("l_partkey").alias("p_partkey"))
    titled = lines.join(table(spark, d, "part").select("p_partkey", name.alias("line")), "p_partkey", "left")
    blocks = titled.select("doc", "p_partkey", F.col("line").alias("title")).distinct().withColumn("block", F.row_number().over(W.partitionBy("doc").orderBy("p_partkey")) - 1)
    return st.attached_steps(titled.select("doc", "line_no", "line"), blocks.select("doc", "block", "title"))


_HEX = ", ".join(f"sum(('0x' || substr(l, {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16, 31, 46))


@query(
    f"""WITH r AS (SELECT substr(sha256('=' || doc_id), 1, 4) AS node, sha256(length(doc_id::VARCHAR) || ':' || doc_id || ':' || sha256(coalesce(text, ''))) AS l FROM documents),
a AS (SELECT 2 AS level, node, sha256(concat_ws(',', {_HEX}, count(*)::VARCHAR)) AS hash, count(*) AS n_rows FROM r GROUP BY node),
b AS (SELECT 1 AS level, substr(node, 1, 2) AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash, sum(n_rows)::BIGINT AS n_rows FROM a GROUP BY substr(node, 1, 2)),
c AS (SELECT 0 AS level, '' AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash, sum(n_rows)::BIGINT AS n_rows FROM b HAVING count(*) > 0)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def corpus_hash_tree(spark, d):
    return inc.hash_tree(table(spark, d, "documents").select("doc_id", inc.content_hash(F.col("text")).alias("h")), "doc_id", "h")


@query(
    """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, lang AS model FROM documents), b AS (SELECT item_id AS doc_id, sha256(coalesce(text, '')) AS h, 'en' AS model FROM benchmark
UNION ALL SELECT doc_id, sha256(coalesce(text, '')), lang FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT item_id FROM benchmark))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'prune' ELSE 'embed' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE NOT coalesce(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.h = b.h AND a.model IS NOT DISTINCT FROM b.model, false)"""
)
def changed_by_hash_tree(spark, d):
    """embed_plan without its skipped rows, by the difference of two trees."""
    corpus, index = embed_sides(spark, d)
    return inc.changed_keys(corpus, index, "doc_id", ["h", "model"])


@query()
def verbatim_quotes(spark, d):
    """Sentences of a conversation's answers as quotes of the lines of all that was asked; similarity has no SQL (brute force in the tests)."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("block"), "role", "text")
    asked = c.filter("role = 'user'").select("entity_id", "block", F.posexplode(F.split("text", r"\n")).alias("i", "line"))
    lines = asked.select("entity_id", (F.col("block") * 100000 + F.col("i")).alias("line_no"), "line", "block")
    said = c.filter("role = 'assistant'").select("entity_id", "block", F.posexplode(F.split("text", r"[.!?\n]")).alias("i", "quote"))
    quotes = said.select("entity_id", (F.col("block") * 100000 + F.col("i")).alias("at"), F.trim("quote").alias("quote"), "block").filter("quote != ''")
    return rc.verbatim(quotes, lines).select("entity_id", "at", "source_line")


_POOL = "p AS (SELECT l_orderkey AS entity_id, l_partkey AS doc_id, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS rrf_rank, round(sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {_POOL}, n AS (SELECT entity_id, count(rrf_rank) >= greatest(3, floor(count(*) / 4)) AS stored FROM p GROUP BY 1)
SELECT entity_id, doc_id, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN stored THEN rrf_rank END, CASE WHEN NOT stored THEN score END DESC, doc_id) AS sum_rank FROM p JOIN n USING (entity_id) WHERE NOT stored OR rrf_rank IS NOT NULL"""
)
def stored_or_rebuilt_ranks(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("doc_id"))
    pool = li.agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("rrf_rank"), F.round(F.sum("l_quantity"), 6).alias("score"))
    return rk.sum_ranks(pool.select("entity_id", "doc_id", "rrf_rank"), pool.select("entity_id", "doc_id", "score"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS new_index FROM events QUALIFY new_index <= 24")
def first_events_by_priority(spark, d):
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return rk.first_by_priority(table(spark, d, "events"), "user_id", [priority, "event_id"], 24).select("user_id", "event_id", "event_type", "new_index")


@query("WITH s AS (SELECT l_orderkey AS entity_id, list_distinct(list(l_partkey % 16)) AS claimed, list_distinct(coalesce(list(l_partkey % 16) FILTER (l_returnflag = 'R'), [])) AS covered FROM lineitem GROUP BY 1) SELECT entity_id, array_to_string(list_sort(list_filter(claimed, lambda x: NOT list_contains(covered, x))), ',') AS uncovered FROM s")
def uncovered_claims(spark, d):
    """Classes of an order's parts that none of its returned lines has."""
    of = F.col("l_partkey") % 16
    sides = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.collect_set(of).alias("claimed"), F.collect_set(F.when(F.col("l_returnflag") == "R", of)).alias("covered"))
    return sides.select("entity_id", F.array_join(vd.uncovered(F.col("claimed"), F.col("covered")), ",").alias("uncovered"))


@query("SELECT c_custkey AS entity_id, concat_ws(chr(10), nullif(trim(c_name), ''), nullif(trim(c_mktsegment), ''), nullif(trim(n_name), '')) AS text FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def query_texts(spark, d):
    met = table(spark, d, "customer").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    return met.select(F.col("c_custkey").alias("entity_id"), tx.query_text(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("text"))


_CANDIDATES = "SELECT l_orderkey AS entity_id, l_linenumber AS rank, l_partkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'sum' END AS rescued_via, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS rescued_from FROM lineitem"


@query(
    f"""WITH c AS ({_CANDIDATES}) SELECT entity_id, rank, doc_id, '{{"entity_id":' || entity_id || ',"rank":' || rank || ',"doc_id":' || doc_id || coalesce(',"rescued_via":"' || rescued_via || '"', '') || coalesce(',"rescued_from":' || rescued_from, '') || '}}' AS payload FROM c"""
)
def candidate_payloads(spark, d):
    back = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("doc_id"), F.lit("text").alias("text"), F.array(F.lit(1)).alias("arm_hits"), F.when(back, "sum").alias("rescued_via"), F.when(back, F.col("l_suppkey")).alias("rescued_from")
    )
    return tx.candidate_output(rows).select("entity_id", "rank", "doc_id", "payload")


@query("SELECT l_orderkey AS key, l_linenumber AS line, coalesce(o_orderstatus, l_linestatus) AS status, coalesce(o_custkey, l_suppkey) AS owner, o_orderpriority AS priority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def identity_stamps(spark, d):
    drafts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("owner"))
    entities = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("priority"))
    return tx.stamped(drafts, entities, "key", ["status", "owner", "priority"])


_TABLES = "t AS (SELECT l_orderkey AS doc, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, 1 + (l_partkey % 2) AS n_cols, l_returnflag AS a, l_linestatus AS b FROM lineitem)"


def _tables(spark, d):
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    wide = F.col("l_partkey") % 2 == 1
    cells = F.when(wide, F.array(F.array("l_returnflag", "l_linestatus"))).otherwise(F.array(F.array("l_returnflag"), F.array("l_linestatus")))
    tables = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), seq.alias("seq"), F.when(wide, 2).otherwise(1).alias("n_cols"), cells.alias("cells"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.dayofmonth("o_orderdate") % 4).alias("page"), F.lit(1).alias("seq"), F.col("o_orderpriority").alias("text"))
    return tx.table_lines(tables, lines)


@query(f"WITH {_TABLES} SELECT doc, page, seq, a || '|' || b AS cells FROM t WHERE n_cols = 2")
def genuine_tables(spark, d):
    return _tables(spark, d)[0].select("doc", "page", "seq", F.array_join(F.flatten("cells"), "|").alias("cells"))


@query(
    f"""WITH {_TABLES}, u AS (SELECT doc, page, 1 AS kind, seq, 0 AS spot, a AS text FROM t WHERE n_cols = 1 UNION ALL SELECT doc, page, 1, seq, 1, b FROM t WHERE n_cols = 1 UNION ALL SELECT o_orderkey, day(o_orderdate) % 4, 0, 1, 0, o_orderpriority FROM orders)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page = 0, page, kind, seq, spot) AS line_no, page, text FROM u"""
)
def lines_with_single_columns(spark, d):
    """One-column tables among an order's lines, page 0 last."""
    return _tables(spark, d)[1]


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS entity_id, l_linenumber AS rank, l_partkey AS doc_id FROM lineitem) SELECT entity_id, rank, doc_id, CASE WHEN p_size < 15 THEN trim(p_name) WHEN p_size < 35 THEN trim(p_type) ELSE trim(p_brand) END AS text FROM r LEFT JOIN part ON p_partkey = doc_id WHERE rank <= 5"""
)
def top_rows_with_text(spark, d):
    size = F.col("p_size")
    documents = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.when(size < 15, F.col("p_name")).otherwise(" ").alias("raw_text"), F.when(size.between(15, 34), F.col("p_type")).alias("competency"), F.concat_ws("\n", "p_brand", "p_name").alias("embed_text")
    )
    ranked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("doc_id")).distinct()
    return tx.top_rows(ranked, documents, 5).select("entity_id", "rank", "doc_id", "text")


@query("SELECT p_partkey AS doc_id, concat_ws(': ', p_brand, p_name) AS text FROM part WHERE p_partkey NOT IN (SELECT floor(p_partkey / 7) FROM part WHERE p_partkey > 0) AND p_type NOT LIKE 'ECONOMY%'")
def leaves_for_retrieval(spark, d):
    """Parts as a tree in which each but the first hangs under the seventh of its number; economy types aren't alignable."""
    level = F.when(F.col("p_type").startswith("ECONOMY"), "domain").otherwise("standard")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 7)).alias("parent"), level.alias("level"), "p_brand", "p_name")
    return src.corpus_for_retrieval(rows, F.concat_ws(": ", "p_brand", "p_name")).select("doc_id", "text")


@query("WITH r AS (SELECT l_returnflag AS flag, l_orderkey AS entity_id, l_linenumber AS rank, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT flag, entity_id, rank, CASE WHEN flag = 'R' THEN -n ELSE n END AS n FROM r")
def output_by_entity(spark, d):
    """Rows written to a folder for each flag, one of which is then replaced and the others left."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/by-entity-{uuid.uuid4().hex}"
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    src.write_by_entity(rows, path, "flag")
    src.write_by_entity(rows.filter("flag = 'R'").withColumn("n", -F.col("n")), path, "flag")
    return spark.read.schema("entity_id long, rank long, n long, flag string").parquet(path).select("flag", "entity_id", "rank", "n")
