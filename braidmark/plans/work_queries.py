"""Logs, health, crosswalk, structure, source and evaluation queries over events, lineitem, part, embeddings and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import crosswalk as cw
from braidmark.operators import evaluation as ev
from braidmark.operators import funnel as fu
from braidmark.operators import incremental as inc
from braidmark.operators import logs
from braidmark.operators import ranking as rk
from braidmark.operators import retrieval as rt
from braidmark.operators import structure as st
from braidmark.plans import retrieval_queries as rq
from braidmark.plans.book import Book
from braidmark.plans.structure_queries import _W, _walk
from braidmark.session import table
from braidmark.sources import tables as src

BOOK = Book()
query = BOOK.query

LINES = """ln AS (SELECT user_id AS job_id, event_id AS line_no, CASE event_type WHEN 'signup' THEN '== stage ' || event_id % 5 || ' ==' WHEN 'error' THEN '[' || event_id % 7 || '/9] item' || event_id % 11 || ' Error: code ' || event_id % 3 WHEN 'purchase' THEN 'run cost_usd=' || event_id % 4 || '.25'
WHEN 'click' THEN 'Estimated cost: $' || event_id % 6 || '.5' ELSE '[2/9] item' || event_id % 11 || ' done' END AS text FROM events),
pl AS (SELECT *, nullif(regexp_extract(text, '^=+\\s*(.+?)\\s*=+\\s*$', 1), '') AS header, TRY_CAST(nullif(regexp_extract(text, '(?i)\\bcost_usd=([0-9.]+)', 1), '') AS DOUBLE) AS machine_cost, TRY_CAST(nullif(regexp_extract(text, '(?i)\\best(?:imated)? cost:?\\s*\\$?([0-9.]+)', 1), '') AS DOUBLE) AS estimated_cost,
 TRY_CAST(nullif(regexp_extract(text, '\\[(\\d+)/(\\d+)\\]', 1), '') AS INTEGER) AS done, TRY_CAST(nullif(regexp_extract(text, '\\[(\\d+)/(\\d+)\\]', 2), '') AS INTEGER) AS total, nullif(regexp_extract(text, '\\[\\d+/\\d+\\]\\s+(\\S+)', 1), '') AS item, nullif(lower(regexp_extract(text, '(?i)\\b(error|failed|skip|done|ok|running)\\b', 1)), '') AS item_status FROM ln),
ps AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stage FROM pl)"""


def log_lines(spark, d):
    return log_lines_of(table(spark, d, "events"))


def log_lines_of(events, *more):
    e, i = F.col("event_type"), F.col("event_id")
    text = (
        F.when(e == "signup", F.concat(F.lit("== stage "), i % 5, F.lit(" ==")))
        .when(e == "error", F.concat(F.lit("["), i % 7, F.lit("/9] item"), i % 11, F.lit(" Error: code "), i % 3))
        .when(e == "purchase", F.concat(F.lit("run cost_usd="), i % 4, F.lit(".25")))
        .when(e == "click", F.concat(F.lit("Estimated cost: $"), i % 6, F.lit(".5")))
        .otherwise(F.concat(F.lit("[2/9] item"), i % 11, F.lit(" done")))
    )
    return events.select(F.col("user_id").alias("job_id"), i.alias("line_no"), text.alias("text"), *more)


@query(f"WITH {LINES} SELECT * FROM ps")
def parsed_log_lines(spark, d):
    return logs.parsed_lines(log_lines(spark, d))


@query(f"""WITH {LINES}, u AS (SELECT user_id AS job_id, 'stage ' || event_id % 5 AS stage, sum(abs(value)) AS cost FROM events GROUP BY 1, 2), c AS (SELECT job_id, stage, sum(machine_cost) AS m, arg_max(estimated_cost, line_no) FILTER (estimated_cost IS NOT NULL) AS e FROM ps WHERE stage IS NOT NULL GROUP BY 1, 2)
SELECT job_id, stage, round_even(sum(coalesce(m, e, u.cost, 0)), 4) AS cost FROM c LEFT JOIN u USING (job_id, stage) GROUP BY ROLLUP (job_id, stage) HAVING job_id IS NOT NULL""")
def stage_costs(spark, d):
    usage = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.concat(F.lit("stage "), F.col("event_id") % 5).alias("stage"), F.abs("value").alias("cost"))
    return logs.stage_costs(logs.parsed_lines(log_lines(spark, d)), usage).withColumn("cost", F.bround("cost", 4))


@query(f"""WITH {LINES}, er AS (SELECT user_id AS job_id, event_id % 50 AS entity_id, CASE WHEN event_type = 'error' THEN 'bad input ' || event_id % 4 END AS error FROM events), c AS (SELECT job_id, error, count(*) AS n FROM er WHERE error IS NOT NULL GROUP BY 1, 2),
k AS (SELECT job_id, arg_max(error, (n, error)) AS common_error FROM c GROUP BY 1), p AS (SELECT job_id, count(DISTINCT entity_id) FILTER (error IS NOT NULL) AS failed, count(DISTINCT entity_id) AS total FROM er GROUP BY 1), l AS (SELECT job_id, arg_max(text, line_no) AS last_error_line FROM ps WHERE item_status IN ('error', 'failed') GROUP BY 1)
SELECT p.*, common_error, last_error_line, CASE WHEN contains(common_error || chr(10) || last_error_line, 'input 1') THEN 'check the first' WHEN contains(common_error || chr(10) || last_error_line, 'code 2') THEN 'check the second' END AS hint FROM p LEFT JOIN k USING (job_id) LEFT JOIN l USING (job_id) WHERE failed > 0""")
def failure_digest(spark, d):
    errors = table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 50).alias("entity_id"), F.when(F.col("event_type") == "error", F.concat(F.lit("bad input "), F.col("event_id") % 4)).alias("error"))
    return logs.failure_digest(logs.parsed_lines(log_lines(spark, d)), errors, [("input 1", "check the first"), ("code 2", "check the second")])


@query("WITH p AS (SELECT event_type AS model, event_id + 0.1 * user_id + 1.25 * (event_id % 10) AS i, user_id AS o FROM events) SELECT model, round(sum(i)::DOUBLE, 3) AS tokens_in, sum(o)::BIGINT AS tokens_out, round_even(round_even(sum((i * CASE WHEN model[1] = 'c' THEN 3.0 ELSE 1.0 END + o * CASE WHEN model[1] = 'c' THEN 15.0 ELSE 5.0 END)::DOUBLE / 1e6), 6), 5) AS cost FROM p GROUP BY ROLLUP (model)")
def cached_usage_cost(spark, d):
    use = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.col("user_id").alias("cache_read"), (F.col("event_id") % 10).alias("cache_write"))
    out = logs.cached_usage_cost(use, [("^c", 3.0, 15.0), (".", 1.0, 5.0)], "model")
    return out.withColumns({"cost": F.bround("cost", 5), "tokens_in": F.round("tokens_in", 3)})


_HEALTH = "c AS (SELECT o_orderkey AS entity_id, l_partkey AS doc_id, CASE WHEN o_orderkey % 4 < 2 AND l_linenumber < 3 THEN l_linenumber END AS r, CASE WHEN o_orderkey % 4 IN (0, 3) THEN l_tax END AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT entity_id, count(doc_id) AS n, count(r) AS n_dense_rank, count(CASE WHEN doc_id IS NOT NULL THEN s END) AS n_dense_score, CASE WHEN count(doc_id) = 0 THEN 'empty' WHEN count(r) > 0 AND count(s) > 0 THEN 'ok' WHEN count(r) > 0 THEN 'logging_artifact' WHEN count(s) = 0 THEN 'dense_arm_missing' ELSE 'unknown' END AS health FROM c GROUP BY 1)"


def health(spark, d):
    key, n = F.col("o_orderkey"), F.col("l_linenumber")
    c = table(spark, d, "orders").join(table(spark, d, "lineitem"), key == F.col("l_orderkey"), "left")
    return logs.score_health(c.select(key.alias("entity_id"), F.col("l_partkey").alias("doc_id"), F.when((key % 4 < 2) & (n < 3), n).alias("dense_rank"), F.when((key % 4).isin(0, 3), F.col("l_tax")).alias("dense_score")))


@query(f"WITH {_HEALTH} SELECT * FROM h")
def score_health(spark, d):
    return health(spark, d)


@query(f"WITH {_HEALTH} SELECT health, count(*) AS n, md5(string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id)) AS entities FROM h GROUP BY 1")
def health_report(spark, d):
    out = logs.health_report(health(spark, d))
    return out.withColumn("entities", F.md5(F.array_join(F.col("entities").cast("array<string>"), ",")))


@query("SELECT CASE WHEN p_size % 7 = 0 THEN 'unreadable' WHEN p_size % 3 = 0 THEN 'kept' ELSE 'stale' END AS state, count(*) AS n, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1")
def cache_states(spark, d):
    size = F.col("p_size")
    files = table(spark, d, "part").select(F.col("p_name").alias("path"), size.alias("length"), F.when(size % 7 != 0, F.when(size % 3 == 0, "v2").otherwise("v1")).alias("found_version"))
    return logs.file_states(files, "v2")


@query("SELECT max(ts) FILTER (event_type = 'purchase') AS report, max(ts) FILTER (event_type = 'click') AS judge, count(DISTINCT user_id % 2) <= 1 AS cuts_agree, max(ts) FILTER (event_type = 'purchase') >= max(ts) FILTER (event_type = 'click') - INTERVAL 1 SECOND AS fresh FROM events")
def output_freshness(spark, d):
    e = F.col("event_type")
    files = table(spark, d, "events").select(F.when(e == "purchase", "report").when(e == "click", "judge").otherwise("other").alias("kind"), F.col("ts").alias("modified"), (F.col("user_id") % 2).alias("cut"))
    return logs.is_fresh(files)


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT s.vec_id AS key, t.vec_id AS target, CASE WHEN coalesce(list_sum(list_transform(s.e, lambda x: x * x)), 0) > 0 AND coalesce(list_sum(list_transform(t.e, lambda x: x * x)), 0) > 0 THEN round(list_cosine_similarity(s.e, t.e), 6) ELSE 0 END AS score FROM v s, v t WHERE s.label = 0 AND t.label != 0) SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, target) AS rank, target, score FROM c QUALIFY rank <= 3")
def embedding_crosswalk(spark, d):
    """Vectors of the first label against those of all others."""
    v = table(spark, d, "embeddings")
    return cw.embedding_crosswalk(v.filter("label = 0"), v.filter("label != 0"), "vec_id", "embedding", 3)


@query(f"WITH {_W}, c AS (SELECT DISTINCT entity_id, target_code AS doc_id FROM decl JOIN w USING (source_code)) SELECT * FROM c WHERE (entity_id, doc_id) NOT IN (SELECT (entity_id, doc_id) FROM pres)")
def untaught_claims(spark, d):
    return cw.untaught(*_walk(spark, d))


@query("SELECT p_partkey, least(5, greatest(0, floor(2.5 * p_size / 20)::INTEGER + 1)) AS band, CASE WHEN p_size >= 30 THEN 'high' WHEN p_size >= 10 THEN 'medium' ELSE 'low' END AS tier FROM part")
def coverage_bands(spark, d):
    return table(spark, d, "part").select("p_partkey", cw.band(2.5 * F.col("p_size")).alias("band"), cw.tier(F.col("p_size"), 30, 10).alias("tier"))


OUT = "o AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS place, l_linenumber * 4 AS page, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 2 ELSE 1 END AS level FROM lineitem)"


@query(f"WITH {OUT} SELECT o.* FROM o JOIN (SELECT doc, min(level) AS least FROM o GROUP BY 1) USING (doc) WHERE level = least")
def top_level_outline(spark, d):
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    o = table(spark, d, "lineitem").select(key.alias("doc"), n.alias("place"), (n * 4).alias("page"), F.when(n % 2 == 0, key % 2).otherwise(1).alias("level")).distinct()
    return st.top_level(o, "doc", "level")


HDS = "h AS (SELECT l_orderkey AS doc, l_linenumber * 3 AS page, CASE WHEN l_suppkey % 4 > 0 THEN 'U' || l_suppkey % 3 END AS identity FROM lineitem), n AS (SELECT o_orderkey AS doc, 30 AS last_page FROM orders)"


@query(f"WITH {HDS}, f AS (SELECT doc, identity, min(page) AS start FROM h WHERE identity IS NOT NULL GROUP BY 1, 2) SELECT doc, identity, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, identity) - 1, last_page) AS \"end\" FROM f JOIN n USING (doc)")
def header_segments(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 3).alias("page"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("U"), F.col("l_suppkey") % 3)).alias("identity"))
    return st.header_segments(h, table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(30).alias("last_page")))


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS unit, 5 * l_linenumber AS start, 5 * l_linenumber + min(l_suppkey % 6)::INTEGER AS "end" FROM lineitem GROUP BY 1, 2), w AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM s)
SELECT doc, unit, seen + 1 AS start, start - 1 AS "end" FROM w WHERE start > seen + 1 UNION ALL SELECT doc, arg_max(unit, ("end", start)), max("end") + 1, 40 FROM s GROUP BY 1 HAVING max("end") + 1 <= 40""")
def overview_spans(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("unit")).agg(F.min(F.col("l_suppkey") % 6).cast("int").alias("x"))
    s = s.select("doc", "unit", (5 * F.col("unit")).alias("start"), (5 * F.col("unit") + F.col("x")).alias("end"))
    return st.overview_spans(s, table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(40).alias("last_page")))


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), x AS (SELECT doc, 2 * n AS line_no, CASE n WHEN 1 THEN '1. Opening' WHEN 3 THEN '2. Work Time A' WHEN 5 THEN '3. Closing' ELSE 'some words' END AS line FROM l UNION ALL SELECT doc, 2 * n + 1, chr(65 + n) || '. Item ' || p || CASE WHEN p % 3 > 0 THEN ' (' || p % 40 || ' minutes) more' ELSE '' END FROM l),
f AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\\d+\\.\\s*Opening') THEN 'Opening' WHEN regexp_matches(line, '^\\d+\\.\\s*Work Time') THEN 'Work Time' WHEN regexp_matches(line, '^\\d+\\.\\s*Closing') THEN 'Closing and Assessment' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM x)
SELECT doc, line_no AS "at", section, line[1] AS letter, trim(regexp_replace(line[4:], '\\(\\d+\\s*minutes?\\).*$', '')) AS title, TRY_CAST(nullif(regexp_extract(line, '\\((\\d+)\\s*minutes?\\)', 1), '') AS INTEGER) AS minutes FROM f WHERE regexp_matches(line, '^[A-Z]\\.\\s*.+') AND section IS NOT NULL""")
def agenda_items(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    n, p = F.col("n"), F.col("p")
    head = F.when(n == 1, "1. Opening").when(n == 3, "2. Work Time A").when(n == 5, "3. Closing").otherwise("some words")
    item = F.concat(F.char(65 + n), F.lit(". Item "), p, F.when(p % 3 > 0, F.concat(F.lit(" ("), p % 40, F.lit(" minutes) more"))).otherwise(""))
    lines = li.select("doc", F.inline(F.array(F.struct((2 * n).alias("line_no"), head.alias("line")), F.struct((2 * n + 1).alias("line_no"), item.alias("line")))))
    return st.agenda_items(lines)


@query("SELECT l_orderkey AS doc, l_linenumber AS page, CASE WHEN size >= 12.5 AND f THEN 1 WHEN size BETWEEN 10.4 AND 11.6 AND f THEN 2 WHEN size BETWEEN 9.0 AND 9.9 AND f THEN 3 ELSE 0 END AS tier FROM (SELECT *, 8 + l_quantity / 10 AS size, l_linestatus = 'O' AS f FROM lineitem)")
def font_tiers(spark, d):
    li = table(spark, d, "lineitem")
    font = F.when(F.col("l_linestatus") == "O", "MarkPro-Bold").otherwise("Mercury")
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), st.font_tier(8 + F.col("l_quantity") / 10, font).alias("tier"))


@query("""WITH s AS (SELECT p_partkey AS row, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE CASE WHEN p_size % 5 = 0 THEN '2' ELSE '1' END || '.' || (p_partkey // CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END) || '.' || p_size END AS code, CASE WHEN p_size % 8 = 0 THEN '' WHEN p_size % 11 = 0 THEN '=SUM(A1)' ELSE p_name END AS text FROM part),
r AS (SELECT row, trim(code) AS code, trim(text) AS text, split_part(trim(code), '.', 1) AS g FROM s), n AS (SELECT code, count(*) AS n FROM r WHERE code != '' GROUP BY 1), m AS (SELECT arg_max(g, (c, g)) AS main FROM (SELECT g, count(*) AS c FROM r WHERE code != '' GROUP BY 1))
SELECT row, 'blank_code' AS violation FROM r WHERE code = '' AND text != '' UNION ALL SELECT row, 'blank_text' FROM r WHERE code != '' AND text = '' UNION ALL SELECT row, 'formula' FROM r WHERE starts_with(text, '=') OR starts_with(code, '=') UNION ALL SELECT row, 'repeated' FROM r JOIN n USING (code) WHERE n.n > 1 UNION ALL SELECT row, 'other_grade' FROM r, m WHERE code != '' AND g != main""")
def sheet_violations(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    number = F.when(size % 4 == 0, F.floor(key / 2)).otherwise(key)
    code = F.when(size % 9 == 0, " ").otherwise(F.concat_ws(".", F.when(size % 5 == 0, "2").otherwise("1"), number.cast("string"), size.cast("string")))
    text = F.when(size % 8 == 0, "").when(size % 11 == 0, "=SUM(A1)").otherwise(F.col("p_name"))
    return src.sheet_violations(table(spark, d, "part").select(key.alias("row"), code.alias("code"), text.alias("text")))


@query("SELECT o_orderkey AS entity_id, CASE WHEN l IS NOT NULL THEN i END AS rank, CASE WHEN l IS NOT NULL THEN l[i] END AS doc_id, l IS NOT NULL AS has_field FROM (SELECT o_orderkey, l, unnest(CASE WHEN l IS NULL THEN [0] ELSE range(1, len(l) + 1) END) AS i FROM orders LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def retrieved_lists(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("codes"))
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id")).join(lists, "entity_id", "left")
    return src.retrieved(files, "codes")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 > 0 THEN p_name WHEN p_size % 2 = 0 THEN p_type END AS text FROM part")
def document_texts(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    good, blank = src.raw_or_competency(p.select(F.col("p_partkey").alias("doc_id"), F.when(size % 3 > 0, F.col("p_name")).otherwise(" ").alias("raw_text"), F.when(size % 2 == 0, F.col("p_type")).alias("competency")))
    return good.unionByName(blank, allowMissingColumns=True)


@query("SELECT p_partkey AS code, p_size || '-' || (p_size + 3) AS pages, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS min, p_brand || ', ' || p_type AS declared_standards, p_name AS title FROM part")
def lesson_index(spark, d):
    size = F.col("p_size")
    return src.index_rows(table(spark, d, "part").select(F.col("p_partkey").alias("code"), size.alias("page_start"), (size + 3).alias("page_end"), F.when(size % 2 == 0, size).alias("minutes"), F.array("p_brand", "p_type").alias("declared"), F.col("p_name").alias("title")))


@query("SELECT count(*) AS row_count, count(*) FILTER (l_returnflag = 'R') AS n_full, count(*) FILTER (l_returnflag = 'A') AS n_partial, count(*) FILTER (l_returnflag = 'N') AS n_none, count(DISTINCT l_suppkey) AS sources FROM lineitem")
def run_summary(spark, d):
    s = F.when(F.col("l_returnflag") == "R", "full").when(F.col("l_returnflag") == "A", "partial").otherwise("none")
    return src.run_summary(table(spark, d, "lineitem").withColumn("status", s), "status", "l_suppkey")


@query("SELECT p_partkey AS code, p_name AS title, CASE WHEN p_size > 20 THEN p_size END AS grade, p_brand AS model FROM part")
def record_round_trip(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("grade"), F.col("p_brand").alias("model"))
    return src.loaded(src.dumped(p, ["code", "title", "grade"], ["grade"], ["model"]), "code long, title string, grade int, _pipeline struct<model: string>")


_BM = rq.bm25_sql("benchmark", "item_id", 20)
_GOLD = "gold AS (SELECT item_id, doc_id FROM hit WHERE rank IN (2, 5, 15) UNION ALL SELECT item_id, -1 FROM benchmark)"


def gold_pairs(hits):
    """Some of the hits, and one document an item that no list has."""
    found = hits.filter(F.col("rank").isin(2, 5, 15)).select(F.col("query_id").alias("item_id"), "doc_id")
    return found.unionByName(hits.select(F.col("query_id").alias("item_id")).distinct().withColumn("doc_id", F.lit(-1).cast("long")))


@query(f"WITH {_BM}, {_GOLD}, m AS (SELECT g.item_id, g.doc_id, coalesce(rank <= 10, false) AS h FROM gold g LEFT JOIN hit USING (item_id, doc_id)) SELECT item_id, count(*) AS n_gold, count(*) FILTER (h) AS n_found, array_to_string(list_sort(list(doc_id) FILTER (NOT h)), ',') AS missed, round_even(count(*) FILTER (h) / count(*), 6) AS recall, count(*) FILTER (h) >= 0.5 * count(*) AS passes FROM m GROUP BY 1")
def entity_recall(spark, d):
    hits = rq.bm25_top(spark, d)
    out = ev.entity_recall(gold_pairs(hits), hits.withColumnRenamed("query_id", "item_id"), ["item_id", "doc_id"], 10, 0.5)
    return out.withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ","))


@query(f"WITH {_BM}, {_GOLD}, a AS (SELECT item_id, doc_id, rank FROM hit), b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM hit JOIN documents USING (doc_id) WHERE lang = 'en'), s AS (SELECT 'before' AS stage, g.*, rank FROM gold g LEFT JOIN a USING (item_id, doc_id) UNION ALL SELECT 'after', g.*, rank FROM gold g LEFT JOIN b USING (item_id, doc_id)) SELECT stage, count(*) AS n_gold, count(rank) AS n_found, round_even(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round_even(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr, 0 AS missing_files, 0 AS missing_before, (SELECT count(DISTINCT item_id) FROM gold WHERE item_id NOT IN (SELECT item_id FROM b)) AS missing_after FROM s GROUP BY 1")
def recall_before_and_after(spark, d):
    """Before and after a stage that keeps one language; items without a hit in it have no list after it."""
    hits = rq.bm25_top(spark, d).withColumnRenamed("query_id", "item_id")
    met = hits.join(rq.docs(spark, d).select("doc_id", "lang"), "doc_id")
    scanned = met.groupBy("item_id").agg(F.lit(True).alias("has_before"), F.coalesce(F.bool_or(F.col("lang") == "en"), F.lit(False)).alias("has_after"))
    after = rt.top_k(met.filter("lang = 'en'").drop("rank"), ["item_id"], [F.desc("score"), "doc_id"], 20)
    return ev.recall_before_and_after(gold_pairs(hits.withColumnRenamed("item_id", "query_id")), hits, after, scanned, ["item_id", "doc_id"], [5])


@query(f"""WITH {rq._SCORES}, one AS (SELECT item_id, doc_id FROM ar WHERE rank <= 20), two AS (SELECT item_id, doc_id FROM br WHERE rank <= 20 AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM one)),
g AS (SELECT item_id, doc_id FROM br WHERE rank <= 25), z AS (SELECT 'single' AS pool, item_id, doc_id, false AS added FROM one UNION ALL SELECT 'union', item_id, doc_id, false FROM one UNION ALL SELECT 'union', item_id, doc_id, true FROM two),
s AS (SELECT pool, item_id, count(*) AS n, count(*) FILTER (added) AS a FROM z GROUP BY 1, 2) SELECT pool, round_even(avg(n), 6) AS avg_size, max(n) AS max_size, round_even(avg(a), 6) AS avg_added, max(a) AS max_added, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM g JOIN z USING (item_id, doc_id) WHERE z.pool = s.pool) AS n_inside, round_even((SELECT count(*) FROM g JOIN z USING (item_id, doc_id) WHERE z.pool = s.pool) / (SELECT count(*) FROM g), 6) AS coverage FROM s GROUP BY 1""")
def pool_comparison(spark, d):
    hits, pick = rq.arm_hits(spark, d), ("entity_id", "doc_id", "score")
    top, plain = rt.fuse_arms(hits).select(*pick), rt.fuse_arms(hits, "sum", max_blend=0.0).select(*pick)
    gold = rt.top_k(plain, ["entity_id"], [F.desc("score"), "doc_id"], 25).select("entity_id", "doc_id")
    return ev.pool_comparison(rt.pool_membership(top, None, 20), rt.pool_membership(top, plain, 20), gold)


@query()
def rescue_sweep(spark, d):
    hits = rq.arm_hits(spark, d)
    rank = lambda df: rt.top_k(df, ["entity_id"], [F.desc("score"), "doc_id"], 30).select("entity_id", "doc_id", "rank")
    sums = rank(rt.fuse_arms(hits, "sum", max_blend=0.0))
    return ev.rescue_sweep(rank(rt.fuse_arms(hits, "max")), sums, sums.filter("rank <= 15").select("entity_id", "doc_id"), 20, [0, 1, 3, 5])


@query("""WITH a AS (SELECT doc_id, CASE WHEN n_chars >= 400 THEN 'good' ELSE 'poor' END AS x FROM documents), b AS (SELECT doc_id, list_sort(list(DISTINCT y)) AS y FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS y FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'poor' ELSE 'good' END FROM labels) GROUP BY 1), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, x, y FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, CASE WHEN y IS NULL THEN 'only_left' WHEN x IS NULL THEN 'only_right' ELSE 'both' END AS presence, x IS NOT NULL AND y IS NOT NULL AND list_contains(y, x) AS is_match, CASE WHEN y IS NULL THEN 'only_left' WHEN x IS NULL THEN 'only_right' WHEN list_contains(y, x) THEN 'match' ELSE 'expected ' || array_to_string(y, '/') || ', got ' || x END AS note FROM j""")
def label_comparison(spark, d):
    """A label by length for every document against those that a table holds for some."""
    left = rq.docs(spark, d).select("doc_id", F.when(F.col("n_chars") >= 400, "good").otherwise("poor").alias("x"))
    said = F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "poor").otherwise("good"))
    return ev.label_comparison(left, table(spark, d, "labels").select("doc_id", F.explode(said).alias("y")), ["doc_id"], "x", "y")


@query("""WITH r AS (SELECT l_orderkey AS entity_id, l_linenumber AS rank, l_partkey AS doc_id, CASE WHEN l_suppkey % 6 = 0 THEN upper(p_name) ELSE p_name END AS text, p_name FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT entity_id, count(*) AS c, count(DISTINCT rank) AS r, min(rank) AS lo, max(rank) AS hi, count(DISTINCT doc_id) AS d, count(DISTINCT lower(trim(text))) AS t FROM r GROUP BY 1)
SELECT entity_id, 'ranks' AS violation, 1 AS n FROM g WHERE c != 4 OR r != 4 OR lo != 1 OR hi != 4 UNION ALL SELECT entity_id, 'repeated_documents', c - d FROM g WHERE c > d UNION ALL SELECT entity_id, 'repeated_texts', c - t FROM g WHERE c > t UNION ALL SELECT entity_id, 'text_differs', count(*) FROM r WHERE text != p_name GROUP BY 1""")
def shortlist_violations(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("doc_id"), "l_suppkey")
    ranked = li.join(part, "doc_id").withColumn("text", F.when(F.col("l_suppkey") % 6 == 0, F.upper("text")).otherwise(F.col("text"))).drop("l_suppkey")
    return ev.shortlist_violations(ranked, part, 4)


@query("SELECT 188 AS expected, count(*) AS found, CASE WHEN count(*) = 188 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part")
def corpus_count_gate(spark, d):
    return ev.count_gate(table(spark, d, "part"), 188)


@query(f"""WITH {rq._SCORES}, m AS (SELECT item_id, doc_id, rank FROM ar WHERE rank <= 50), s AS (SELECT item_id, doc_id, rank FROM br WHERE rank <= 20), g AS (SELECT DISTINCT item_id, doc_id FROM p WHERE rank <= 3 UNION SELECT item_id, -1 FROM benchmark)
SELECT g.item_id AS entity_id, g.doc_id, m.rank AS merged_rank, s.rank AS summed_rank, m.rank - s.rank AS summed_delta, CASE WHEN m.rank IS NULL THEN 'merged' WHEN s.rank IS NULL THEN 'summed' END AS lost_at FROM g LEFT JOIN m USING (item_id, doc_id) LEFT JOIN s USING (item_id, doc_id)""")
def lost_gold(spark, d):
    hits = rq.arm_hits(spark, d)
    rank = lambda df, k: rt.top_k(df, ["entity_id"], [F.desc("score"), "doc_id"], k)
    stages = rk.stage_ranks({"merged": rank(rt.fuse_arms(hits), 50), "summed": rank(rt.fuse_arms(hits, "sum", max_blend=0.0), 20)}, ["entity_id", "doc_id"])
    gold = hits.filter("rank <= 3").select("entity_id", "doc_id").unionByName(rq.items(spark, d).select(F.col("item_id").alias("entity_id"), F.lit(-1).cast("long").alias("doc_id")))
    out = rk.lost_at(gold, stages, ["merged", "summed"], ["entity_id", "doc_id"])
    return rk.rank_deltas(out, ["merged", "summed"]).select("entity_id", "doc_id", "merged_rank", "summed_rank", "summed_delta", "lost_at")


@query(f"""WITH {rq._SCORES}, u AS (SELECT item_id, doc_id, min((k, rank)) AS w FROM (SELECT item_id, doc_id, 0 AS k, rank FROM ar WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 1, rank FROM br WHERE rank <= 10) GROUP BY 1, 2) SELECT item_id AS entity_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY w, doc_id) AS place FROM u""")
def ordered_union(spark, d):
    hits = rq.arm_hits(spark, d)
    rank = lambda df: rt.top_k(df, ["entity_id"], [F.desc("score"), "doc_id"], 10)
    return rk.ordered_union([rank(rt.fuse_arms(hits)), rank(rt.fuse_arms(hits, "sum", max_blend=0.0))], ["entity_id", "doc_id"])


@query(rq.BOOK.sql["rerank_preserve"])
def single_query_funnel(spark, d):
    """Both arms, the hybrid list, scores (term overlap stands in for a model's), and the preserved heads."""
    c, items = rq.corpus(spark, d), rq.items(spark, d)
    other, sparse = c.term_overlap(items, "item_id", "text", 20), c.bm25(items, "item_id", "text", 20)
    h = rt.hybrid(other, sparse, 20)
    scores = h.select("query_id", "doc_id", (F.coalesce("dense_score", F.lit(0.0)) - F.col("doc_id") % 7).alias("rerank_score"))
    return fu.single_query(other, sparse, scores, 20, 10, 0.3, 4).select("entity_id", "rerank_rank", "doc_id", "rrf_rank", F.round("blended_score", 6).alias("blended_score"))


def funnel_arms(spark, d):
    hits = rq.arm_hits(spark, d)
    return hits.withColumns({"source": F.lit("sentence"), "covers": F.col("query_index") > 0, "dense_rank": F.lit(None).cast("int"), "dense_score": F.lit(None).cast("double"), "bm25_rank": F.col("rank"), "bm25_score": F.col("score")})


@query(f"""WITH {rq._SCORES}, one AS (SELECT * FROM ar WHERE rank <= 20), u AS (SELECT item_id, doc_id, false AS added FROM one UNION ALL SELECT item_id, doc_id, true FROM br WHERE rank <= 20 AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM one)),
k AS (SELECT u.item_id, u.doc_id, added, a.score, row_number() OVER (PARTITION BY u.item_id ORDER BY added, a.score DESC, u.doc_id) AS rrf_rank FROM u JOIN a ON a.item_id = u.item_id AND a.doc_id = u.doc_id),
mq AS (SELECT item_id, doc_id, min(rank) AS bm25_rank, max(score) AS bm25_score, count(*) FILTER (query_index > 0 AND rank <= 12) AS query_hits FROM hit GROUP BY 1, 2)
SELECT k.item_id AS entity_id, k.doc_id, rrf_rank, k.score AS rrf_score, added, bm25_rank, bm25_score, query_hits FROM k JOIN mq ON mq.item_id = k.item_id AND mq.doc_id = k.doc_id""")
def multi_query_funnel(spark, d):
    merged, *_ = fu.multi_query(funnel_arms(spark, d), None, None, merge_k=20)
    return merged.select("entity_id", "doc_id", "rrf_rank", "rrf_score", "added", "bm25_rank", "bm25_score", "query_hits")


@query(f"""WITH {rq._FUSE}, f AS (SELECT item_id, doc_id, round(sum(part) + max(part), 9) AS f FROM o GROUP BY 1, 2), w AS (SELECT item_id, doc_id, coalesce(sum(weight::DOUBLE) FILTER (query_index > 0 AND rank <= 12), 0) AS w FROM hit GROUP BY 1, 2) SELECT item_id AS entity_id, doc_id, round(f + 0.55 * w / 60, 6) AS score FROM f JOIN w USING (item_id, doc_id)""")
def sum_mode_scores(spark, d):
    arms = funnel_arms(spark, d)
    merged, fused = rt.merge_queries(arms), rt.fuse_arms(arms, "sum").select("entity_id", "doc_id", "score")
    none = fused.limit(0)
    return rt.sum_extras(merged, fused, none, none).select("entity_id", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, CASE WHEN (SELECT count(*) FROM embeddings) < (SELECT count(*) FROM documents) THEN 'partial' WHEN (SELECT count(*) FROM embeddings) > (SELECT count(*) FROM documents) THEN 'stale' ELSE 'equal' END AS state")
def index_count(spark, d):
    return inc.index_count(table(spark, d, "documents"), table(spark, d, "embeddings"))


@query("SELECT doc_id, sha256(length(lang) || ':' || lang || length(doc_id::VARCHAR) || ':' || doc_id) AS cache_key FROM documents")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", inc.cache_key(F.col("lang"), F.col("doc_id")).alias("cache_key"))
