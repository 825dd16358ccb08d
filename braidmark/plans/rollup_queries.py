"""Verdict, roll-up, decision and evaluation queries: lineitem is the verdict table.

l_orderkey: entity, l_partkey: document, l_returnflag R/A/N: full/partial/none, l_linestatus O: flagged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import evaluation as ev
from braidmark.operators import hierarchy as hi
from braidmark.operators import incremental as inc
from braidmark.operators import logs
from braidmark.operators import rollups as ru
from braidmark.operators import verdicts as vd
from braidmark.plans.book import Book
from braidmark.plans.retrieval_queries import tree
from braidmark.session import table
from braidmark.sources import tables as src

BOOK = Book()
query = BOOK.query

V = "v AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'full' WHEN 'A' THEN 'partial' ELSE 'none' END AS status, l_linestatus = 'O' AS needs_review FROM lineitem)"


def verdicts(spark, d):
    s = F.when(F.col("l_returnflag") == "R", "full").when(F.col("l_returnflag") == "A", "partial").otherwise("none")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", s.alias("status"), (F.col("l_linestatus") == "O").alias("needs_review"))


@query(f"WITH {V}, c AS (SELECT l_orderkey, count(*) FILTER (status = 'full') AS f, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'none') AS n, count(*) FILTER (needs_review) AS r FROM v GROUP BY 1) SELECT o_orderkey AS l_orderkey, coalesce(f, 0) AS \"full\", coalesce(p, 0) AS partial, coalesce(n, 0) AS \"none\", coalesce(r, 0) AS review FROM orders LEFT JOIN c ON o_orderkey = l_orderkey")
def entity_coverage(spark, d):
    return ru.entity_coverage(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), verdicts(spark, d), "l_orderkey")


@query(f"WITH {V}, c AS (SELECT l_partkey, count(*) FILTER (status = 'full') AS f, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (needs_review) AS r, count(DISTINCT l_orderkey) FILTER (status != 'none') AS e FROM v GROUP BY 1) SELECT p_partkey AS l_partkey, coalesce(f, 0) AS \"full\", coalesce(p, 0) AS partial, coalesce(r, 0) AS review, coalesce(e, 0) AS n_entities, CASE WHEN f > 0 THEN 'covered' WHEN p > 0 THEN 'partial' WHEN r > 0 THEN 'review' ELSE 'not_found' END AS coverage FROM part LEFT JOIN c ON p_partkey = l_partkey")
def document_coverage(spark, d):
    return ru.document_coverage(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), verdicts(spark, d), "l_partkey", "l_orderkey")


@query(f"WITH {V}, o AS (SELECT count(*) AS n, count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'none') AS \"none\", count(*) FILTER (needs_review) AS review, count(DISTINCT l_partkey) FILTER (status != 'none') AS cited FROM v) SELECT *, (SELECT count(*) FROM part) AS documents, round_even(100 * cited / (SELECT count(*) FROM part), 1) AS coverage_pct FROM o")
def overview(spark, d):
    return ru.overview(verdicts(spark, d), table(spark, d, "part"), "l_partkey")


@query("WITH x AS (SELECT r_name, n_name, s_suppkey, CASE l_returnflag WHEN 'R' THEN 'full' WHEN 'A' THEN 'partial' ELSE 'none' END AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS (SELECT r_name, n_name, s_suppkey, count(*) FILTER (status = 'full') AS met, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'none') AS gap, grouping(r_name, n_name, s_suppkey) AS level FROM x GROUP BY ROLLUP (r_name, n_name, s_suppkey)) SELECT *, round_even(100 * met / (met + partial + gap), 1) AS met_pct FROM g")
def coverage_cube(spark, d):
    s = F.when(F.col("l_returnflag") == "R", "full").when(F.col("l_returnflag") == "A", "partial").otherwise("none")
    li = table(spark, d, "lineitem").select("l_suppkey", s.alias("status"))
    x = li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ru.cube(x, ["r_name", "n_name", "s_suppkey"], "status")


_CONF = f"WITH {V}, s AS (SELECT l_partkey, status, count(*) AS n FROM v GROUP BY 1, 2), g AS (SELECT l_partkey, sum(n)::BIGINT AS group_size, count(*) AS labels, max(n) AS most, arg_max(status, (n, status)) AS top FROM s GROUP BY 1)"


@query(f"{_CONF} SELECT l_orderkey, l_partkey, l_linenumber, status, needs_review, group_size, labels > 1 AS conflict, CASE WHEN labels > 1 AND 2 * most > group_size THEN top END AS majority, CASE WHEN labels > 1 AND 2 * most > group_size THEN top ELSE status END AS final_status FROM v JOIN g USING (l_partkey)")
def cross_entity_consistency(spark, d):
    return vd.reconcile(verdicts(spark, d), ["l_partkey"])


@query(f"WITH {V} SELECT l_orderkey, count(*) AS n, count(*) FILTER (status = 'full') AS n_full, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'none') AS n_none, round_even(count(*) FILTER (status != 'none' AND needs_review) / nullif(count(*) FILTER (status != 'none'), 0), 6) AS grounding_rate FROM v GROUP BY 1")
def run_report(spark, d):
    return vd.report(verdicts(spark, d), "l_orderkey", "status", "needs_review")


@query(f"WITH {V}, g AS (SELECT l_orderkey, l_partkey, min(CASE status WHEN 'full' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) AS k FROM v GROUP BY ALL) SELECT l_orderkey, l_partkey, ['full', 'partial', 'none'][k] AS status FROM g")
def strongest_gold(spark, d):
    return ev.strongest(verdicts(spark, d), ["l_orderkey", "l_partkey"], "status", ["full", "partial", "none"])


@query(
    f"WITH {V}, g AS (SELECT l_orderkey, l_linenumber, status AS truth FROM v), p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'full' ELSE 'none' END AS guess FROM lineitem), j AS (SELECT g.*, guess FROM g LEFT JOIN p USING (l_orderkey, l_linenumber)), k AS (SELECT count(*) AS n_gold, count(*) FILTER (guess IS NULL) AS missing, count(*) FILTER (truth = guess) AS exact, count(*) FILTER (truth != 'none' AND guess != 'none') AS tp, count(*) FILTER (truth = 'none' AND guess != 'none') AS fp, count(*) FILTER (truth != 'none' AND guess = 'none') AS fn, count(*) FILTER (truth = 'none' AND guess = 'none') AS tn FROM j) SELECT *, round_even(exact / (n_gold - missing), 6) AS exact_rate, round_even(tp / (tp + fp), 6) AS precision, round_even(tp / (tp + fn), 6) AS recall FROM k"
)
def label_scores(spark, d):
    gold = verdicts(spark, d).select("l_orderkey", "l_linenumber", F.col("status").alias("truth"))
    guess = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "full").otherwise("none").alias("guess"))
    return ev.score_labels(gold, guess, ["l_orderkey", "l_linenumber"], "truth", "guess", ["full", "partial"])


@query(f"WITH {V}, a AS (SELECT l_partkey, list(DISTINCT status) AS allowed FROM v GROUP BY 1), p AS (SELECT p_partkey AS l_partkey, CASE WHEN p_size % 3 = 0 THEN 'full' WHEN p_size % 3 = 1 THEN 'partial' ELSE 'none' END AS guess FROM part), j AS (SELECT * FROM a LEFT JOIN p USING (l_partkey)), c AS (SELECT count(*) AS n_gold, count(guess) AS n_overlap, count(*) FILTER (list_contains(allowed, guess)) AS n_right FROM j) SELECT *, round_even(n_right / n_overlap, 6) AS overlap_accuracy, round_even(n_right / n_gold, 6) AS gold_accuracy FROM c")
def label_agreement(spark, d):
    guess = F.when(F.col("p_size") % 3 == 0, "full").when(F.col("p_size") % 3 == 1, "partial").otherwise("none")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), guess.alias("guess"))
    return ev.label_agreement(verdicts(spark, d), p, ["l_partkey"], "status", "guess")


@query(f"WITH {V}, r AS (SELECT l_partkey, l_orderkey, status, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS page, l_orderkey % 5 AS fb FROM v WHERE status != 'none') SELECT l_partkey, count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status = 'partial') AS partial, count(DISTINCT l_orderkey) AS n_entities, array_to_string(list_sort(list(DISTINCT coalesce(page, CASE WHEN fb > 0 THEN fb END)) FILTER (coalesce(page, CASE WHEN fb > 0 THEN fb END) IS NOT NULL)), ',') AS pages FROM r GROUP BY 1")
def citation_pages(spark, d):
    rows = verdicts(spark, d).withColumns({"page": F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("long")), "fallback": F.col("l_orderkey") % 5})
    out = ru.citations(rows, "l_partkey", "l_orderkey", "page", "fallback")
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("WITH p AS (SELECT DISTINCT l_suppkey, l_partkey AS page FROM lineitem), i AS (SELECT *, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS k FROM p), r AS (SELECT l_suppkey, min(page) AS first, max(page) AS last FROM i GROUP BY l_suppkey, k) SELECT l_suppkey, 'pp. ' || string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '–' || last END, ', ' ORDER BY first) AS pages FROM r GROUP BY 1")
def page_lists(spark, d):
    pages = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("page"))
    return ru.page_list(ru.page_runs(pages, "l_suppkey", "page"), "l_suppkey")


@query(f"WITH {V}, c AS (SELECT l_partkey, count(*) FILTER (status = 'full') AS f, count(*) FILTER (status = 'partial') AS p FROM v GROUP BY 1), s AS (SELECT p_brand, p_name, CASE WHEN f > 0 THEN 'supported' WHEN p > 0 THEN 'partial' ELSE 'missing' END AS s FROM part LEFT JOIN c ON p_partkey = l_partkey), g AS (SELECT p_brand, count(*) FILTER (s = 'supported') AS n_supported, count(*) FILTER (s = 'partial') AS n_partial, count(*) FILTER (s = 'missing') AS n_missing, coalesce(string_agg(p_name, ', ' ORDER BY p_name) FILTER (s = 'missing'), '') AS missing_skills FROM s GROUP BY 1) SELECT *, CASE WHEN n_supported + n_partial = 0 THEN 'beyond_scope' WHEN n_partial + n_missing = 0 THEN 'fully_met' ELSE 'partially_met' END AS rollup FROM g")
def parent_rollup(spark, d):
    cited = verdicts(spark, d).groupBy("l_partkey").agg(F.count(F.when(F.col("status") == "full", 1)).alias("full"), F.count(F.when(F.col("status") == "partial", 1)).alias("partial"))
    children = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name")
    return ru.parent_rollup(children, cited, "l_partkey", "p_brand", "p_name")


D = "log AS (SELECT user_id, event_id % 20 AS item, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'pending' ELSE 'flagged' END AS decision, (ts, event_id) AS moment FROM events), last AS (SELECT user_id, item, arg_max(decision, moment) AS decision FROM log GROUP BY 1, 2)"


def decision_log(spark, d):
    e = F.col("event_type")
    decision = F.when(e == "purchase", "accepted").when(e == "error", "rejected").when(e == "signup", "pending").otherwise("flagged")
    return table(spark, d, "events").select("user_id", (F.col("event_id") % 20).alias("item"), decision.alias("decision"), F.struct("ts", "event_id").alias("at"))


@query(f"WITH {D} SELECT * FROM last WHERE decision != 'pending'")
def latest_decisions(spark, d):
    return ru.latest_decisions(decision_log(spark, d), ["user_id", "item"], "at", "decision").drop("at")


@query(f"WITH {D}, c AS (SELECT DISTINCT user_id, item FROM log), j AS (SELECT c.user_id, coalesce(CASE WHEN decision != 'pending' THEN decision END, 'pending') AS x FROM c LEFT JOIN last USING (user_id, item)), g AS (SELECT user_id, count(*) AS n, count(*) FILTER (x = 'accepted') AS accepted, count(*) FILTER (x = 'rejected') AS rejected FROM j GROUP BY 1) SELECT *, CASE WHEN rejected > 0 THEN 'flagged' WHEN accepted = n THEN 'all' WHEN accepted > 0 THEN 'some' ELSE 'none' END AS state FROM g")
def verification_state(spark, d):
    cites = decision_log(spark, d).select("user_id", "item").distinct()
    return ru.verification_state(cites, latest_decisions(spark, d), "user_id", ["user_id", "item"], "decision")


@query("SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def jobs_per_day(spark, d):
    return ru.jobs_per_day(table(spark, d, "events"), "ts", "event_type", "purchase", "error")


@query("WITH s AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1) (SELECT *, 'best' AS side FROM s ORDER BY total DESC, l_suppkey LIMIT 4) UNION ALL (SELECT *, 'worst' FROM s ORDER BY total, l_suppkey LIMIT 4)")
def best_and_worst(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return ru.best_and_worst(s, "l_suppkey", "total")


@query("WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders), g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT coalesce(w.k, g.k) AS l_orderkey, CASE WHEN g.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' END AS violation FROM w FULL JOIN g ON w.k = g.k) SELECT * FROM j WHERE violation IS NOT NULL")
def key_violations(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return vd.key_violations(table(spark, d, "lineitem"), wanted, ["l_orderkey"])


_FOLDED = """trim(regexp_replace(regexp_replace(translate(lower(translate({x}, '‘’“”–— ', '''''""-- ')), '_''"', '   '), '(^|\n)\\s*-\\s*', '\\1 ', 'g'), '\\s+', ' ', 'g'))"""


_STITCH = ";|\\.\\.\\.|…"


@query(
    f"""WITH e AS (SELECT doc_id, text, length(text) // 3 AS n, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, n) || CASE WHEN doc_id % 2 = 0 THEN ' ... ' ELSE '; ' END || substr(text, 2 * n) ELSE text || ' zzz' END AS q FROM documents),
f AS (SELECT doc_id, length(trim(q)) >= 24 AS long, {_FOLDED.format(x="q")} AS q, {_FOLDED.format(x="text")} AS t FROM e),
h AS (SELECT *, list_filter(list_transform(string_split_regex(q, '{_STITCH}'), lambda x: trim(x)), lambda x: length(x) >= 12) AS parts FROM f),
g AS (SELECT doc_id, coalesce(long AND q != '' AND t != '' AND (contains(t, q) OR (regexp_matches(q, '{_STITCH}') AND len(parts) > 0 AND len(list_filter(parts, lambda p: NOT contains(t, p))) = 0)), false) AS grounded FROM h)
SELECT doc_id, grounded, CASE WHEN grounded THEN 'full' ELSE 'none' END AS final_status, CASE WHEN grounded THEN 'high' ELSE 'low' END AS confidence, CASE WHEN grounded THEN '' ELSE 'confidence=low; grounding rejection' END AS review_reason FROM g"""
)
def grounded_verdicts(spark, d):
    """Quotes of whole texts: as they are, stitched from their first and last third, or with a word that the text lacks."""
    third, key = F.floor(F.length("text") / 3).cast("int"), F.col("doc_id")
    stitched = F.concat(F.substr("text", F.lit(1), third), F.when(key % 2 == 0, " ... ").otherwise("; "), F.substr("text", 2 * third))
    q = F.when(key % 3 == 0, F.col("text")).when(key % 3 == 1, stitched).otherwise(F.concat("text", F.lit(" zzz")))
    drafts = table(spark, d, "documents").select("doc_id", "text", q.alias("evidence"), F.lit("full").alias("status"), F.lit("high").alias("confidence"))
    return vd.finalize(drafts, "text").select("doc_id", "grounded", "final_status", "confidence", "review_reason")


@query("SELECT id, level, parent, grade FROM (SELECT id, ['grade', 'domain', 'big_idea', 'standard', 'substandard'][least(5, len(p))] AS level, CASE WHEN len(p) > 2 THEN regexp_replace(id, '\\.[^.]*$', '') END AS parent, CASE WHEN p[1] = 'K' THEN 0 ELSE TRY_CAST(p[1] AS INTEGER) END AS grade FROM (SELECT id, string_split(id, '.') AS p FROM (SELECT (n_regionkey + 1) || '.' || substr(n_name, 1, 1) || '.' || n_nationkey || '.' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey)))")
def code_columns(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat_ws(".", (F.col("n_regionkey") + 1).cast("string"), F.substring("n_name", 1, 1), F.col("n_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return hi.code_columns(c.select(code.alias("id")), "id")


_TREE = "t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT t.id AS node, t.parent AS ancestor, 1 AS distance FROM t WHERE parent IN (SELECT id FROM t) UNION ALL SELECT a.node, t.parent, a.distance + 1 FROM a JOIN t ON a.ancestor = t.id WHERE t.parent IN (SELECT id FROM t)) SELECT node, ancestor, distance FROM a")
def tree_ancestors(spark, d):
    return hi.ancestors(tree(spark, d), "id", "parent")


def embed_sides(spark, d):
    """The index holds what has a label, and the benchmark's texts under their own numbers, which documents of those numbers replace."""
    stamp = lambda df, key, model: df.select(F.col(key).alias("doc_id"), inc.content_hash(F.col("text")).alias("h"), model.alias("model"))
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")
    index = stamp(items, "item_id", F.lit("en")).unionByName(stamp(labelled, "doc_id", F.col("lang")))
    return stamp(docs, "doc_id", F.col("lang")), index


@query(
    """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, lang AS model FROM documents), b AS (SELECT item_id AS doc_id, sha256(coalesce(text, '')) AS h, 'en' AS model FROM benchmark
UNION ALL SELECT doc_id, sha256(coalesce(text, '')), lang FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT item_id FROM benchmark))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'prune' WHEN b.doc_id IS NOT NULL AND a.h = b.h AND a.model IS NOT DISTINCT FROM b.model THEN 'skip' ELSE 'embed' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def embed_plan(spark, d):
    return inc.embed_plan(*embed_sides(spark, d), "doc_id", ["h", "model"])


@query(
    """WITH l AS (SELECT doc_id::VARCHAR AS k, doc_id::VARCHAR || ':' || sha256(coalesce(text, '')) AS l FROM documents), n AS (SELECT greatest(1, ceil(log(greatest(1, count(*)) / 4096) / log(16)))::INTEGER AS digits FROM l),
b AS (SELECT substr(sha256(k), 1, digits) AS b, sha256(string_agg(l, chr(10) ORDER BY l)) AS h, count(*) AS n FROM l, n GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, sum(n)::BIGINT AS n_rows FROM b"""
)
def corpus_fingerprint(spark, d):
    a = table(spark, d, "documents").select("doc_id", inc.content_hash(F.col("text")).alias("h"))
    return inc.fingerprint(a, "doc_id", "h")


@query("SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 3.5)::INTEGER + 1) AS tokens FROM documents WHERE greatest(1, floor(length(coalesce(text, '')) / 3.5)::INTEGER + 1) > 1000")
def oversize_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", inc.token_estimate(F.col("text")).alias("tokens")).filter("tokens > 1000")


@query("SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty' WHEN len(embedding) != 32 THEN 'dimension' END AS violation FROM embeddings")
def vector_violations(spark, d):
    return inc.vector_violations(table(spark, d, "embeddings"), "vec_id", "embedding", 32)


_TYPED = "SELECT user_id, event_id, CASE WHEN regexp_matches(event_type, '^err') THEN 'error' WHEN regexp_matches(event_type, 'click|view') THEN 'progress' ELSE 'info' END AS kind FROM events"


@query(f"WITH t AS ({_TYPED}) SELECT kind, count(*) AS n FROM t GROUP BY 1")
def log_line_types(spark, d):
    kind = logs.line_type(F.col("event_type"), [("error", "^err"), ("progress", "click|view")])
    return table(spark, d, "events").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT user_id AS job, date_trunc('day', ts)::DATE AS stage, event_id % 10 AS item, min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END) AS k FROM events GROUP BY ALL) SELECT job, stage, count(*) AS n_items, count(*) FILTER (k = 1) AS n_error, count(*) FILTER (k = 2) AS n_purchase, count(*) FILTER (k = 3) AS n_click, count(*) FILTER (k = 4) AS n_view, count(*) FILTER (k = 5) AS n_signup FROM r GROUP BY 1, 2")
def stage_rollup(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("job"), F.to_date("ts").alias("stage"), (F.col("event_id") % 10).alias("item"), "event_type")
    return logs.stage_rollup(rows, "job", "stage", "item", "event_type", ["error", "purchase", "click", "view", "signup"])


@query("WITH p AS (SELECT event_type AS model, event_id AS i, user_id AS o, CASE WHEN regexp_matches(event_type, '^c') THEN 3.0 WHEN regexp_matches(event_type, 'e') THEN 1.0 ELSE 0.0 END AS pi, CASE WHEN regexp_matches(event_type, '^c') THEN 15.0 WHEN regexp_matches(event_type, 'e') THEN 5.0 ELSE 0.0 END AS po FROM events) SELECT model, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round_even(sum((i * pi + o * po)::DOUBLE / 1e6), 6) AS cost FROM p GROUP BY ROLLUP (model)")
def usage_cost(spark, d):
    use = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    return logs.usage_cost(use, [("^c", 3.0, 15.0), ("e", 1.0, 5.0)], "model")


@query("WITH h AS (SELECT DISTINCT user_id, event_type AS stage FROM events), u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT unnest(['view', 'click', 'signup', 'purchase']) AS stage, unnest([0, 1, 2, 3]) AS k), c AS (SELECT k, s.stage, count(h.user_id) AS n_done, count(*) = count(h.user_id) AS complete FROM u CROSS JOIN s LEFT JOIN h ON h.user_id = u.user_id AND h.stage = s.stage GROUP BY ALL) SELECT stage, complete, n_done, bool_and(complete) OVER (ORDER BY k) AS done FROM c")
def stages_done(spark, d):
    e = table(spark, d, "events")
    have = e.select("user_id", F.col("event_type").alias("stage"))
    return logs.stages_done(e.select("user_id").distinct(), have, "user_id", "stage", ["view", "click", "signup", "purchase"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END::DOUBLE AS q FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def latest_pool_list(spark, d):
    """Every document's length, replaced by its label where a later list has one."""
    one = lambda name, c: table(spark, d, name).select("doc_id", F.col(c).cast("double").alias("q"))
    return src.latest_of([one("documents", "n_chars"), one("labels", "quality")], ["doc_id"])


@query("SELECT conv_id, turn, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS text FROM conversations")
def guarded_report(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", src.guarded(F.col("text")).alias("text"))
