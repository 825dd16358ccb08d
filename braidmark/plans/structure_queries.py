"""Document structure and crosswalk queries over documents, conversations, part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import crosswalk as cw
from braidmark.operators import ranking as rk
from braidmark.operators import structure as st
from braidmark.plans.book import Book
from braidmark.session import table

BOOK = Book()
query = BOOK.query

S = "s AS (SELECT l_orderkey AS doc, l_linenumber * 5 + 3 AS start, l_linenumber * 5 + 3 + (l_partkey % 9)::INTEGER - 1 AS \"end\", 60 AS pages, l_linenumber AS place FROM lineitem)"


def spans(spark, d):
    start = F.col("l_linenumber") * 5 + 3
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + (F.col("l_partkey") % 9).cast("int") - 1).alias("end"), F.lit(60).alias("pages"), F.col("l_linenumber").alias("place"))


@query("WITH o AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber * 5 + 3 AS page, 60 AS pages FROM lineitem) SELECT doc, page AS start, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page) - 1, pages) AS \"end\" FROM o")
def outline_segments(spark, d):
    o = spans(spark, d).select("doc", F.col("start").alias("page"), "pages").distinct()
    return st.segments(o, "doc", "page", "pages").select("doc", "start", "end")


@query(f"WITH {S}, t AS (SELECT DISTINCT doc, start, \"end\", pages FROM s WHERE \"end\" >= start), m AS (SELECT doc, start, max(\"end\") AS \"end\", any_value(pages) AS pages FROM t GROUP BY 1, 2), b AS (SELECT *, coalesce(max(\"end\") OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m) SELECT doc, seen + 1 AS start, start - 1 AS \"end\" FROM b WHERE start > seen + 1 UNION ALL SELECT doc, max(\"end\") + 1, max(pages) FROM m GROUP BY doc HAVING max(\"end\") + 1 <= max(pages)")
def uncovered_pages(spark, d):
    s = spans(spark, d).filter(F.col("end") >= F.col("start")).groupBy("doc", "start").agg(F.max("end").alias("end"), F.max("pages").alias("pages"))
    return st.gaps(s, "doc", "pages")


@query(f"WITH {S}, u AS (SELECT doc, place, any_value(start) AS start, max(\"end\") AS \"end\" FROM s GROUP BY 1, 2), f AS (SELECT *, lag(start) OVER (PARTITION BY doc ORDER BY place) AS b, max(\"end\") OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u) SELECT doc, count(*) FILTER (start <= b) AS not_rising, count(*) FILTER (start <= m) AS overlaps, count(*) FILTER (\"end\" < start) AS reversed FROM f GROUP BY 1")
def span_order_checks(spark, d):
    return st.order_checks(spans(spark, d).groupBy("doc", "place").agg(F.first("start").alias("start"), F.max("end").alias("end")), "doc")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def filled_forward(spark, d):
    c = table(spark, d, "conversations")
    return st.fill_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "asked")


@query("WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM e) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY 1, 2, 3")
def event_runs(spark, d):
    return st.runs(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query(f"WITH {S}, t AS (SELECT DISTINCT doc, start, \"end\" FROM s WHERE \"end\" >= start), p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber * 5 + 4 AS page, l_linenumber * 5 + 104 AS printed FROM lineitem) SELECT t.doc, start, \"end\", arg_min(printed, page) AS printed_first, arg_max(printed, page) AS printed_last FROM t JOIN p ON t.doc = p.doc AND page BETWEEN start AND \"end\" GROUP BY ALL")
def printed_pages(spark, d):
    s = spans(spark, d).filter(F.col("end") >= F.col("start")).select("doc", "start", "end").distinct()
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 5 + 4).alias("page"), (F.col("l_linenumber") * 5 + 104).alias("printed")).distinct()
    return st.printed_range(s, p, "doc")


@query("SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def document_lines(spark, d):
    return st.lines(table(spark, d, "documents"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


STOP = ("the", "of")
#: Words of both sides; pairs that mostly stand together, merged from left to right: of a row of overlapping pairs every other one.
_WORDS = """(SELECT {k} AS key, list_filter(regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '\\([^)]*\\)', ' ', 'g'), '[a-z'']+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'of')) AS t FROM {t})"""
_BAGS = f"""sx AS {_WORDS.format(k="item_id", c="text", t="benchmark")}, tx AS {_WORDS.format(k="doc_id", c="text", t="documents")},
ax AS (SELECT 's' AS side, * FROM sx UNION ALL SELECT 't', * FROM tx),
pw AS (SELECT side, key, i, t[i] AS a, t[i + 1] AS b FROM (SELECT *, unnest(range(1, len(t))) AS i FROM ax)),
pd AS (SELECT a, b, count(DISTINCT (side, key)) AS df FROM pw GROUP BY 1, 2 HAVING count(DISTINCT (side, key)) >= 2), wd AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(t)) AS w FROM ax) GROUP BY 1),
co AS (SELECT a, b FROM pd JOIN wd x ON x.w = a JOIN wd y ON y.w = b WHERE df >= 0.7 * x.n AND df >= 0.7 * y.n),
hit AS (SELECT side, key, i, i - row_number() OVER (PARTITION BY side, key ORDER BY i) AS island FROM pw SEMI JOIN co ON co.a = pw.a AND co.b = pw.b),
take AS (SELECT side, key, i FROM (SELECT *, row_number() OVER (PARTITION BY side, key, island ORDER BY i) AS turn FROM hit) WHERE turn % 2 = 1),
wx AS (SELECT side, key, t, i, t[i] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM ax)),
mx AS (SELECT wx.side, wx.key, CASE WHEN u.i IS NOT NULL THEN w || '_' || t[wx.i + 1] ELSE w END AS token FROM wx LEFT JOIN take u ON u.side = wx.side AND u.key = wx.key AND u.i = wx.i
       ANTI JOIN take v ON v.side = wx.side AND v.key = wx.key AND v.i + 1 = wx.i),
s AS (SELECT key, token, count(*) AS tf FROM mx WHERE side = 's' GROUP BY ALL), t AS (SELECT key, token, count(*) AS tf FROM mx WHERE side = 't' GROUP BY ALL)"""


@query(
    f"""WITH {_BAGS}, i AS (SELECT token, ln((SELECT count(DISTINCT key) FROM t) / count(*)) + 0.1 AS idf FROM t GROUP BY 1),
sw AS (SELECT key, s.token, tf * coalesce(idf, 1) AS w FROM s LEFT JOIN i ON s.token = i.token), tw AS (SELECT key AS target, t.token, tf * idf AS w FROM t JOIN i ON t.token = i.token),
sn AS (SELECT key, sqrt(sum(w * w)) AS n FROM sw GROUP BY 1), tn AS (SELECT target, sqrt(sum(w * w ORDER BY token)) AS n FROM tw GROUP BY 1),
d AS (SELECT key, target, sum(sw.w * tw.w ORDER BY sw.token) AS dot FROM sw JOIN tw ON sw.token = tw.token GROUP BY 1, 2), c AS (SELECT key, target, dot / (sn.n * tn.n) AS raw FROM d JOIN sn USING (key) JOIN tn USING (target))
SELECT key, row_number() OVER (PARTITION BY key ORDER BY round(raw, 9) DESC, target) AS rank, target, round(raw, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(raw, 9) DESC, target) <= 3"""
)
def text_crosswalk(spark, d):
    return cw.text_crosswalk(*cw.merged_sides(table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), STOP))


@query(
    """WITH k AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+') AS t FROM part), p AS (SELECT DISTINCT p_partkey, t[i] AS "first", t[i + 1] AS "second" FROM (SELECT *, unnest(range(1, len(t))) AS i FROM k)),
w AS (SELECT x, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(t) AS x FROM k) GROUP BY 1), c AS (SELECT "first", "second", count(*) AS df FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT "first", "second", df FROM c JOIN w a ON a.x = "first" JOIN w b ON b.x = "second" WHERE df >= 0.02 * a.n AND df >= 0.02 * b.n"""
)
def collocations(spark, d):
    t = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0))
    return cw.collocations(table(spark, d, "part"), "p_partkey", t, ratio=0.02)


_W = "w AS (SELECT p_partkey AS source_code, (p_partkey * 7) % 50 AS target_code, CASE WHEN p_size < 15 THEN 'high' WHEN p_size < 35 THEN 'medium' ELSE 'low' END AS confidence FROM part), decl AS (SELECT DISTINCT l_orderkey AS entity_id, l_partkey AS source_code FROM lineitem), pres AS (SELECT l_orderkey AS entity_id, l_partkey AS doc_id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)"


def _walk(spark, d):
    size = F.col("p_size")
    walk = table(spark, d, "part").select(F.col("p_partkey").alias("source_code"), ((F.col("p_partkey") * 7) % 50).alias("target_code"), F.when(size < 15, "high").when(size < 35, "medium").otherwise("low").alias("confidence"))
    li = table(spark, d, "lineitem")
    declared = li.select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("source_code")).distinct()
    present = li.groupBy(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("doc_id")).agg(F.min("l_linenumber").alias("rank"))
    return declared, walk, present


_NEW = f"{_W}, m AS (SELECT entity_id, target_code AS doc_id, min(CASE confidence WHEN 'high' THEN 1 ELSE 2 END) AS t FROM decl JOIN w USING (source_code) WHERE confidence != 'low' GROUP BY 1, 2), n AS (SELECT m.*, row_number() OVER (PARTITION BY entity_id ORDER BY t, doc_id) AS turn FROM m WHERE (entity_id, doc_id) NOT IN (SELECT (entity_id, doc_id) FROM pres))"


@query(f"WITH {_NEW} SELECT entity_id, doc_id, turn FROM n")
def applied_crosswalk(spark, d):
    return cw.apply_crosswalk(*_walk(spark, d), ["high", "medium", "low"], "medium")


@query(
    f"""WITH {_NEW}, p AS (SELECT entity_id, doc_id, row_number() OVER (PARTITION BY entity_id ORDER BY rank, doc_id) AS rank FROM pres), k AS (SELECT entity_id, count(*) AS k FROM n GROUP BY 1),
u AS (SELECT entity_id, doc_id, 2 + turn AS rank, 'added' AS a FROM n UNION ALL SELECT entity_id, doc_id, rank + CASE WHEN rank >= 3 THEN coalesce(k, 0) ELSE 0 END, 'kept' FROM p LEFT JOIN k USING (entity_id))
SELECT entity_id, doc_id, rank, CASE WHEN rank > 5 THEN 'dropped' ELSE a END AS action FROM u"""
)
def inserted_at_rank(spark, d):
    from pyspark.sql import Window as W

    declared, walk, present = _walk(spark, d)
    new = cw.apply_crosswalk(declared, walk, present, ["high", "medium", "low"], "medium")
    ranked = present.withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy("rank", "doc_id")))
    return rk.insert_at(ranked, new, 3, 5)
