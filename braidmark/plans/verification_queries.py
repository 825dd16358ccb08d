"""The battery over guides made from orders (the documents) and lineitem (their lessons, pages and overviews)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import verification as vf
from braidmark.plans.book import Book
from braidmark.session import table, written

BOOK = Book()
query = BOOK.query

# a lesson of l_linenumber n: unit 1 up to 3, else 2; four pages from 5n - 3 on, of which suppliers divisible by 9 lose one and by 10 end before they start
GUIDE = """li AS (SELECT l_orderkey AS doc, l_linenumber AS place, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS q, any_value(l_returnflag ORDER BY l_suppkey, l_partkey) AS flag FROM lineitem GROUP BY 1, 2),
les AS (SELECT doc, place, 'G1M2U' || CASE WHEN place <= 3 THEN 1 ELSE 2 END || 'L' || CASE WHEN supp % 17 = 0 THEN 1 ELSE place END AS code, CASE WHEN place <= 3 THEN 1 ELSE 2 END AS unit, place AS lesson, 1 AS grade, 2 AS module,
 5 * place - 3 AS page_start, 5 * place + CASE WHEN supp % 10 = 0 THEN -5 WHEN supp % 9 = 0 THEN 0 ELSE 1 END AS page_end, ['RL.1.' || part % 9, 'W.1.' || supp % 9 || 'a'] AS declared, CASE WHEN q > 5 THEN q::INTEGER + 30 END AS minutes,
 CASE WHEN supp % 13 = 0 THEN [] WHEN part % 4 = 0 THEN [{'s': 'Opening', 'l': 'A', 'p': place, 'n': part % 5}] ELSE [{'s': 'Opening', 'l': 'A', 'p': place, 'n': 1}, {'s': 'Work Time', 'l': 'A', 'p': part % 7, 'n': 2}, {'s': 'Closing and Assessment', 'l': 'A', 'p': 9, 'n': 1}] END AS blocks,
 part % 11 > 0 AS mat, part % 3 > 0 AS voc, CASE WHEN flag = 'R' THEN 'pymupdf' ELSE 'docling' END AS parsed_by FROM li),
pgs AS (SELECT doc, page_start AS page, CASE WHEN place % 2 = 0 THEN 'Grade ' || (1 + (minutes % 29 = 0)::INTEGER) || ': Module 2: ' ELSE '' END || 'Unit ' || unit || ': Lesson ' || lesson || ' See RL.1.' || declared[1][6:] || ' and ' || declared[2] AS text FROM les WHERE minutes IS NOT NULL
 UNION ALL SELECT doc, page_start, 'nothing printed' FROM les WHERE minutes IS NULL),
dcs AS (SELECT doc, max(5 * place + 1) AS page_count, max(5 * place + 1) + CASE WHEN doc % 97 = 0 THEN 1 ELSE 0 END AS guide_pages, CASE WHEN doc % 3 = 0 THEN count(*) END AS expected, CASE WHEN doc % 31 = 0 THEN 'fonts' END AS separation_fallback, CASE WHEN doc % 37 = 0 THEN 'engine' END AS engine_fallback FROM li GROUP BY 1),
ovs AS (SELECT doc, CASE WHEN place = 1 THEN 1 ELSE 5 * place - 3 - 1 END AS start, CASE WHEN place = 1 THEN 1 ELSE 5 * place - 3 - 1 END AS "end" FROM li WHERE place = 1 OR supp % 9 = 0)"""


def guide(spark, d):
    """lessons, pages, docs and overviews."""
    at = F.struct("l_suppkey", "l_partkey")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").alias("q"), F.min_by("l_returnflag", at).alias("flag"))
    li = written(li, "guide")  # all four are made of it
    place, supp, part = F.col("place"), F.col("supp"), F.col("part")
    unit = F.when(place <= 3, 1).otherwise(2)
    block = lambda s, p, n: F.struct(F.lit(s).alias("section"), F.lit("A").alias("letter"), p.cast("bigint").alias("page"), n.cast("bigint").alias("n_steps"))
    one, three = F.array(block("Opening", place, part % 5)), F.array(block("Opening", place, F.lit(1)), block("Work Time", part % 7, F.lit(2)), block("Closing and Assessment", F.lit(9), F.lit(1)))
    lessons = li.select(
        "doc",
        "place",
        F.concat(F.lit("G1M2U"), unit, F.lit("L"), F.when(supp % 17 == 0, 1).otherwise(place)).alias("code"),
        unit.alias("unit"),
        place.alias("lesson"),
        F.lit(1).alias("grade"),
        F.lit(2).alias("module"),
        (5 * place - 3).alias("page_start"),
        (5 * place + F.when(supp % 10 == 0, -5).when(supp % 9 == 0, 0).otherwise(1)).alias("page_end"),
        F.array(F.concat(F.lit("RL.1."), part % 9), F.concat(F.lit("W.1."), supp % 9, F.lit("a"))).alias("declared"),
        F.when(F.col("q") > 5, F.round("q").cast("int") + 30).alias("minutes"),
        F.when(supp % 13 == 0, F.slice(one, 1, 0)).when(part % 4 == 0, one).otherwise(three).alias("blocks"),
        F.when(part % 11 > 0, F.array(F.lit("paper"))).otherwise(F.array().cast("array<string>")).alias("materials"),
        F.when(part % 3 > 0, F.array(F.lit("word"))).otherwise(F.array().cast("array<string>")).alias("vocabulary"),
        F.when(F.col("flag") == "R", "pymupdf").otherwise("docling").alias("parsed_by"),
    )
    named = F.when(place % 2 == 0, F.concat(F.lit("Grade "), 1 + (F.col("minutes") % 29 == 0).cast("int"), F.lit(": Module 2: "))).otherwise("")
    printed = F.concat(named, F.lit("Unit "), "unit", F.lit(": Lesson "), "lesson", F.lit(" See RL.1."), F.substr(F.get("declared", F.lit(0)), F.lit(6)), F.lit(" and "), F.get("declared", F.lit(1)))
    pages = lessons.select("doc", F.col("page_start").alias("page"), F.when(F.col("minutes").isNotNull(), printed).otherwise("nothing printed").alias("text"))
    last, key = F.max(5 * place + 1), F.col("doc")
    docs = li.groupBy("doc").agg(last.alias("page_count"), F.count(F.lit(1)).alias("__n")).select(
        "doc", "page_count", (F.col("page_count") + F.when(key % 97 == 0, 1).otherwise(0)).alias("guide_pages"), F.when(key % 3 == 0, F.col("__n")).alias("expected"), F.when(key % 31 == 0, "fonts").alias("separation_fallback"), F.when(key % 37 == 0, "engine").alias("engine_fallback")
    )
    start = F.when(place == 1, 1).otherwise(5 * place - 4)
    overviews = li.filter((place == 1) | (supp % 9 == 0)).select("doc", start.alias("start"), start.alias("end"))
    return lessons, pages, docs, overviews


_H = """hd AS (SELECT doc, page, i, h[i] AS h FROM (SELECT doc, page, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc, page, regexp_extract_all(text, '(?i)(?:Grade\\s+(\\d+)\\s*:\\s*)?(?:Module\\s+(\\d+)\\s*:\\s*)?Unit\\s+(\\d+)\\s*:\\s*Lesson\\s+(\\d+)') AS h FROM pgs))),
hn AS (SELECT doc, page, i, TRY_CAST(regexp_extract(h, '(?i)Grade\\s+(\\d+)', 1) AS INTEGER) AS g, TRY_CAST(regexp_extract(h, '(?i)Module\\s+(\\d+)', 1) AS INTEGER) AS m, regexp_extract(h, '(?i)Unit\\s+(\\d+)', 1)::INTEGER AS unit, regexp_extract(h, '(?i)Lesson\\s+(\\d+)', 1)::INTEGER AS lesson FROM hd),
dv AS (SELECT doc, sum(n)::BIGINT AS derived FROM (SELECT doc, unit, lesson, greatest(1, count(DISTINCT CASE WHEN g IS NOT NULL AND m IS NOT NULL THEN (g, m) END)) AS n FROM hn WHERE i = 1 GROUP BY ALL) GROUP BY 1),
un AS (SELECT doc, code FROM les WHERE (doc, code) NOT IN (SELECT (les.doc, les.code) FROM les JOIN hn ON hn.doc = les.doc AND page = page_start AND hn.unit = les.unit AND hn.lesson = les.lesson AND coalesce(g = grade, true) AND coalesce(m = module, true))),
dc AS (SELECT DISTINCT doc, code, page_start, page_end, unnest(declared) AS declared FROM les WHERE parsed_by = 'docling'),
pc AS (SELECT DISTINCT doc, page, unnest(regexp_extract_all(text, '\\b([A-Z]{1,4}\\.(?:K|\\d+)\\.\\d+[a-z]{0,3})\\b', 1)) AS declared FROM pgs),
ug AS (SELECT DISTINCT doc, code, declared FROM dc WHERE (doc, code, declared) NOT IN (SELECT (dc.doc, code, dc.declared) FROM dc JOIN pc ON pc.doc = dc.doc AND pc.declared = dc.declared AND page BETWEEN page_start AND page_end)),
sg AS (SELECT doc, start, "end" FROM ovs UNION ALL SELECT doc, page_start, page_end FROM les),
sw AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM sg WHERE "end" >= start),
pf AS (SELECT dcs.doc, coalesce(n, 0) + (coalesce(last, 0) != page_count)::INTEGER AS faults FROM dcs LEFT JOIN (SELECT doc, count(*) FILTER (start != seen + 1) AS n, max("end") AS last FROM sw GROUP BY 1) USING (doc))"""


@query(f"WITH {GUIDE}, {_H} SELECT * FROM dv")
def expected_lesson_counts(spark, d):
    return vf.expected_counts(guide(spark, d)[1])


@query(f"WITH {GUIDE}, {_H} SELECT * FROM pf")
def page_partition(spark, d):
    lessons, _, docs, overviews = guide(spark, d)
    return vf.partition_faults(overviews.unionByName(lessons.select("doc", F.col("page_start").alias("start"), F.col("page_end").alias("end"))), docs)


@query(f"WITH {GUIDE}, {_H} SELECT * FROM un")
def header_mismatches(spark, d):
    lessons, pages, *_ = guide(spark, d)
    return vf.unconfirmed(lessons, pages).select("doc", "code")


@query(f"WITH {GUIDE}, {_H} SELECT * FROM ug")
def ungrounded_codes(spark, d):
    lessons, pages, *_ = guide(spark, d)
    return vf.ungrounded_codes(lessons, pages)


def _second(lessons):
    """A second division that sees other minutes in some lessons."""
    return lessons.withColumn("minutes", F.when(F.col("page_end") % 5 == 0, 0).otherwise(F.col("minutes")))


_D = "dg AS (SELECT doc, code FROM les a WHERE parsed_by = 'docling' AND NOT EXISTS (SELECT 1 FROM les b WHERE b.doc = a.doc AND b.code = a.code AND b.place = a.place AND (b.page_end % 5 != 0 OR a.minutes = 0)))"


@query(f"WITH {GUIDE}, {_D} SELECT * FROM dg")
def division_disagreements(spark, d):
    """Lessons of repeated codes too; a second division that lacks lessons is tested on its own."""
    lessons = guide(spark, d)[0]
    return vf.disagreements(lessons, _second(lessons))


_BATTERY = f"""WITH {GUIDE}, {_H}, fl AS (SELECT *, coalesce(page_start <= lag(page_start) OVER (PARTITION BY doc ORDER BY place), false) AS v3, coalesce(lead(page_start) OVER (PARTITION BY doc, unit ORDER BY place) != page_end + 1, false) AS v6,
 NOT list_has_all(list_transform(blocks, lambda b: b.s), ['Opening', 'Work Time', 'Closing and Assessment']) AS v8 FROM les),
pr AS (SELECT doc, count(*) AS n, count(*) - count(DISTINCT code) AS v5, count(*) FILTER (parsed_by = 'docling') AS ne, count(*) FILTER (v3) AS v3, count(*) FILTER (page_end < page_start) AS v4, count(*) FILTER (v6) AS v6, count(*) FILTER (v8) AS v8, count(*) FILTER (len(blocks) = 0) AS v8b,
 count(*) FILTER (len(list_filter(blocks, lambda b: b.p = 0)) > 0) AS v13, count(*) FILTER (len(list_filter(blocks, lambda b: b.n = 0)) > 0) AS v14, count(*) FILTER (minutes NOT BETWEEN 45 AND 75) AS v9, count(*) FILTER (NOT mat) AS v11, count(*) FILTER (NOT voc) AS v12 FROM fl GROUP BY 1),
al AS MATERIALIZED (SELECT * FROM dcs LEFT JOIN pr USING (doc) LEFT JOIN dv USING (doc) LEFT JOIN pf USING (doc) LEFT JOIN (SELECT doc, count(*) AS v7 FROM un GROUP BY 1) USING (doc) LEFT JOIN (SELECT doc, count(*) AS v10 FROM ug GROUP BY 1) USING (doc)),
ck AS MATERIALIZED (SELECT doc, 'V0 separation fallback' AS name, 'soft' AS severity, 1 AS n_bad FROM al WHERE separation_fallback IS NOT NULL UNION ALL SELECT doc, 'V0 content fallback', 'soft', 1 FROM al WHERE engine_fallback IS NOT NULL
 UNION ALL SELECT doc, 'V1 lesson count', 'hard', (n != coalesce(expected, derived))::INTEGER FROM al WHERE coalesce(expected, derived) IS NOT NULL UNION ALL SELECT doc, 'V1 lesson count skipped', 'soft', 1 FROM al WHERE coalesce(expected, derived) IS NULL
 UNION ALL SELECT doc, 'V16 page count', 'hard', 1 FROM al WHERE guide_pages != page_count UNION ALL SELECT doc, 'V2 pages partitioned', 'hard', faults FROM al UNION ALL SELECT doc, 'V3 starts rise', 'hard', v3 FROM al UNION ALL SELECT doc, 'V4 no reversed span', 'hard', v4 FROM al
 UNION ALL SELECT doc, 'V5 codes unique', 'hard', v5 FROM al UNION ALL SELECT doc, 'V6 contiguous in units', 'hard', v6 FROM al UNION ALL SELECT doc, 'V7 headers match', 'hard', coalesce(v7, 0) FROM al UNION ALL SELECT doc, 'V8 required blocks', 'soft', v8 FROM al
 UNION ALL SELECT doc, 'V8b some blocks', 'hard', v8b FROM al UNION ALL SELECT doc, 'V13 blocks located', 'hard', v13 FROM al UNION ALL SELECT doc, 'V14 blocks have steps', 'soft', v14 FROM al UNION ALL SELECT doc, 'V9 minutes in band', 'soft', v9 FROM al
 UNION ALL SELECT doc, 'V11 materials', 'hard', v11 FROM al UNION ALL SELECT doc, 'V12 vocabulary', 'soft', v12 FROM al UNION ALL SELECT doc, 'V10 codes grounded', 'hard', coalesce(v10, 0) FROM al WHERE ne > 0)"""


@query(_BATTERY + " SELECT doc, name, severity, n_bad::BIGINT AS n_bad, n_bad = 0 AS passed FROM ck")
def verification_battery(spark, d):
    return vf.battery(*guide(spark, d))


_VERDICT = "SELECT doc, CASE WHEN count(*) FILTER (severity = 'hard' AND n_bad > 0) = 0 THEN 'GO' ELSE 'BLOCK' END AS verdict, count(*) AS checks, count(*) FILTER (severity = 'hard' AND n_bad > 0) AS fail_count, count(*) FILTER (severity = 'soft' AND n_bad > 0) AS warn_count FROM ck GROUP BY 1"


@query(f"{_BATTERY} {_VERDICT}")
def verification_verdict(spark, d):
    return vf.verdicts(vf.battery(*guide(spark, d)))


@query(f"{_BATTERY}, vd AS ({_VERDICT}) SELECT doc, code, place FROM les WHERE doc IN (SELECT doc FROM vd WHERE verdict = 'GO')")
def published_lessons(spark, d):
    made = guide(spark, d)
    return vf.published(made[0], vf.verdicts(vf.battery(*made))).select("doc", "code", "place")


@query("WITH p AS (SELECT conv_id AS doc, turn + 1 AS page, text FROM conversations), n AS (SELECT doc, max(page) AS n FROM p GROUP BY 1), t AS (SELECT p.* FROM p JOIN n USING (doc) WHERE (page - 1) % greatest(1, n // 24) = 0) SELECT doc, count(*) AS sampled, round_even(avg((length(trim(coalesce(text, ''))) >= 50)::INTEGER), 6) AS coverage, round_even(avg((length(trim(coalesce(text, ''))) >= 50)::INTEGER), 6) >= 0.8 AS has_text FROM t GROUP BY 1")
def text_layer(spark, d):
    return vf.text_layer(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text"))
