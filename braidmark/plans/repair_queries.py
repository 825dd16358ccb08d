"""Clean-up of page texts and nested records, query arms, evidence pages, review flags: records made of conversations, documents and parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.operators import records as rc
from braidmark.operators import structure as st
from braidmark.operators import verdicts as vd
from braidmark.plans import retrieval_queries as rq
from braidmark.plans.book import Book
from braidmark.plans.rollup_queries import _FOLDED, _STITCH
from braidmark.session import checkpoint_dir, table
from braidmark.sources import tables as src

BOOK = Book()
query = BOOK.query

_Q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_SPACED = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def turns(spark, d):
    """Rows of a conversation, numbered."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("entity_id"), n.alias("at"), "turn", "role", "text")


_TURNS = "tn AS (SELECT conv_id AS entity_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS spot, turn, role, text FROM conversations)"


@query(
    """WITH p AS (SELECT doc_id, replace(text, 'en ', 'en-' || chr(10)) || ' read-aloud (20' || chr(10) || 'minutes) • RL.1.' || chr(10) || '2 read-' || chr(10) || 'aloud 4-' || chr(10) || '5' AS t FROM documents),
u AS (SELECT doc_id, list_reduce(list_prepend(t, regexp_extract_all(t, '(\\w+)-\\s*\\n\\s*(\\w+)')), lambda acc, w: replace(acc, w, regexp_extract(w, '^(\\w+)-', 1)
 || CASE WHEN contains(t, regexp_extract(w, '^(\\w+)-', 1) || '-' || regexp_extract(w, '(\\w+)$', 1)) OR (regexp_matches(w, '^\\d+-') AND regexp_matches(w, '\\s\\d+$')) THEN '-' ELSE '' END || regexp_extract(w, '(\\w+)$', 1))) AS t FROM p),
v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '-\\s*\\n\\s*', '', 'g'), '\\((\\d+)\\s*\\n\\s*(minutes?\\))', '(\\1 \\2', 'g'), '\\b([A-Z]{1,4}\\.(?:K|\\d+)\\.)\\s*\\n\\s*(\\d+[a-z]?)\\b', '\\1\\2', 'g') AS t FROM u)
SELECT doc_id, length(x) AS n, md5(x) AS md5 FROM (SELECT doc_id, trim(regexp_replace(replace(t, '•', ' '), '\\s+', ' ', 'g')) AS x FROM v)"""
)
def page_texts(spark, d):
    """Documents whose lines break in words, minutes, codes and number ranges."""
    t = F.concat(F.replace("text", F.lit("en "), F.lit("en-\n")), F.lit(" read-aloud (20\nminutes) • RL.1.\n2 read-\naloud 4-\n5"))
    clean = table(spark, d, "documents").select("doc_id", rc.clean_page_text(t).alias("x"))
    return clean.select("doc_id", F.length("x").alias("n"), F.md5("x").alias("md5"))


@query(
    f"""WITH {_TURNS}, s AS (SELECT *, {_FOLDED.format(x="text")} AS f, '(page ' || turn || ') ' || {_FOLDED.format(x="text")} AS page FROM tn),
n AS (SELECT entity_id, spot, CASE WHEN regexp_matches(f, '{_STITCH}') THEN list_filter(list_transform(string_split_regex(f, '{_STITCH}'), lambda x: trim(x)), lambda x: length(x) >= 12)[1] ELSE f END AS needle FROM s)
SELECT n.entity_id, n.spot AS "at", (SELECT arg_min(turn, s.spot) FROM s WHERE s.entity_id = n.entity_id AND n.needle != '' AND contains(s.page, n.needle))::INTEGER AS page FROM n"""
)
def evidence_pages(spark, d):
    """Each turn as a quote of its conversation, whose turns are the pages."""
    t = turns(spark, d)
    page = F.struct("at", F.concat(F.lit("(page "), F.col("turn"), F.lit(")\n"), "text").alias("x"))
    source = t.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["x"]), "\n").alias("source"))
    return t.join(source, "entity_id").select("entity_id", "at", vd.page_of(F.col("text"), F.col("source")).alias("page"))


_RATIONALE = "CASE l_linenumber % 4 WHEN 0 THEN 'Students retell. The ' || p_name || ' must occur while reading. Done well!' WHEN 1 THEN 'Any one of the separable ' || p_name WHEN 2 THEN p_name ELSE 'It is partial because it happens after reading only' END"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim({_RATIONALE}) AS rat, CASE WHEN l_tax > 0.05 THEN 'low' ELSE 'high' END AS conf, l_discount > 0.08 AS rejected, l_linestatus = 'O' AS needs, CASE WHEN l_quantity > 30 THEN 'Grounding Rejection' ELSE ' ' END AS own, CASE l_returnflag WHEN 'R' THEN 'partial' ELSE 'full' END AS status, p_brand AS code FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, regexp_matches(rat, {_Q(vd.TIMING_GATE)}) AS timing, regexp_matches(rat, {_Q(vd.WAFFLE_OR)}) AS a, regexp_matches(rat, {_Q(vd.WAFFLE_ALL)}) AS b,
 array_to_string(list_filter(list_transform(string_split(regexp_replace(rat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda p: p != '' AND NOT regexp_matches(p, {_Q(vd.TIMING_GATE)}) AND NOT (regexp_matches(p, {_Q(vd.TIMING_WORDS)}) AND regexp_matches(p, {_Q(vd.SCORE_WORDS)}))), ' ') AS rest FROM r),
g AS (SELECT *, list_filter([CASE WHEN needs THEN CASE WHEN trim(own) != '' THEN trim(own) ELSE 'overlay review trigger' END END, CASE WHEN conf = 'low' THEN 'confidence=low' END, CASE WHEN rejected THEN 'grounding rejection' END,
 CASE WHEN (a AND b) OR (code IN ('Brand#11', 'Brand#23') AND status = 'partial' AND (a OR b)) THEN 'list-standard waffle (OR vs separable)' END, CASE WHEN timing THEN 'invented while/after-reading timing (P5)' END], lambda x: x IS NOT NULL) AS given FROM s),
h AS (SELECT *, array_to_string(list_filter(given, lambda x, i: len(list_filter(given[1:i - 1], lambda q: lower(q) = lower(x))) = 0), '; ') AS why FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN timing THEN CASE WHEN rest = '' THEN {_Q(vd.TIMING_EMPTY)} ELSE rest END || ' ' || {_Q(vd.TIMING_NOTE)} ELSE rat END AS rationale, why AS review_reason, why != '' AS needs_review FROM h"""
)
def reviewed_rationales(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    r = li.withColumns(
        {
            "rationale": F.expr(_RATIONALE),
            "confidence": F.when(F.col("l_tax") > 0.05, " Low").otherwise("high"),
            "rejected": F.col("l_discount") > 0.08,
            "needs_review": F.col("l_linestatus") == "O",
            "review_reason": F.when(F.col("l_quantity") > 30, "Grounding Rejection").otherwise(" "),
            "status": F.when(F.col("l_returnflag") == "R", "partial").otherwise("full"),
            "doc_id": F.col("p_brand"),
            "invented_timing": vd.invents_timing(F.expr(_RATIONALE)),
        }
    )
    out = vd.review_flags(r, ["Brand#11", "Brand#23"]).withColumn("rationale", vd.scrubbed_timing(F.col("rationale")))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rationale", "review_reason", "needs_review")


_GUIDED = "CASE role WHEN 'system' THEN '[note] ' ELSE CASE WHEN turn % 3 = 0 THEN 'Focused Read-aloud Guide' || chr(10) WHEN turn % 3 = 1 THEN 'see the Close Read-aloud Guide' || chr(10) ELSE '' END || CASE role WHEN 'user' THEN 'Ask: ' ELSE '' END END || text"


@query(
    f"""WITH {_TURNS}, x AS (SELECT entity_id, string_agg({_GUIDED}, chr(10) ORDER BY spot) AS src, count(*) AS n FROM tn GROUP BY 1),
l AS (SELECT entity_id, unnest(string_split(src, chr(10))) AS y, unnest(range(1, len(string_split(src, chr(10))) + 1)) AS i FROM x),
m AS (SELECT *, regexp_matches(y, {_Q(vd.GUIDE_TITLE)}) AND NOT regexp_matches(y, {_Q(vd.GUIDE_POINTER)}) AS title, starts_with(y, '[') AND contains(substr(y, 1, 40), ']') AS out FROM l),
w AS (SELECT *, coalesce(last_value(CASE WHEN title THEN true WHEN out THEN false END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY i), false) AS inside FROM m),
q AS (SELECT entity_id, count(*) FILTER (inside AND NOT title AND regexp_matches(y, {_Q(vd.QUESTION_LINE)})) AS questions FROM w GROUP BY 1)
SELECT entity_id, CASE WHEN n % 2 = 0 AND regexp_matches(src, {_Q(vd.GUIDE)}) AND questions < 3 THEN {_Q(vd.SCOPE_CAVEAT)} ELSE '' END AS caveat FROM x JOIN q USING (entity_id)"""
)
def scope_caveats(spark, d):
    rows = turns(spark, d).select("entity_id", F.struct("at", F.expr(_GUIDED.replace("chr(10)", "'\\n'")).alias("x")).alias("r"))
    per = rows.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "\n").alias("src"), F.count(F.lit(1)).alias("n"))
    return per.select("entity_id", vd.scope_caveat(F.when(F.col("n") % 2 == 0, " A1 ").otherwise("A2"), F.col("src"), ["A1"]).alias("caveat"))


_CUT = "CASE WHEN length(t) <= 360 THEN t WHEN length(regexp_extract(substr(t, 1, 360), '(?s)^(.*[.?;])\\s', 1)) > 180 THEN regexp_extract(substr(t, 1, 360), '(?s)^(.*[.?;])\\s', 1) ELSE trim(regexp_replace(substr(t, 1, 360), '\\s\\S*$', '')) END"


@query(
    f"""WITH RECURSIVE {_TURNS}, i AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS priority, {_SPACED.format(x="text")} AS t FROM tn), c AS (SELECT *, {_CUT} AS x FROM i),
k AS (SELECT entity_id, spot, role, priority, x, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS key, list_filter(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN {rc.BOILERPLATE}) AS words, row_number() OVER (PARTITION BY entity_id ORDER BY spot) AS n FROM c WHERE length(x) >= 12),
w AS (SELECT entity_id, 0::BIGINT AS n, list({{'spot': spot, 'role': role, 'priority': priority, 'x': x, 'key': key, 'words': words}}) FILTER (false) AS kept FROM k GROUP BY 1
UNION ALL SELECT k.entity_id, k.n, CASE WHEN coalesce(len(list_filter(kept, lambda y: y.key = k.key OR (len(y.words) > 0 AND len(k.words) > 0 AND (len(list_intersect(y.words, k.words)) >= 0.88::DOUBLE * len(list_distinct(list_concat(y.words, k.words))) OR len(list_intersect(y.words, k.words)) >= 0.88::DOUBLE * least(len(y.words), len(k.words)))))), 0) > 0
 THEN kept ELSE list_append(kept, {{'spot': k.spot, 'role': k.role, 'priority': k.priority, 'x': k.x, 'key': k.key, 'words': k.words}}) END FROM w JOIN k ON k.entity_id = w.entity_id AND k.n = w.n + 1),
z AS (SELECT entity_id, unnest(arg_max(kept, n)) AS y FROM w GROUP BY entity_id)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY y.priority, y.spot) AS query_index, y.role AS source, y.x AS text FROM z QUALIFY query_index <= 24"""
)
def record_arms(spark, d):
    """A conversation's turns as arms: system, then user, then assistant."""
    t = turns(spark, d).withColumns({"source": F.col("role"), "priority": F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)})
    return rc.query_arms(t)


_GLUE = ("a", "and", "of", "the", "to")


@query(
    f"""WITH {rq.bm25_sql("benchmark", "item_id", 20)}, p AS (SELECT item_id, hit.doc_id, trim(coalesce(b.text, '')) AS whole, list_distinct(regexp_extract_all(lower(coalesce(dc.text, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)*')) AS own FROM hit JOIN benchmark b USING (item_id) JOIN documents dc ON dc.doc_id = hit.doc_id),
f AS (SELECT item_id, doc_id, own, unnest(list_distinct(list_concat(list_filter(list_transform(string_split_regex(regexp_replace(whole, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\n;]+|·|\\s{{2,}}|\\s+,\\s+and\\s+'), lambda x: trim(x, ' -.' || chr(9))), lambda x: length(x) >= 12), [whole]))) AS frag FROM p),
g AS (SELECT item_id, doc_id, own, list_filter(list_distinct(regexp_extract_all(lower(frag), '[a-z0-9]+(?:\\.[a-z0-9]+)*')), lambda w: w NOT IN {_GLUE}) AS bag FROM f),
h AS (SELECT item_id, doc_id, len(bag) AS n, len(list_intersect(bag, own)) AS hits FROM g)
SELECT item_id AS query_id, doc_id, round(max(CASE WHEN n < 2 OR hits = 0 OR (hits < 2 AND n >= 4) THEN 0.0 ELSE hits / n * CASE WHEN n <= 2 THEN 0.25 WHEN n = 3 THEN 0.55 ELSE 1.0 END END), 6)::DOUBLE AS skill_overlap FROM h GROUP BY 1, 2"""
)
def skill_overlaps(spark, d):
    """Items as focus of the documents that BM25 finds for them."""
    hits = rq.bm25_top(spark, d).select("query_id", "doc_id")
    focus = rq.items(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("focus"))
    out = rc.skill_overlap(hits.join(focus, "query_id").join(rq.docs(spark, d).select("doc_id", "text"), "doc_id"), "focus", "text", _GLUE)
    return out.select("query_id", "doc_id", F.round("skill_overlap", 6).alias("skill_overlap"))


_PRINTED = "CASE doc_id % 3 WHEN 0 THEN (doc_id * 7 % 5000) || chr(10) || text WHEN 1 THEN text || chr(10) || 'EL curriculum ' || (doc_id * 11 % 10000) || chr(10) || ' ' ELSE text END"


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_PRINTED}, chr(10)), lambda x: trim(x)), lambda x: x != '') AS l FROM documents), e AS (SELECT doc_id, list_filter(l, lambda x, i: i <= 6 OR i > len(l) - 6) AS l FROM l),
n AS (SELECT doc_id, list_filter(list_transform(l, lambda x: coalesce(nullif(regexp_extract(x, '^(\\d{{1,4}})$', 1), ''), nullif(regexp_extract(x, '(?i)Curriculum\\s+(\\d{{1,4}})\\s*$', 1), ''))), lambda x: x IS NOT NULL) AS n FROM e)
SELECT doc_id AS doc, 1 AS page, n[-1]::INTEGER AS printed FROM n"""
)
def printed_numbers(spark, d):
    """Documents as pages, with a number above, or after the curriculum's name below."""
    text = F.expr(_PRINTED.replace("chr(10)", "'\\n'"))
    return st.printed_page(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), text.alias("text")))


@query(
    f"""WITH x AS (SELECT doc_id, 'Title' || chr(10) || ' Materials ' || chr(10) || text || chr(10) || '12' || chr(10) || 'Vocabulary' || chr(10) || lang || chr(10) || 'Prepare the room' AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS y, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM x),
h AS (SELECT *, CASE WHEN trim(y) IN ('Materials', 'Vocabulary') THEN trim(y) END AS head, last_value(CASE WHEN trim(y) IN ('Materials', 'Vocabulary') THEN trim(y) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id AS doc, section, count(*) AS n, md5(string_agg(trim(y), '|' ORDER BY i)) AS items FROM h WHERE section IS NOT NULL AND head IS NULL AND trim(y) != '' AND NOT regexp_matches(trim(y), {_Q(rc.FURNITURE)}) AND NOT regexp_matches(trim(y), {_Q(rc.PREPARATION)}) GROUP BY 1, 2"""
)
def section_items(spark, d):
    """Documents between a header of materials and one of vocabulary."""
    t = F.concat(F.lit("Title\n Materials \n"), "text", F.lit("\n12\nVocabulary\n"), "lang", F.lit("\nPrepare the room"))
    out = st.section_bodies(st.lines(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), t.alias("t")), "doc", "t"), ["Materials", "Vocabulary"])
    return out.select("doc", "section", F.size("items").cast("bigint").alias("n"), F.md5(F.array_join("items", "|")).alias("items"))


_ROLES = (*rc.ACTORS, "other")
_QUOTE = "CASE WHEN turn % 5 = 4 THEN ' (RL.1.2)' WHEN turn % 3 = 1 THEN text || ' Are you ready to begin writing?' ELSE text END"
_ROLE = "CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ROLES)) + " END"
_ACTOR = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rc.ACTORS.items()) + " ELSE role END"
_DEMOTED = lambda name, value: f"CASE WHEN list_contains(coalesce(e.covered, []), '{name}') THEN '{value}' ELSE '{rc.NONE_OBSERVED}' END AS {name}"


@query(
    f"""WITH {_TURNS}, q AS (SELECT *, {_QUOTE} AS quote, {_ROLE} AS r, CASE WHEN turn % 2 = 0 THEN ['oral', 'written'] ELSE ['oral'] END AS sup FROM tn),
e AS (SELECT entity_id, count(*) AS n_evidence, string_agg({_ACTOR}, ',' ORDER BY spot) AS actors, coalesce(list_distinct(flatten(list(CASE WHEN regexp_matches(quote, {_Q(rc.READINESS)}) THEN [] ELSE sup END))), []) AS covered, coalesce(sum(CASE WHEN regexp_matches(quote, {_Q(rc.READINESS)}) THEN 0 ELSE len(sup) END), 0)::BIGINT AS n_supports FROM q WHERE turn % 5 != 4 AND trim(regexp_replace(quote, '\\s+', ' ', 'g')) != '' GROUP BY 1),
m AS (SELECT entity_id, {_SPACED.format(x="text")} AS x, spot FROM tn WHERE trim(coalesce(text, '')) != '' AND NOT regexp_matches(trim(text), {_Q(rc.FURNITURE)}) AND NOT regexp_matches(trim(text), {_Q(rc.PREPARATION)})),
o AS (SELECT entity_id, x, spot FROM m WHERE x != '' QUALIFY row_number() OVER (PARTITION BY entity_id, lower(x) ORDER BY spot) = 1), mt AS (SELECT entity_id, md5(string_agg(x, '|' ORDER BY spot)) AS materials FROM o GROUP BY 1),
g AS (SELECT entity_id, count(*) AS n, coalesce(sum(CASE WHEN turn % 4 != 3 THEN turn * 5 END), 0) AS minutes, arg_min(role, spot) AS first, string_agg(text, ' ' ORDER BY spot) || CASE WHEN count(*) % 2 = 0 THEN ' sound out' ELSE '' END AS src FROM tn GROUP BY 1)
SELECT g.entity_id, CASE WHEN minutes > 0 THEN minutes || ' minutes' ELSE '' END AS pacing, coalesce(n_evidence, 0) AS n_evidence, coalesce(actors, '') AS actors, coalesce(n_supports, 0) AS n_supports, CASE WHEN regexp_matches(src, {_Q(rc.PHONICS)}) OR n % 5 = 0 THEN 'Drama' ELSE 'No phonics today|Drama|Decoding left' END AS not_taught,
 coalesce(materials, md5('')) AS materials, {_DEMOTED("oral", "say it")}, {_DEMOTED("written", "write it")}, {_DEMOTED("drawn", "draw")}, 'Read ' || first AS objective FROM g LEFT JOIN e USING (entity_id) LEFT JOIN mt USING (entity_id)"""
)
def repaired_lessons(spark, d):
    """A conversation as a lesson: turns as agenda, evidence and materials."""
    t = turns(spark, d)
    item = F.struct(F.expr(_QUOTE).alias("quote"), F.col("role").alias("actor"), F.expr(_ROLE).alias("evidence_role"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("oral"), F.lit("written"))).otherwise(F.array(F.lit("oral"))).alias("supports_action"))
    row = F.struct("at", "role", "text", F.when(F.col("turn") % 4 != 3, F.col("turn").cast("int") * 5).alias("minutes"), item.alias("item"))
    g = t.groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n = F.size("rows")
    text = F.array_join(F.transform("rows", lambda r: r["text"]), " ")
    lessons = g.select(
        "entity_id",
        F.transform("rows", lambda r: F.struct(r["minutes"].alias("minutes"))).alias("agenda"),
        F.transform("rows", lambda r: r["item"]).alias("evidence"),
        F.array(F.lit("No phonics today"), F.lit("Drama"), F.lit("Decoding left (RL.1.2)")).alias("not_taught"),
        F.when(n % 2 == 0, F.concat(text, F.lit(" sound out"))).otherwise(text).alias("source_text"),
        F.array(F.when(n % 5 == 0, "Phonics").otherwise("Reading")).alias("strands"),
        F.transform("rows", lambda r: r["text"]).alias("materials"),
        F.create_map(F.lit("oral"), F.lit("say it"), F.lit("written"), F.lit("write (RL.1.2) it"), F.lit("drawn"), F.lit("draw")).alias("actions"),
        F.concat(F.lit("Read "), F.get("rows", F.lit(0))["role"], F.lit(" (RL.1.2, W.K.1)")).alias("objective"),
    )
    out = rc.clean_lesson(lessons)
    supports = F.aggregate("evidence", F.lit(0), lambda a, e: a + F.size(e["supports_action"])).cast("bigint")
    actors = F.array_join(F.transform("evidence", lambda e: e["actor"]), ",")
    actions = [F.col("actions")[k].alias(k) for k in ("oral", "written", "drawn")]
    return out.select("entity_id", "pacing", F.size("evidence").cast("bigint").alias("n_evidence"), actors.alias("actors"), supports.alias("n_supports"), F.array_join("not_taught", "|").alias("not_taught"), F.md5(F.array_join("materials", "|")).alias("materials"), *actions, "objective")


_STEP = "text || CASE turn % 4 WHEN 0 THEN ' Invite students to write it down.' WHEN 1 THEN ' Invite students to draw from this language.' WHEN 2 THEN ' Students begin drawing in the next lesson' ELSE ' Have students to draw on it; have students to draw the sun' END"
_DRAW = r"(?:invite|have)\s+students\s+to\s+draw\b"
_DRAWS = _DRAW + r"(?!\s+from\b)(?!\s+on\b)(?!\s+upon\b)|"


@query(
    f"""WITH {_TURNS}, s AS (SELECT *, trim({_STEP}) AS t FROM tn WHERE role != 'system'),
h AS (SELECT * FROM s WHERE (regexp_matches(t, {_Q(rc.WRITTEN.replace(_DRAWS, ""))}) OR len(list_filter(regexp_extract_all(t, {_Q("(?is)" + _DRAW + r"(?:\s+(?:from|on|upon)\b)?")}), lambda x: regexp_matches(x, '(?i)draw$'))) > 0) AND NOT regexp_matches(t, {_Q(rc.NOT_WRITTEN)}))
SELECT entity_id, 'Work Time' AS section, 'B' AS letter, t AS step_text FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY turn, spot) = 1"""
)
def written_production(spark, d):
    """The first turn of a conversation that has students write or draw; those of the system have no section."""
    section = F.when(F.col("role") == "system", " ").otherwise("Work Time")
    return rc.written_steps(turns(spark, d).select("entity_id", F.col("turn").alias("block"), section.alias("section"), F.lit("B").alias("letter"), F.col("at").alias("step"), F.expr(_STEP).alias("text")))


_CLEAN = "list_filter({y}, lambda x, i: x != '' AND len(list_filter({y}[1:i - 1], lambda q: lower(q) = lower(x))) = 0)"


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, 'C' || p_partkey AS code, list_transform(list_concat(string_split(p_name, ' '), [upper(string_split(p_name, ' ')[1]), '  ', p_type || '  x', p_type || ' x']), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS y,
 [lower(p_brand), p_type, upper(p_type), '', p_name] AS z, CASE p_size % 3 WHEN 0 THEN ['C' || p_partkey, 'X'] WHEN 1 THEN ['X'] END AS own FROM part)
SELECT p_partkey, array_to_string({_CLEAN.format(y="y")}, '|') AS terms, array_to_string(CASE WHEN list_contains(coalesce(own, []), code) THEN own ELSE list_prepend(code, coalesce(own, [])) END, '|') AS exact_codes, array_to_string(list_filter({_CLEAN.format(y="z")}, lambda x: lower(x) != lower(p_brand)), '|') AS domain_secondary FROM p"""
)
def clean_standards(spark, d):
    size, code = F.col("p_size"), F.concat(F.lit("C"), F.col("p_partkey"))
    first = F.split("p_name", " ")
    p = table(spark, d, "part").select(
        "p_partkey",
        code.alias("code"),
        F.concat(first, F.array(F.upper(F.get(first, F.lit(0))), F.lit("  "), F.concat("p_type", F.lit("  x")), F.concat("p_type", F.lit(" x")))).alias("terms"),
        F.when(size % 3 == 0, F.array(code, F.lit("X"))).when(size % 3 == 1, F.array(F.lit("X"))).alias("exact_codes"),
        F.col("p_brand").alias("domain_primary"),
        F.array(F.lower("p_brand"), F.col("p_type"), F.upper("p_type"), F.lit(""), F.col("p_name")).alias("domain_secondary"),
    )
    join = lambda c: F.array_join(c, "|").alias(c)
    return rc.clean_standard(p, ["terms"]).select("p_partkey", join("terms"), join("exact_codes"), join("domain_secondary"))


@query("SELECT l_orderkey AS entity_id, sum(CASE WHEN l_linenumber % 3 != 0 THEN l_suppkey % 60 END)::BIGINT AS minutes, CASE WHEN coalesce(sum(CASE WHEN l_linenumber % 3 != 0 THEN l_suppkey % 60 END), 0) > 0 THEN sum(CASE WHEN l_linenumber % 3 != 0 THEN l_suppkey % 60 END) || ' minutes' ELSE '' END AS pacing FROM lineitem GROUP BY 1")
def lesson_pacing(spark, d):
    """An order's lines as an agenda, of which every third prints no minutes."""
    item = F.struct(F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_suppkey") % 60).cast("int")).alias("minutes"))
    agenda = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.collect_list(item).alias("agenda"))
    return agenda.select("entity_id", rc.total_minutes(F.col("agenda")).cast("bigint").alias("minutes"), rc.pacing(F.col("agenda")).alias("pacing"))


@query(f"SELECT doc_id, md5(translate(text || ' “a” – b', {_Q(rc.FOLD_FROM)}, {_Q(rc.FOLD_TO)})) AS text, md5(array_to_string(list_transform(string_split(text || ' ‘c’ — d', ' '), lambda x: translate(x, {_Q(rc.FOLD_FROM)}, {_Q(rc.FOLD_TO)})), '|')) AS words FROM documents")
def folded_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" “a” – b")).alias("text"), F.split(F.concat("text", F.lit(" ‘c’ — d")), " ").alias("words"))
    return rc.folded(docs, ["text", "words"]).select("doc_id", F.md5("text").alias("text"), F.md5(F.array_join("words", "|")).alias("words"))


_HEADED = "CASE p_size % 4 WHEN 0 THEN 'Opening: ' || p_name WHEN 1 THEN 'Work Time & ' || p_type WHEN 2 THEN 'Closing ' || p_brand ELSE p_name END"


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Opening' WHEN 1 THEN 'Work Time' WHEN 2 THEN 'Closing and Assessment' END AS section, regexp_replace(lower({_HEADED}), '[^a-z0-9]', '', 'g') AS key FROM part")
def section_keys(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.expr(_HEADED).alias("t"))
    return part.select("p_partkey", rc.canonical_section(F.col("t")).alias("section"), rc.lenient_key(F.col("t")).alias("key"))


@query("SELECT doc_id::VARCHAR AS doc_id, source, md5(CASE WHEN lang = 'fr' THEN '''= \"' || text || '\" \\ ' WHEN substr(text, 1, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE coalesce(text, '') END) AS text FROM documents WHERE lang != 'de'")
def alignment_sheets(spark, d):
    """Documents as a sheet, French texts as formulas with quotes, German rows with a blank key; written and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    key = F.when(F.col("lang") == "de", " ").otherwise(F.col("doc_id").cast("string"))
    text = F.when(F.col("lang") == "fr", F.concat(F.lit('= "'), "text", F.lit('" \\ '))).otherwise(F.coalesce("text", F.lit("")))
    src.write_report(table(spark, d, "documents").select(key.alias("doc_id"), "source", text.alias("text")), path, ["doc_id", "source", "text"], ["text"])
    out = src.read_alignments(spark, path, "doc_id STRING, source STRING, text STRING", ["doc_id", "source"])
    return out.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


_STATUS = "CASE l_returnflag WHEN 'R' THEN 'full' WHEN 'A' THEN 'partial' ELSE 'none' END"


@query(f"SELECT 'g' || l_orderkey AS gold_id, 'e' || o_custkey AS entity_id, 'p' || l_partkey || '.' || l_linenumber AS doc_id, {_STATUS} AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A')")
def gold_from_markdown(spark, d):
    """Orders as headings of Markdown files, their lines as table rows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    row = F.concat(F.lit("| p"), "l_partkey", F.lit("."), "l_linenumber", F.lit(" | "), F.expr(_STATUS), F.lit(" |"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    head = F.concat(F.lit("# g"), "o_orderkey", F.lit(": e"), "o_custkey")
    table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat_ws("\n", head, F.lit("| code | status |"), "rows")).write.text(path)
    return src.gold_of_markdown(spark, path)


@query(f"SELECT l_orderkey::VARCHAR AS entity_id, CASE WHEN l_suppkey % 5 != 0 THEN l_partkey::VARCHAR END AS doc_id, {_STATUS} AS status FROM lineitem WHERE l_suppkey % 5 != 0 AND l_returnflag IN ('R', 'A')")
def gold_lines(spark, d):
    """Lines as JSON, some without a document, written and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/gold-{uuid.uuid4().hex}"
    doc = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey").cast("string"))
    table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("entity_id"), doc.alias("doc_id"), F.expr(_STATUS).alias("status")).write.json(path)
    return src.read_gold(spark, path, ["entity_id", "doc_id"], "status")


@query("SELECT p_partkey::VARCHAR AS code, p_name AS name, p_brand AS brand FROM part WHERE p_size % 4 != 0")
def master_rows(spark, d):
    """Parts as a corrected table, of which every fourth size has no code."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/master-{uuid.uuid4().hex}"
    code = F.when(F.col("p_size") % 4 != 0, F.col("p_partkey").cast("string")).otherwise(" ")
    src.write_report(table(spark, d, "part").select(code.alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), path, ["code", "name", "brand"], ["name"])
    return src.read_master(spark, path, ["code", "name"], ["code"])
