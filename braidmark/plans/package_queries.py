"""Correlation package, assembled texts and record clean-up over part, lineitem and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidmark.operators import correlation as co
from braidmark.operators import records as rc
from braidmark.operators import texts as tx
from braidmark.plans.book import Book
from braidmark.session import table

BOOK = Book()
query = BOOK.query

STD = "std AS (SELECT 'P' || p_partkey AS code, 'substandard' AS level, p_brand AS parent_code, p_name || ' (I/C).' AS text FROM part)"
ALN = """aln AS (SELECT l_orderkey AS entity_id, 'P' || l_partkey AS doc_id, l_linenumber AS i, CASE l_returnflag WHEN 'R' THEN ' Full' WHEN 'A' THEN 'partial' ELSE 'none' END AS status, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS page,
CASE WHEN l_tax > 0.07 THEN 'scored on part' ELSE '' END AS caveat, CASE WHEN l_discount > 0.02 THEN 'It is only met in part by order ' || l_orderkey ELSE ' ' END AS rationale FROM lineitem),
fb AS (SELECT o_orderkey AS entity_id, o_orderkey % 50 AS page_start FROM orders WHERE o_orderkey % 50 > 0),
al AS (SELECT *, lower(trim(status)) AS st, coalesce(page, page_start) AS pg FROM aln LEFT JOIN fb USING (entity_id) WHERE lower(trim(status)) != 'none'),
sd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entity_id, i) AS turn FROM al WHERE st = 'partial' AND trim(rationale) != ''),
ct AS MATERIALIZED (SELECT doc_id, count(*) FILTER (st = 'full') AS full_n, count(*) FILTER (st = 'partial') AS partial_n, coalesce(list_sort(list(DISTINCT pg) FILTER (pg IS NOT NULL)), []) AS pages, list_sort(list(DISTINCT entity_id)) AS entities,
 coalesce(list_sort(list(DISTINCT trim(caveat)) FILTER (pg IS NOT NULL AND trim(caveat) != '')), []) AS caveats, coalesce(list_sort(list(DISTINCT entity_id) FILTER (page IS NULL)), []) AS missing_pages,
 (SELECT coalesce(list(trim(rationale) ORDER BY entity_id, i), []) FROM sd WHERE sd.doc_id = al.doc_id AND turn <= 3) AS rationales FROM al GROUP BY 1)"""


def standards(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("code"), F.lit("substandard").alias("level"), F.col("p_brand").alias("parent_code"), F.concat("p_name", F.lit(" (I/C).")).alias("text"))


def rows(spark, d):
    flag, order = F.col("l_returnflag"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        order.alias("entity_id"),
        F.concat(F.lit("P"), "l_partkey").alias("doc_id"),
        F.col("l_linenumber").alias("i"),
        F.when(flag == "R", " Full").when(flag == "A", "partial").otherwise("none").alias("status"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("page"),
        F.when(F.col("l_tax") > 0.07, "scored on part").otherwise("").alias("caveat"),
        F.when(F.col("l_discount") > 0.02, F.concat(F.lit("It is only met in part by order "), order)).otherwise(" ").alias("rationale"),
    )


def cited(spark, d):
    fallback = co.page_fallback(table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), (F.col("o_orderkey") % 50).alias("page_start")))
    return co.teacher_pages(rows(spark, d), fallback)


_PLAIN = "array_to_string(pages, ',') AS pages, array_to_string(entities, ',') AS entities, array_to_string(caveats, ',') AS caveats, array_to_string(missing_pages, ',') AS missing_pages, array_to_string(rationales, '|') AS rationales"


@query(f"WITH {ALN} SELECT doc_id, full_n, partial_n, {_PLAIN} FROM ct")
def teacher_pages(spark, d):
    flat = lambda c, by: F.array_join(F.col(c).cast("array<string>"), by).alias(c)
    return cited(spark, d).select("doc_id", "full_n", "partial_n", *[flat(c, ",") for c in ("pages", "entities", "caveats", "missing_pages")], flat("rationales", "|"))


_JOINED = "CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' {w} ' || {x}[2] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', {w} ' || {x}[-1] END"


@query(
    f"""WITH {STD}, {ALN}, k AS (SELECT parent_code, code, lower(substr(t, 1, 1)) || substr(t, 2) AS skill, CASE WHEN coalesce(len(pages), 0) = 0 THEN 'missing' WHEN full_n > 0 THEN 'supported' ELSE 'partial' END AS s FROM (SELECT *, trim(replace(text, ' (I/C).', '')) AS t FROM std) LEFT JOIN ct ON doc_id = code),
g AS (SELECT parent_code, coalesce(list(skill ORDER BY code) FILTER (s = 'supported'), []) AS supported, coalesce(list(skill ORDER BY code) FILTER (s = 'partial'), []) AS partial, coalesce(list(skill ORDER BY code) FILTER (s = 'missing'), []) AS missing FROM k GROUP BY 1),
c AS (SELECT *, supported || partial AS covered FROM g)
SELECT parent_code, len(supported) AS n_supported, len(partial) AS n_partial, len(missing) AS n_missing, CASE WHEN len(covered) = 0 THEN 'beyond_scope' WHEN len(missing) + len(partial) = 0 THEN 'fully_met' ELSE 'partially_met' END AS alignment,
CASE WHEN len(covered) = 0 THEN 'This standard is beyond the scope of Module 2.' || CASE WHEN len(missing) > 0 THEN ' None of the cited lessons ask students to ' || {_JOINED.format(x='missing', w='or')} || '.' ELSE '' END
WHEN len(missing) + len(partial) = 0 THEN 'The standard is fully met. Citations show students ' || {_JOINED.format(x='covered', w='and')} || '.'
ELSE 'The standard is partially met. Citations show students ' || {_JOINED.format(x='covered', w='and')} || '.' || CASE WHEN len(missing) > 0 THEN ' However, none of the cited lessons ask students to ' || {_JOINED.format(x='missing', w='or')} || '.' ELSE '' END
|| CASE WHEN len(partial) > 0 THEN ' Where a covered skill appears only in part, student performance is incomplete relative to the full skill named by the standard.' ELSE '' END END AS statement FROM c"""
)
def parent_statements(spark, d):
    out = co.parent_statements(standards(spark, d), cited(spark, d))
    return out.select("parent_code", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("supported", "partial", "missing")], "alignment", "statement")


_RUNS = "(SELECT 'pp. ' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) FROM (SELECT min(p) AS a, max(p) AS b FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM (SELECT unnest(pages) AS p)) GROUP BY g))"


@query(
    f"""WITH {STD}, {ALN}, m AS (SELECT code, level, trim(text) AS text, coalesce(full_n, 0) AS full_n, coalesce(partial_n, 0) AS partial_n, coalesce(array_to_string(entities, ', '), '') AS entities, coalesce({_RUNS}, '') AS p, coalesce(caveats, []) AS cv, coalesce(missing_pages, []) AS mp, coalesce(rationales, []) AS ra FROM std LEFT JOIN ct ON doc_id = code)
SELECT code, level, text, CASE WHEN p = '' THEN 'This standard is beyond the scope of Module 2.' WHEN partial_n > 0 AND full_n = 0 THEN 'The standard is partially met.' || CASE WHEN len(ra) > 0 THEN ' ' || ra[1] || '.' ELSE '' END || chr(10) || 'Module 2: ' || p ELSE 'Module 2: ' || p END AS citation, full_n, partial_n, entities,
CASE WHEN p = '' THEN 'This standard is beyond the scope of Module 2.' WHEN len(cv) > 0 THEN 'Supporting Materials / Read-aloud Guides were not included in the provided Teacher Guide PDF; some comprehension alignments may be understated pending those materials.' ELSE '' END AS other_note,
concat_ws('; ', CASE WHEN len(cv) > 0 THEN 'input_scope_caveat present on one or more lesson rows' END, CASE WHEN len(mp) > 0 THEN 'missing evidence_page lessons (Stage-1 page_start used when available): ' || array_to_string(mp, ', ') END) AS qa_notes FROM m"""
)
def correlation_mirror(spark, d):
    return co.mirror_rows(standards(spark, d), cited(spark, d))


@query(f"WITH {STD}, {ALN}, pm AS (SELECT parent_code, count(*) FILTER (coalesce(len(pages), 0) > 0) AS c, count(*) FILTER (coalesce(len(pages), 0) > 0 AND full_n > 0) AS f, count(*) AS n FROM std LEFT JOIN ct ON doc_id = code GROUP BY 1) SELECT (SELECT count(*) FROM aln) AS alignment_rows, (SELECT count(*) FROM ct WHERE len(pages) > 0) AS cited, (SELECT count(*) FROM std) AS leaves, (SELECT count(*) FROM pm WHERE c > 0 AND f < n) AS parents_partially_met, 'judge' AS source")
def correlation_counts(spark, d):
    found, source = co.first_source(rows(spark, d), None, None)
    c = cited(spark, d)
    return co.package_counts(found, standards(spark, d), c, co.parent_statements(standards(spark, d), c), source)


@query("WITH b AS (SELECT n_nationkey, n_regionkey AS domain, n_regionkey || '.' || n_name AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS label, n_name || ': of region ' || n_regionkey AS text FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY code) AS k FROM b) SELECT code, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][k] || '. BIG IDEA: ' || coalesce(nullif(label, ''), split_part(text, ':', 1)) || CASE WHEN regexp_matches(split_part(code, '.', 2), '^[A-Za-z]{1,4}$') THEN ' (' || split_part(code, '.', 2) || ')' ELSE '' END AS heading FROM r")
def big_idea_headings(spark, d):
    n = table(spark, d, "nation")
    s = n.select(F.col("n_regionkey").alias("domain"), F.concat_ws(".", "n_regionkey", "n_name").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("label"), F.concat("n_name", F.lit(": of region "), "n_regionkey").alias("text"))
    return co.big_idea_headings(s, "domain", "code", "label", "text").select("code", "heading")


@query("""SELECT p_partkey, concat_ws(chr(10), p_partkey || ' ' || p_name, CASE WHEN p_size % 3 > 0 THEN 'Domain: ' || p_brand END, 'Behaviors: ' || p_type || '; ' || p_brand, CASE WHEN p_size % 4 > 0 THEN 'oral production: ' || p_type END, 'Codes: ' || p_brand || ', ' || p_partkey) AS text FROM part""")
def embed_texts(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    actions = F.create_map(F.lit("written_production"), F.lit("none observed"), F.lit("oral_production"), F.when(size % 4 > 0, F.col("p_type")).otherwise(""))
    text = tx.embed_text(F.col("p_partkey").cast("string"), F.col("p_name"), F.when(size % 3 > 0, F.col("p_brand")).otherwise(" "), F.array("p_type", F.lit(" "), "p_brand"), actions, F.array("p_brand", F.col("p_partkey").cast("string")))
    return p.select("p_partkey", text.alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || chr(10) ELSE '' END || p_name || chr(10) || 'Terms: ' || p_type || CASE WHEN p_size % 5 > 0 THEN chr(10) || 'other ' || p_brand ELSE '' END AS text FROM part""")
def retrieval_texts(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    embedded = F.when(size % 5 > 0, F.concat(F.lit("other "), "p_brand")).otherwise(F.col("p_name"))
    text = tx.retrieval_text(F.when(size % 2 == 0, F.col("p_brand")).otherwise("NONE OBSERVED"), F.col("p_name"), F.lit(None), F.array("p_type"), F.array().cast("array<string>"), embedded)
    return p.select("p_partkey", text.alias("text"))


@query(
    """WITH b AS (SELECT l_orderkey AS e, l_linenumber AS k, min(l_partkey) AS pt, min(l_suppkey) % 4 AS page FROM lineitem GROUP BY 1, 2), s AS (SELECT *, last_value(CASE WHEN page > 0 THEN page END IGNORE NULLS) OVER (PARTITION BY e ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b),
l AS (SELECT e, string_agg(concat_ws(chr(10), CASE WHEN page > 0 AND page IS DISTINCT FROM seen THEN '(page ' || page || ')' END, 'Block ' || k, 'do ' || pt), chr(10) ORDER BY k) AS body FROM s GROUP BY 1) SELECT o_orderkey AS entity_id, concat_ws(chr(10), o_orderpriority, o_orderstatus, body) AS text FROM orders LEFT JOIN l ON e = o_orderkey"""
)
def judged_texts(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("block")).agg(F.min("l_partkey").alias("p"), (F.min("l_suppkey") % 4).alias("page"))
    blocks = li.select("entity_id", "block", F.lit(0).alias("step"), F.concat(F.lit("Block "), "block").alias("title"), F.concat(F.lit("do "), "p").alias("text"), "page")
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus", F.lit(" ")).alias("targets"))
    return tx.judged_text(blocks, heads)


@query("SELECT doc_id, substr('Lang: ' || lang || chr(10) || 'Text: ' || trim(text), 1, 300) AS text FROM documents")
def rerank_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.rerank_text([("Lang", F.col("lang")), ("Empty", F.lit(" ")), ("Text", F.col("text"))], 300).alias("text"))


_CODED = "(SELECT p_partkey, p_name || ' (RL.' || p_size % 4 || '.' || p_size || ', W.K.' || p_size % 7 || 'a) and RL.' || p_size % 4 || '.' || p_size || CASE WHEN p_size % 2 = 0 THEN ' Unit 2: Lesson ' || p_size ELSE '' END AS t FROM part)"


def coded(spark, d):
    size = F.col("p_size")
    t = F.concat("p_name", F.lit(" (RL."), size % 4, F.lit("."), size, F.lit(", W.K."), size % 7, F.lit("a) and RL."), size % 4, F.lit("."), size, F.when(size % 2 == 0, F.concat(F.lit(" Unit 2: Lesson "), size)).otherwise(""))
    return table(spark, d, "part").select("p_partkey", t.alias("t"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b([A-Z]{{1,4}}\\.(?:K|\\d+)\\.\\d+[a-z]{{0,3}})\\b', 1))), ',') AS codes, trim(regexp_replace(t, '(?s)\\s*\\(?[A-Z]{{1,4}}\\.(?:K|\\d).*', '')) AS plain FROM {_CODED}")
def code_extraction(spark, d):
    return coded(spark, d).select("p_partkey", F.array_join(F.array_sort(rc.codes_of(F.col("t"))), ",").alias("codes"), rc.without_trailing_codes(F.col("t")).alias("plain"))


@query(f"SELECT p_partkey, p_name || ' ( ) and' || CASE WHEN p_size % 2 = 0 THEN ' Unit 2: Lesson ' || p_size ELSE '' END AS t FROM part WHERE false UNION ALL SELECT p_partkey, trim(p_name || ' and' || CASE WHEN p_size % 2 = 0 THEN ' Unit 2: Lesson ' || p_size ELSE '' END) FROM part")
def redacted_codes(spark, d):
    return coded(spark, d).select("p_partkey", F.regexp_replace(rc.redacted(F.col("t")), r"\s+", " ").alias("t"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) FILTER (trim(x) = '' OR regexp_matches(trim(x), '(?i)^\\d{1,4}$|Unit\\s+\\d+\\s*:\\s*Lesson\\s+\\d+|Curriculum\\s+\\d{1,4}\\s*$') OR regexp_matches(trim(x), '(?i)^\\s*[-–—•]?\\s*(?:Post\\s*:|In advance\\b|During (?:Opening|Work Time|Closing)\\b|Circulate\\b|Prepare\\b|Refer to the Classroom Protocols\\b)|^\\s*[-–—•]\\s*.*\\b(?:routine|protocols?)\\b')) AS noise, count(*) AS n FROM l GROUP BY 1")
def noise_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count_if(rc.is_noise(F.col("x"))).alias("noise"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT conv_id, turn * 100000 + i AS pos, CASE WHEN role = 'user' THEN 'new' ELSE 'review' END AS bucket, x[i] AS term FROM (SELECT *, string_split(text, ' ') AS x, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)),
k AS (SELECT conv_id, lower(trim(term)) AS k, arg_max(bucket, pos) AS bucket, min(pos) AS f, arg_min(trim(term), pos) AS term FROM w WHERE trim(term) != '' AND NOT regexp_matches(term, '\\s') GROUP BY 1, 2) SELECT conv_id AS entity_id, bucket, count(*) AS n, md5(string_agg(term, ' ' ORDER BY f)) AS terms FROM k GROUP BY 1, 2"""
)
def vocabulary_buckets(spark, d):
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("entity_id"), "turn", F.when(F.col("role") == "user", "new").otherwise("review").alias("bucket"), F.posexplode(F.split("text", " ")).alias("i", "term"))
    terms = words.filter(~F.col("term").rlike(r"\s")).withColumn("at", F.col("turn") * 100000 + F.col("i") + 1)
    return rc.split_vocabulary(terms).select("entity_id", "bucket", F.size("terms").cast("bigint").alias("n"), F.md5(F.array_join("terms", " ")).alias("terms"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1.7 ELSE CASE WHEN starts_with(event_type, 'p') THEN 2.2 WHEN starts_with(event_type, 's') THEN 1.8 ELSE 1.0 END END AS weight FROM events")
def arm_weights(spark, d):
    return table(spark, d, "events").select("event_id", rc.by_source(F.col("event_type"), {"click": 1.7}, [("p", 2.2), ("s", 1.8)], 1.0).alias("weight"))


@query("SELECT doc_id AS entity_id, s AS source, t AS text FROM documents, (VALUES ('a', 'the', 'first bridge'), ('b', 'der', 'second bridge')) v(s, k, t) WHERE contains(lower(text), k)")
def competency_bridges(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    return rc.bridges(docs, [(["the"], "a", "first bridge"), (["der"], "b", "second bridge")])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_size + 1 WHEN p_size % 2 = 0 THEN p_size + 2 END AS grade, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN p_size % 4 = 1 THEN 0.6 ELSE 0.0 END AS bonus FROM part")
def entity_attributes(spark, d):
    size = F.col("p_size")
    grade = rc.entity_grade(F.when(size % 3 == 0, size), F.when(size % 3 == 1, F.concat(F.lit("For GRADE "), size + 1)).otherwise(""), F.when(size % 2 == 0, F.concat(F.lit("g"), size + 2, F.lit("M1"))).otherwise("x"))
    bonus = rc.domain_bonus(F.array(F.lit("Reading"), F.lit("Writing")), F.when(size % 4 == 0, "reading").otherwise("Maths"), F.when(size % 4 < 2, F.array(F.lit("writing"))).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "part").select("p_partkey", grade.alias("grade"), bonus.alias("bonus"))


@query("WITH r AS (SELECT p_partkey AS entity_id, p_size, p_retailprice, p_name FROM part) SELECT entity_id, 'small' AS issue FROM r WHERE p_size < 10 UNION ALL SELECT entity_id, 'dear' FROM r WHERE p_retailprice > 1500 UNION ALL SELECT entity_id, 'short_name' FROM r WHERE length(p_name) < 12")
def record_audit(spark, d):
    r = table(spark, d, "part").withColumnRenamed("p_partkey", "entity_id")
    return rc.audit(r, [("small", F.col("p_size") < 10), ("dear", F.col("p_retailprice") > 1500), ("short_name", F.length("p_name") < 12)])


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey AS e, CASE l_linenumber % 3 WHEN 0 THEN 'Opening' WHEN 1 THEN 'Work Time' ELSE 'Closing and Assessment' END AS s, chr(65 + (l_suppkey % 2)::INTEGER) AS l FROM lineitem),
v AS (SELECT DISTINCT l_orderkey AS e, l_linenumber AS "at", CASE l_linenumber % 4 WHEN 0 THEN 'Opening' WHEN 1 THEN 'Work Time' WHEN 2 THEN 'Closing' ELSE 'Work' END AS h, 'A' AS l, CASE WHEN l_linenumber > 4 THEN ', step 2' ELSE '' END AS r FROM lineitem),
j AS (SELECT v.e, "at", v.h, v.l, r, max(s) FILTER (s = h) AS x, list(DISTINCT s) FILTER (starts_with(s, h || ' ')) AS p FROM v LEFT JOIN b ON b.e = v.e AND b.l = v.l GROUP BY ALL), f AS (SELECT *, coalesce(x, CASE WHEN len(p) = 1 THEN p[1] END) AS s FROM j)
SELECT e AS entity_id, "at", CASE WHEN s IS NULL THEN h || ' ' || l || r ELSE s || ' ' || l || r END AS location, s IS NOT NULL AS found FROM f"""
)
def located_evidence(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    blocks = li.select(F.col("l_orderkey").alias("entity_id"), F.when(n % 3 == 0, "Opening").when(n % 3 == 1, "Work Time").otherwise("Closing and Assessment").alias("section"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("letter"))
    hint = F.when(n % 4 == 0, "Opening").when(n % 4 == 1, "Work Time").when(n % 4 == 2, "Closing").otherwise("Work")
    evidence = li.select(F.col("l_orderkey").alias("entity_id"), n.alias("at"), F.concat(hint, F.lit(" A"), F.when(n > 4, ", step 2").otherwise("")).alias("location")).distinct()
    good, bad = rc.located(evidence, blocks)
    return good.withColumn("found", F.lit(True)).unionByName(bad.withColumn("found", F.lit(False)))
