"""Oracle SQL (DuckDB) of the numbered operators that SQL can say, on tables small enough for it."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows are lists of words; verdicts follow quality.Limits.
OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i:i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN lines l USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      n_symbols * 100 > word_chars * 20 OR n_dup_lines * 100 > n_lines * 50 AS soft, n_symbols * 100 > word_chars * 15 OR n_dup_lines * 100 > n_lines * 30 AS strict FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS b FROM f GROUP BY source),
mo AS (SELECT avg(b / n) AS m, coalesce(var_pop(b / n), 0) AS v FROM h),
pr AS (SELECT m, greatest(2.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS k FROM mo),
bad AS (SELECT source, round((b + m * k) / (n + k), 9) > round(least(0.5, m + sqrt(m * (1 - m) / (k + 1))), 9) AS is_bad FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (CASE WHEN is_bad THEN strict ELSE soft END) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source"""

OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

OP3 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM twice, range(0, 35) AS x(j)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT words.r, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '') AS t FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n, list_sort(sh)::VARCHAR AS whole FROM s),
c AS (SELECT min(doc_id) AS c, whole, any_value(n) AS n FROM n WHERE n > 0 GROUP BY whole),
x AS (SELECT s.doc_id AS c, unnest(sh) AS t FROM s WHERE doc_id IN (SELECT c FROM c)),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS common FROM x a JOIN x b ON a.t = b.t AND a.c < b.c GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN c ca ON ca.c = p.a JOIN c cb ON cb.c = p.b WHERE 100 * common >= 75 * (ca.n + cb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(m, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.whole = n.whole AND n.n > 0 LEFT JOIN least_of ON a = c.c"""

#: crc32 bit by bit: each byte comes before seven zeros. step has the edits of a row with up to two inserts after it.
OP11 = r"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, v: xor(xor(a, v) >> 1, 3988292384::BIGINT * (xor(a, v) & 1))), 4294967295::BIGINT) % 20 AS k FROM (SELECT DISTINCT key FROM src)),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again
        FROM src JOIN crc USING (key) WHERE k != 0),
num AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
        FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS ini, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM num),
g AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
st(q) AS (VALUES (0), (1), (2), (3)),
ins(p, q) AS (VALUES (0, 2), (1, 2), (3, 2), (2, 3)),
kept(ini, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
more AS (SELECT q AS p, q, 0 AS cost, '' AS letters FROM st UNION ALL SELECT p, q, 2, 'I' FROM ins UNION ALL SELECT a.p, b.q, 4, 'II' FROM ins a JOIN ins b ON a.q = b.p),
edit AS (SELECT NULL AS ini, q AS p, q, 3 AS cost, 'D' AS letter FROM st UNION ALL SELECT ini, p, q, 0, 'K' FROM kept UNION ALL SELECT NULL, p, q, 2, 'R' FROM ins),
step AS (SELECT e.ini, e.letter, e.p, m.q, e.cost + m.cost AS cost, e.letter || m.letters AS letters FROM edit e JOIN more m ON m.p = e.q),
walk(conv_id, i, n, q, key) AS (
  SELECT conv_id, 0::BIGINT, n, q, lpad(cost::VARCHAR, 9, '0') || letters FROM (SELECT DISTINCT conv_id, n FROM g), more WHERE p = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, w.n, s.q, min(lpad((left(w.key, 9)::INT + s.cost + CASE WHEN g.fault = 3 AND s.letter != 'D' THEN 1 ELSE 0 END)::VARCHAR, 9, '0') || substr(w.key, 10) || s.letters)
  FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN step s ON s.p = w.q AND (s.letter = 'D' OR g.fault NOT IN (1, 2)) AND (s.ini IS NULL OR s.ini = g.ini)
  GROUP BY w.conv_id, w.i, w.n, s.q),
best AS (SELECT conv_id, min(key) AS key FROM walk WHERE i = n AND q IN (0, 3) GROUP BY conv_id),
fix(conv_id, audit, spot, i, st, lines) AS (
  SELECT conv_id, substr(key, 10), 1, 1::BIGINT, 0, []::VARCHAR[] FROM best
  UNION ALL
  SELECT x.conv_id, audit, spot + 1, x.i + CASE WHEN c = 'I' THEN 0 ELSE 1 END, CASE WHEN c = 'D' THEN st ELSE CASE left(r, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END,
         CASE WHEN c = 'D' THEN lines ELSE list_append(lines, r || ':' || CASE WHEN c = 'I' THEN '' ELSE text END) END
  FROM (SELECT fix.*, g.text, substr(audit, spot, 1) AS c, CASE WHEN substr(audit, spot, 1) IN ('I', 'R') THEN CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END ELSE g.role END AS r
        FROM fix LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM fix.conv_id AND g.i = fix.i WHERE spot <= length(audit)) x),
out AS (SELECT conv_id, audit, array_to_string(lines, chr(10)) AS t FROM fix WHERE spot = length(audit) + 1),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
          count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(left(key, 9)::BIGINT, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN out ON out.conv_id IS NOT DISTINCT FROM s.conv_id"""

#: Two-word shingles at 80 per cent; else as OP8.
OP13 = OP8.replace("len(w) >= 5", "len(w) >= 2").replace("len(w) - 3", "len(w)").replace("w[i:i + 4]", "w[i:i + 1]").replace("100 * common >= 75", "100 * common >= 80").replace("AS component_id FROM n LEFT", "AS component_id, doc_id = coalesce(m, doc_id) AS kept FROM n LEFT")


def op9(junk: tuple[str, ...]) -> str:
    """junk: the names whose hosts make the list."""
    names = ", ".join(f"'{x}'" for x in junk)
    return rf"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
c AS (SELECT *, CASE WHEN host != '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') END AS canonical FROM h),
bad AS (SELECT DISTINCT canonical AS listed FROM c WHERE list_has_any(string_split(host, '.'), [{names}])),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical
FROM c LEFT JOIN f USING (page_id) LEFT JOIN bad ON listed = canonical"""
