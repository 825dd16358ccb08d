"""Record clean-up, scans, funnels and steps that SQL can't say, on small fixtures."""

import json
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidmark.operators import crosswalk as cw
from braidmark.operators import funnel as fu
from braidmark.operators import incremental as inc
from braidmark.operators import logs
from braidmark.operators import records as rc
from braidmark.operators import retrieval as rt
from braidmark.operators import structure as st
from braidmark.operators import texts as tx
from braidmark.operators import verdicts as vd
from braidmark.sources import tables as src
from braidmark.streaming import live


def values(spark, texts, f):
    return [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("v")).collect()]


def test_code_redaction(spark):
    texts = ["Gather data on SL.1.1a, SL.1.1b, and SL.1.6 using the checklist.", "with and without, code", "using SL.1.1a and SL.1.1b protocols", "see II.3.4 and A.1.2", "(RL.K.1) read", None]
    assert values(spark, texts, rc.redacted) == ["Gather data on using the checklist.", "with and without, code", "using protocols", "see II.3.4 and A.1.2", "read", None]
    got = spark.createDataFrame([("Target (RL.K.1, W.1.2a)", "G1M2U3L4x")], "t string, c string").select(rc.codes_of(F.col("t")).alias("a"), rc.without_trailing_codes(F.col("t")).alias("b"), rc.lesson_numbers(F.col("c")).alias("c")).first()
    assert got.a == ["RL.K.1", "W.1.2a"] and got.b == "Target" and tuple(got.c) == (1, 2, 3, 4)


def test_page_text(spark):
    texts = ["the min-\nutes (20\nminutes) of read-\naloud and read-aloud, pages 42-\n43, RL.1.\n1 • end", None]
    assert values(spark, texts, rc.clean_page_text) == ["the minutes (20 minutes) of read-aloud and read-aloud, pages 42-43, RL.1.1 end", ""]


def test_concise_and_arms(spark):
    long = "First sentence of some length here. " * 12
    assert values(spark, ["  a  b ", long, "word " * 100], rc.concise) == ["a b", ("First sentence of some length here. " * 10).strip(), ("word " * 72).strip()]
    items = [("e", 1, "skill", 2, "Describe the moon and the sun"), ("e", 2, "objective", 1, "describe the MOON, and the sun!"), ("e", 3, "evidence", 10, "Write a poem about the night sky"), ("e", 4, "title", 13, "short"), ("e", 5, "target", 0, "Compare two stories about the sun")]
    out = rc.query_arms(spark.createDataFrame(items, "entity_id string, at int, source string, priority int, text string"), 2).orderBy("query_index").collect()
    assert [(r.source, r.query_index) for r in out] == [("target", 1), ("skill", 2)]


def test_verbatim_lines(spark):
    lines = [(1, "Opening A", "Ask: “What do you see?”"), (2, "Work Time B", "Tell students to ask what do you see now and then draw"), (3, None, "Read the story about the sun and moon together"), (4, "Opening A", "Tell students to sit")]
    src_lines = spark.createDataFrame([("e", n, t, b) for n, b, t in lines], "entity_id string, line_no int, line string, block string")
    quotes = [(1, "ask: 'what do you see?'", None), (2, "what do you see", "Work Time B"), (3, "what do you see", None), (4, "Please read the story about the sun and moon together, said the teacher", None), (5, "Read the story about a sun and moon togethr", None), (6, "nothing like it at all in the text", None)]
    out = rc.verbatim(spark.createDataFrame([("e", *q) for q in quotes], "entity_id string, at int, quote string, block string"), src_lines).orderBy("at").collect()
    assert [r.source_line for r in out] == [lines[0][2], lines[1][2], lines[0][2], lines[2][2], lines[2][2], None]


def test_quotes_by_index_equal_all_pairs(spark):
    rng = random.Random(7)
    words = ["sun", "moon", "read", "the", "story", "a", "of", "students", "write", "draw", "ok"]
    prose = lambda n: " ".join(rng.choices(words, k=n))

    def changed(t):
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "x", "qu"]) + t[i + rng.randrange(2) :]
        return t

    lines = [(e, i, prose(rng.choice([1, 1, 2, 5, 9, 14])), None) for e in "ab" for i in range(60)] + [("a", 90, "", None), ("a", 91, None, None), ("c", 0, "only", None)]
    quotes = []
    for i in range(160):
        e, _, t, _ = rng.choice(lines[:120])
        cut = sorted(rng.sample(range(len(t) + 1), 2)) if len(t) > 4 else (0, len(t))
        quotes.append((e, i, rng.choice([changed(t), t, t[cut[0] : cut[1]], f"so {t} then", prose(4), "ok", "s", changed(t[:6])]), None))
    quotes += [("a", 500, "", None), ("a", 501, None, None), ("z", 502, "sun", None)]
    schema = "entity_id string, {} int, {} string, block string"
    got = {(r.entity_id, r.at): r.source_line for r in rc.verbatim(spark.createDataFrame(quotes, schema.format("at", "quote")), spark.createDataFrame(lines, schema.format("line_no", "line"))).collect()}
    for e, at, quote, _ in quotes:
        q = " ".join((quote or "").split())
        own = [(n, line, " ".join((line or "").split())) for x, n, line, _ in lines if x == e and (line or "").strip()]
        sure = [(0, 0, n, t) for n, t, x in own if x == q] + [(1, len(t), n, t) for n, t, x in own if q in x != q] + [(2, -len(t), n, t) for n, t, x in own if x in q != x and len(x) >= 24]
        near = [(-SequenceMatcher(None, q, x).ratio(), n, t) for n, t, x in own]
        want = None if not q else min(sure)[3] if sure else min(near)[2] if near and -min(near)[0] >= 0.88 else None
        assert got[e, at] == want, (e, at, quote)
    asked = spark.createDataFrame([q for q in quotes if q[2] and len(q[2]) > 30], schema.format("q", "quote")).select("entity_id", "q", F.col("quote").alias("__q"))
    known = spark.createDataFrame([(e, 100 * (e == "b") + i, t, None) for e, i, t, _ in lines if t], schema.format("x", "line")).select("entity_id", "x", F.col("line").alias("__x"))
    assert 3 * rc.quote_candidates(asked, known, 0.88, 24).count() < asked.join(known, "entity_id").count()


def test_quotes_of_small_and_large_entities_meet_alike(spark, monkeypatch):
    """Small entities meet without an index, whose grams are many times their texts; large ones by it, with the same lines."""
    made, grams = rc.quote_candidates, []

    def counted(quotes, lines, *a):
        grams.append({r.entity_id for r in lines.select("entity_id").collect()})
        return made(quotes, lines, *a)

    monkeypatch.setattr(rc, "quote_candidates", counted)
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choices(["sun", "moon", "read", "the", "story", "students"], k=n))
    lines = [(e, i, prose(rng.choice([2, 6, 12])), None) for e, n in (("a", 40), ("b", 5), (None, 3)) for i in range(n)]
    quotes = [(e, i, rng.choice([t, t[1:-1], t.replace("o", "", 1), f"so {t}", prose(6)]), None) for i, (e, _, t, _) in enumerate(lines)]
    schema = "entity_id string, {} int, {} string, block string"
    asked, known = spark.createDataFrame(quotes, schema.format("at", "quote")), spark.createDataFrame(lines, schema.format("line_no", "line"))
    got = [sorted(map(str, rc.verbatim(asked, known, most_pairs=n).collect())) for n in (0, 100, 1 << 16)]
    assert got[0] == got[1] == got[2]
    assert grams == [{"a", "b"}, {"a"}]


def test_lesson_repair(spark):
    evidence = "array<struct<quote:string,actor:string,evidence_role:string,supports_action:array<string>>>"
    row = (
        [(10,), (None,), (5,)],
        [("Show a thumbs-up if you are ready to begin writing", "teacher", "elicitation_check", ["written_production"]), ("RL.1.1", "student", "teacher_model", []), ("Read aloud W.1.2", "shared", "teacher_model", ["oral_production"])],
        ["Phonics was not taught", "Grammar"], "they sounded out the word", ["Reading"], ["paper ", "Paper", "In advance: post it", "66"],
        {"written_production": "write", "oral_production": "say RL.1.1 it", "other": "NONE OBSERVED"}, "Do RL.1.1, RL.1.2 and RL.1.3 now",
    )
    df = spark.createDataFrame([row], f"agenda array<struct<minutes:int>>, evidence {evidence}, not_taught array<string>, source_text string, strands array<string>, materials array<string>, actions map<string,string>, objective string")
    r = rc.clean_lesson(df).first()
    assert r.pacing == "15 minutes" and r.not_taught == ["Grammar"] and r.materials == ["paper"] and r.objective == "Do now"
    assert [(e.quote, e.actor, e.supports_action) for e in r.evidence] == [("Show a thumbs-up if you are ready to begin writing", "student", []), ("Read aloud", "teacher", ["oral_production"])]
    assert r.actions == {"written_production": "NONE OBSERVED", "oral_production": "say it", "other": "NONE OBSERVED"}
    steps = [("e", 0, "Opening", "A", 0, "Why do authors write?"), ("e", 1, "Work Time", "A", 0, "Invite students to write in the next lesson"), ("e", 1, "Work Time", "A", 1, "Invite students to write a line"), ("e", 2, "Closing", "A", 0, "Have students to draw")]
    assert rc.written_steps(spark.createDataFrame(steps, "entity_id string, block int, section string, letter string, step int, text string")).first().step_text == "Invite students to write a line"


def test_overlap_standard_and_folds(spark):
    df = spark.createDataFrame([("write a narrative poem; sit still here", "A poem is a narrative verse")], "f string, t string")
    assert rc.skill_overlap(df, "f", "t", ("a", "write")).first().skill_overlap == pytest.approx(0.4)
    s = spark.createDataFrame([("1.F", [" a  b ", "A b", ""], ["x"], "Reading", ["reading", "Writing", "writing"])], "code string, terms array<string>, exact_codes array<string>, domain_primary string, domain_secondary array<string>")
    r = rc.clean_standard(s, ["terms"]).first()
    assert r.terms == ["a b"] and r.exact_codes == ["1.F", "x"] and r.domain_secondary == ["Writing"]
    assert rc.folded(s.withColumn("terms", F.array(F.lit("“q” – x"))), ["terms"]).first().terms == ['"q" - x']


def test_attached_steps(spark):
    blocks = spark.createDataFrame([("d", 0, "Reading Aloud: The Sun"), ("d", 1, "Work in pairs"), ("d", 2, "Reading Aloud: The Moon"), ("d", 3, "Reflecting on learning")], "doc string, block int, title string")
    lines = ["cover", "A. reading", "Reading aloud: the sun", "step", "Reading Aloud: The Moo", "step", "Reflecting on Learning", "Work in pairs"]
    out = st.attached_steps(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string"), blocks).orderBy("line_no").collect()
    assert [r.block for r in out] == [None, None, 0, 0, 2, 2, 3, 3]
    pages = spark.createDataFrame([("d", 1, "66\ntext\nmore"), ("d", 2, "a\nEL Curriculum 117"), ("d", 3, "none")], "doc string, page int, text string")
    assert [r.printed for r in st.printed_page(pages).orderBy("page").collect()] == [66, 117, None]
    body = spark.createDataFrame([("d", i, x) for i, x in enumerate(["Materials", "paper", "66", "Vocabulary", "sun", "moon"])], "doc string, line_no int, line string")
    assert {r.section: r["items"] for r in st.section_bodies(body, ["Materials", "Vocabulary"]).collect()} == {"Materials": ["paper"], "Vocabulary": ["sun", "moon"]}


def test_greedy_collocations(spark):
    df = spark.createDataFrame([(1, "new york city new york"), (2, "york city york"), (3, "")], "k long, t string")
    pairs = spark.createDataFrame([("new", "york"), ("york", "city")], "first string, second string")
    out = {r.key: r.tokens for r in cw.merged_tokens(df, "k", cw.words_of(F.col("t")), pairs).collect()}
    assert out == {1: ["new_york", "city", "new_york"], 2: ["york_city", "york"], 3: []}
    merged = cw.merged_tokens(df, "k", cw.words_of(F.col("t")), pairs)
    assert cw.text_crosswalk(merged, merged, 1).filter("key = target").count() == 2
    many = spark.createDataFrame([(i, f"alpha beta gamma{i} alpha") for i in range(4)] + [(9, None)], "key long, text string")
    one, two = cw.merged_sides(many.filter("key < 2"), many, ("gamma",))
    assert {r.key: r.tokens for r in one.collect()} == {i: ["alpha_beta", "alpha"] for i in range(2)} and two.count() == 5


def test_crosswalk_by_sent_tables_equals_joins(spark):
    rng = random.Random(3)
    words = ["sun", "moon", "star", "new", "york", "city", "hall", "a", "b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))) + " old town hall" * (i % 3 == 0)) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    t = cw.words_of(F.col("text"))
    found = [{tuple(r) for r in cw.collocations(df, "key", t, 2, 0.3, most_sent=m).collect()} for m in (0, 100)]
    assert found[0] == found[1] and ("old", "town") in {x[:2] for x in found[0]}
    pairs = spark.createDataFrame([("sun", "moon"), ("moon", "star"), ("star", "sun"), ("old", "town"), ("town", "hall"), ("sun", "sun")], "first string, second string")
    merged = [cw.merged_tokens(df, "key", t, pairs, most_sent=m) for m in (0, 100)]
    assert sorted(map(tuple, merged[0].collect()), key=str) == sorted(map(tuple, merged[1].collect()), key=str)
    assert "hashpartitioning" not in merged[1]._jdf.queryExecution().toString()  # no word of a row is shuffled
    none = cw.merged_tokens(df, "key", t, pairs.limit(0))
    assert {r.key: r.tokens for r in none.collect()} == {r.key: r.t for r in df.select("key", t.alias("t")).collect()}
    # a key in two rows is one target
    target = merged[1].unionByName(spark.createDataFrame([(5, ["sun", "zeta"]), (6, [])], "key long, tokens array<string>"))
    source = spark.createDataFrame([(1, ["sun", "old_town", "zeta"]), (2, ["nowhere"])], "key long, tokens array<string>")
    walks = [[tuple(r) for r in cw.text_crosswalk(source, target, 5, most_sent=m).orderBy("rank").collect()] for m in (0, 100)]
    assert walks[0] == walks[1] and len({x[2] for x in walks[0]}) == 5 and {x[0] for x in walks[0]} == {1}


def test_multi_query_funnel_with_scores(spark):
    rows = [("e", q, "s", 1.0, q > 0, d, r, 1.0 / r, r, None, 0.5, None, 1) for q, docs in enumerate(((1, 2, 3), (2, 4), (5, 1))) for r, d in enumerate(docs, 1)]
    arms = spark.createDataFrame(rows, "entity_id string, query_index int, source string, weight double, covers boolean, doc_id long, rank int, score double, dense_rank int, bm25_rank int, dense_score double, bm25_score double, grade int")
    corpus = spark.createDataFrame([(d, 1) for d in range(1, 9)], "doc_id long, grade int")
    scores = spark.createDataFrame([("e", d, float(d)) for d in range(1, 9)], "entity_id string, doc_id long, rerank_score double")
    final, merged, diagnostics = fu.multi_query(arms, corpus, scores, merge_k=4, rerank_k=5, preserve=1)
    kept = {r.doc_id: r.rrf_rank for r in merged.collect()}
    assert set(kept.values()) == set(range(1, len(kept) + 1)) and kept[1] == 1 and kept[2] == 2
    assert diagnostics.count() == 3 and final.count() == 5 and 1 in {r.doc_id for r in final.collect()} and 8 in {r.doc_id for r in final.collect()}


def test_functions_of_the_caller_are_checked(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "i int, q string, t string")
    assert [r.rerank_score for r in rt.score_with(df, "q", "t", lambda q, t: [float(len(x)) for x in t]).collect()] == [1.0, 1.0]
    with pytest.raises(Exception, match="one score"):
        rt.score_with(df.coalesce(1), "q", "t", lambda q, t: []).collect()
    assert len(rt.embed_with(df, "t", lambda t: [[1.0, 2.0]] * len(t), dims=2).first().embedding) == 2
    for bad in (lambda t: [[0.0, 0.0]] * len(t), lambda t: [[1.0]] * len(t)):
        with pytest.raises(Exception, match="embed_fn"):
            rt.embed_with(df, "t", bad, dims=2).collect()
    with pytest.raises(ValueError, match="grade"):
        rt.of_grade_or_error(df.withColumn("g", F.lit("1")), "g", "2")


def test_scans(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps({"code": "1", "text": "x"}))
    (tmp_path / "c" / "b.json").write_text(json.dumps({"code": "1", "text": "y"}))
    with pytest.raises(ValueError, match="repeated"):
        src.read_corpus(spark, str(tmp_path / "c"), "code string, text string", "code", "text")
    (tmp_path / "c" / "b.json").write_text(json.dumps({"code": "2", "text": " "}))
    with pytest.raises(ValueError, match="1 without a text"):
        src.read_corpus(spark, str(tmp_path / "c"), "code string, text string", "code", "text")
    (tmp_path / "gold.md").write_text("# G1: L1\n| A.1 | full |\n| A.2 | none |\n# G2: L2\n| B.1 | partial |\n")
    got = {tuple(r) for r in src.gold_of_markdown(spark, str(tmp_path / "gold.md")).collect()}
    assert got == {("G1", "L1", "A.1", "full"), ("G2", "L2", "B.1", "partial")}
    (tmp_path / "a.csv").write_text('entity_id,doc_id,status\ne,d,full\n,d,full\ne,,none\n')
    assert src.read_alignments(spark, str(tmp_path / "a.csv"), "entity_id string, doc_id string, status string", ["entity_id", "doc_id"]).count() == 1
    with pytest.raises(ValueError, match="rationale"):
        src.read_master(spark, str(tmp_path / "a.csv"), ["rationale"], [])
    assert src.read_master(spark, str(tmp_path / "a.csv"), ["status"], ["entity_id"]).count() == 2
    (tmp_path / "gold.jsonl").write_text('{"r": "e2", "c": "1", "s": "full"}\n{"r": "e1", "c": "", "s": "full"}\n{"r": "e1", "c": "2", "s": "none"}\n{"r": "e1", "c": "3", "s": "partial"}\n')
    gold = src.read_gold(spark, str(tmp_path / "gold.jsonl"), ["r", "c"], "s")
    assert [r.r for r in src.ordered_entities(gold.withColumn("at", F.col("c").cast("int")), "r", "at").collect()] == ["e2", "e1"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.json").write_text(json.dumps({"prompt_version": "p1", "verdicts": [{"code": "1", "prompt_version": None}, {"code": "2", "prompt_version": "p2"}]}))
    (tmp_path / "v" / "y.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "v" / "z.incomplete.json").write_text("{}")
    files = src.read_records(spark, str(tmp_path / "v"), "prompt_version string, verdicts array<struct<code:string,prompt_version:string>>")
    assert sorted((r.i, r.version) for r in src.exploded_verdicts(files).collect()) == [(0, "p1"), (1, "p2")]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "j1.log").write_text("== parse ==\n[1/2] a ok\r\n[2/2] b error\n")
    parsed = logs.parsed_lines(src.read_lines(spark, str(tmp_path / "logs")))
    assert [(r.line_no, r.stage, r.item_status) for r in parsed.orderBy("line_no").collect()][:3] == [(1, "parse", None), (2, "parse", "ok"), (3, "parse", "error")]
    src.write_report(spark.createDataFrame([("=1", "b")], "x string, y string"), str(tmp_path / "out"), ["y", "x"], ["x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"y": "b", "x": "'=1"}
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "k.json").write_text('{"version": "v1"}')
    (tmp_path / "cache" / "u.json").write_text("not json")
    assert {(r.state, r.n) for r in logs.file_states(logs.cache_files(spark, str(tmp_path / "cache")), "v2").collect()} == {("stale", 1), ("unreadable", 1)}


def test_ids_and_digests(spark):
    import hashlib
    import uuid

    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    got = spark.createDataFrame([("1.F.a",), ("é",), ("K.2",)], "k string").select("k", inc.point_id(space, F.col("k")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(space), r.k)) for r in got)
    df = spark.createDataFrame([("b", "h2"), ("a", "h1")], "k string, h string")
    assert inc.corpus_digest(df, "k", "h").first().fingerprint == hashlib.sha256(b"a:h1\nb:h2").hexdigest()
    memo = spark.createDataFrame([("a", "answer")], "k string, draft string")
    work = spark.createDataFrame([("a", "new", "x"), ("b", "new", "x")], "k string, rank string, draft string")
    assert [(r.k, r["rank"], r.draft) for r in inc.restamped(work, memo, ["k"], "draft").collect()] == [("a", "new", "answer")]


def test_compact_payload(spark):
    df = spark.createDataFrame([("long text", ["a", "b", "c"], "secret", None)], "t string, l array<string>, code string, n string")
    r = tx.as_payload(tx.compact(df, {"t": 4}, {"l": 2}, ["code"]), ["t", "l", "n"]).first()
    assert json.loads(r.payload) == {"t": "long", "l": ["a", "b"]}


def test_streamed_stages_match_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 5}:30:00", f"stage=s{i % 4} " + ("Error here" if i % 5 == 0 else "done" if i % 3 == 0 else "go on")) for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "text"]))
    df.write.parquet(str(tmp_path / "in"))
    stream = live.stage_status(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "text", "10 days")
    q = stream.writeStream.format("memory").queryName("stages").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("stages").collect())) == sorted(map(tuple, live.stage_status(df, "ts", "text").collect()))


def test_old_decision_tables_are_deleted(spark, tmp_path):
    fold = live.keep_latest(["item"], "at", "decision", str(tmp_path / "d"))
    for e in range(4):
        fold(spark.createDataFrame([(e % 2, e, f"x{e}")], "item int, at int, decision string"), e)
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["d.2", "d.3"]
    assert {(r.item, r.decision) for r in spark.read.parquet(str(tmp_path / "d.3")).collect()} == {(0, "x2"), (1, "x3")}


def test_pieces_are_trimmed_of_spaces(spark):
    """A digit at a piece's edge that equals its place in the list stays; spaces go."""
    pages = spark.createDataFrame([("d", 1, "66\n a\nb\nc\nd\ne\n 6 \n")], "doc string, page int, text string")
    assert st.printed_page(pages).first().printed == 6
    text = "0 first sentence of the lesson. Something else is said between. The second 1 sentence ends here 1"
    quote = "0 first sentence of the lesson.  ...  The second 1 sentence ends here 1"
    got = spark.createDataFrame([(quote, text), ("not in there at all ... The second 1 sentence", text)], "q string, t string")
    assert [r.g for r in got.select(vd.grounded(F.col("q"), F.col("t")).alias("g")).collect()] == [True, False]


def test_arms_equal_a_loop(spark):
    rng = random.Random(3)
    words = ["sun", "moon", "read", "story", "students", "write", "draw", "river", "stone", "cloud"]
    items = [(e, i, rng.choice("abc"), rng.randrange(3), " ".join(rng.choices(words, k=rng.randrange(2, 9)))) for e in "xy" for i in range(40)]
    out = rc.query_arms(spark.createDataFrame(items, "entity_id string, at int, source string, priority int, text string"), 9)
    got = {(r.entity_id, r.query_index): (r.source, r.text) for r in out.collect()}
    for e in "xy":
        kept = []
        for _, i, source, priority, text in (r for r in items if r[0] == e and len(r[4]) >= 12):
            own = {w for w in text.split() if w not in rc.BOILERPLATE}
            same = lambda k: k[3] == text or (own and k[4] and (len(own & k[4]) >= 0.88 * len(own | k[4]) or len(own & k[4]) >= 0.88 * min(len(own), len(k[4]))))  # noqa: B023, E731
            if not any(map(same, kept)):
                kept.append((priority, i, source, text, own))
        assert [got.get((e, n)) for n in range(1, 10)] == [(k[2], k[3]) for k in sorted(kept, key=lambda k: k[:2])[:9]] + [None] * max(0, 9 - len(kept))


def test_both_sides_of_located_are_made_once(spark, monkeypatch):
    evidence = spark.createDataFrame([("e", 1, "Opening A"), ("e", 2, "Closing A, step 2"), ("e", 3, "Work B"), ("f", 1, "Opening A")], "entity_id string, at long, location string")
    blocks = spark.createDataFrame([("e", "Opening", "A"), ("e", "Closing and Assessment", "A"), ("e", "Work Time", "A")], "entity_id string, section string, letter string")
    names, real = [], rc.written
    monkeypatch.setattr(rc, "written", lambda df, name, *a: names.append(name) or real(df, name, *a))
    good, bad = rc.located(evidence, blocks)
    assert names == ["located"]
    assert sorted(map(tuple, good.collect())) == [("e", 1, "Opening A"), ("e", 2, "Closing and Assessment A, step 2")]
    assert sorted(map(tuple, bad.collect())) == [("e", 3, "Work B"), ("f", 1, "Opening A")]
