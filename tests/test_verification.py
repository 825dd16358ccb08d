"""Second divisions, and the battery's checks that apply to some documents only."""

from pyspark.sql import functions as F

from braidmark.operators import verification as vf

_LESSONS = "doc long, place int, code string, grade int, module int, unit int, lesson int, page_start int, page_end int, declared array<string>, minutes int, blocks array<struct<section:string,letter:string,page:bigint,n_steps:bigint>>, materials array<string>, vocabulary array<string>, parsed_by string"


def _lesson(doc, place, code, minutes=50, by="docling"):
    return (doc, place, code, 1, 2, 1, place, 5 * place, 5 * place + 4, ["W.1.1"], minutes, [("Opening", "A", 1, 1)], ["m"], ["v"], by)


def test_repeated_codes_and_missing_lessons(spark):
    rows = [_lesson(1, 1, "a"), _lesson(1, 2, "a"), _lesson(1, 3, "b", None), _lesson(1, 4, "c"), _lesson(2, 1, "a", None), _lesson(2, 2, "a"), _lesson(2, 3, "d", by="pymupdf")]
    lessons = spark.createDataFrame(rows, _LESSONS)
    found = lambda second: sorted(map(tuple, vf.disagreements(lessons, second).collect()))
    assert found(lessons) == []
    assert found(lessons.filter("code != 'c'")) == [(1, "c")]
    assert found(lessons.withColumn("minutes", F.when(F.col("place") != 2, F.col("minutes")).otherwise(0))) == [(1, "a"), (2, "a")]
    assert found(lessons.limit(0)) == [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "a")]


def test_headers_are_found_once_for_all_checks(spark, monkeypatch):
    lessons = spark.createDataFrame([_lesson(1, 1, "a"), _lesson(2, 1, "a")], _LESSONS)
    pages = spark.createDataFrame([(1, 5, "Unit 1: Lesson 1 and W.1.1"), (2, 5, "none")], "doc long, page int, text string")
    docs = spark.createDataFrame([(1, 9, 9, None, None, None), (2, 9, 8, 1, "fonts", None)], "doc long, page_count int, guide_pages int, expected int, separation_fallback string, engine_fallback string")
    overviews = spark.createDataFrame([(1, 1, 4), (2, 1, 3)], "doc long, start int, end int")
    times, real = [], vf.headers
    monkeypatch.setattr(vf, "headers", lambda p: times.append(1) or real(p))
    got = {(r.doc, r.name): r.n_bad for r in vf.battery(lessons, pages, docs, overviews).collect()}
    assert len(times) == 1 and None not in {n for _, n in got}
    assert (got[1, "V1 lesson count"], got[2, "V1 lesson count"], got[1, "V7 headers match"], got[2, "V7 headers match"], got[2, "V10 codes grounded"], got[2, "V2 pages partitioned"]) == (0, 0, 0, 1, 1, 1)
    assert (1, "V16 page count") not in got and got[2, "V16 page count"] == 1 and (1, "V0 separation fallback") not in got and (1, "V15 second division agrees") not in got


def test_ungrounded_codes_do_not_lay_out_a_spans_pages(spark):
    span = lambda code, start, end, declared, doc=1: (*_lesson(doc, 1, code)[:7], start, end, declared, *_lesson(doc, 1, code)[10:])
    rows = [
        span("long", 1, 2_000_000_000, ["W.1.1", "W.1.2", "W.1.9", "W.1.1", None]), span("one", 5, 5, ["W.1.1", "W.1.2"]), span("after", 6, 9, ["W.1.1"]), span("back", 5, 4, ["W.1.1"]), span("back", 4, 5, ["W.1.1"]),
        span("open", None, 9, ["W.1.1"]), span("open", 1, None, ["W.1.2"]), span(None, 5, 5, ["W.1.1"]), span("doc", 5, 5, ["W.1.1"], None), span("other", 5, 5, ["W.1.1"], 2),
    ]
    pages = spark.createDataFrame([(1, 5, "W.1.1 and W.1.1"), (1, None, "W.1.9"), (None, 5, "W.1.1"), (1, 1_999_999_999, "W.1.2"), (2, 6, "W.1.1"), (2, 7, None)], "doc long, page int, text string")
    got = {tuple(r) for r in vf.ungrounded_codes(spark.createDataFrame(rows, _LESSONS), pages).collect()}
    assert got == {(1, "long", "W.1.9"), (1, "long", None), (1, "one", "W.1.2"), (1, "after", "W.1.1"), (1, "open", "W.1.1"), (1, "open", "W.1.2"), (1, None, "W.1.1"), (None, "doc", "W.1.1"), (2, "other", "W.1.1")}
