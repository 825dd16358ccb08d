"""Each operator against a brute-force version, with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from braidmark.llm import bpe, dedup_substring, licenses, mixing, ngram_join, pii, quality, tokens, topk, urls  # noqa: E402
from braidmark.llm import queries as llm_queries  # noqa: E402
from braidmark.llm.queries import URL_RULES  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(60)
    base = prose(200).split()
    out = [None, "", "   \n\t", "One", prose(30), "a " * 400, prose(3000), "same\nsame\nother\n" * 30, passage]
    out += [f"{prose(80)} {passage} {prose(40 + i)}" for i in range(6)]
    for i in range(12):  # near copies
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(200)] = "changed"
        out.append(" ".join(copy))
    out += [" ".join(base)] * 3 + [prose(60 + i) for i in range(10)]
    out += ["Mail me.now+x@mail.example.com or 1.2.3.4, +1 (476) 555-6291; card 4111 1111 1111 1111. It's <|endoftext|> 'll''s", 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" ' + prose(60), "Licensed under the Apache License, Version 2.0.\n" + prose(70) + "\nLicensed under CC BY-NC 4.0.", "###$$$ " * 80 + prose(20)]
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    return made + [made[10]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("key", F.lit("a clashing name")).withColumn("n", F.lit(0)).repartition(3)


def split(t):
    return (t or "").encode().split()


def test_quality(docs, rows):
    failed = quality.failures(quality.measure(docs))
    got = {r.doc_id: r for r in quality.judge(failed, quality.host_verdicts(failed)).collect()}
    for i, t, *_ in rows:
        w = [x.decode() for x in split(t)]
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[len(rows) - 2].kept is False and got[14].kept


def test_bad_host_is_held_to_strict_limits(spark):
    rows = [("bad", 60, 300, 0, 1, 0, 60)] * 20 + [("bad", 60, 300, 50, 1, 0, 0), ("good", 60, 300, 50, 1, 0, 0)] + [("good", 60, 300, 0, 1, 0, 0)] * 20
    df = spark.createDataFrame(rows, "source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    failed = quality.failures(df)
    got = {(r.source, r.n_symbols, r.kept) for r in quality.judge(failed, quality.host_verdicts(failed)).collect()}
    assert got == {("bad", 0, False), ("bad", 50, False), ("good", 50, True), ("good", 0, True)}


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(0, 0.2, 8).astype(np.float32).tolist() for i in range(300)}
    vectors |= {i: vectors[7] for i in range(300, 340)}  # ties
    rows = [*vectors.items(), (400, None), (420, [float("nan")] * 8), (440, [1.0, None] * 4), (None, vectors[3])]
    q = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in topk.top_k(q, q.filter("vec_id % 20 = 0"), 20, 64, 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for i, hits in got.items():
        score = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)
        assert hits == [(j, -s) for s, j in score[:20]]


def test_topk_even_weights_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.choice([0, 1, 0.5, 0.25, -0.5], 8)]) for i in range(200)]
    vectors += [(200 + i, [float(i == j) for j in range(8)]) for i in range(8)]  # one-hot
    vectors += [(20, [0.5] * 8), (21, [1.0] * 8), (21, [-1.0] * 8), (220, [0.0] * 8)]
    q = topk.quantise(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(q, q.filter("vec_id % 20 = 0"), 20, 64, 4).collect())
    want = Counter()
    for at, (i, v) in enumerate(vectors):
        if i % 20 == 0:
            score = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), j) for other, (j, w) in enumerate(vectors) if other != at)
            want.update((i, n, j, -s) for n, (s, j) in enumerate(score[:20], 1))
    assert got == want


def test_topk_empty_vectors_and_repeated_rows(spark):
    rows = [(20, [1.0, 2.0]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (22, [0.25, 0.5]), (40, []), (60, []), (41, []), (40, []), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, q string, block int").coalesce(1)
    q = topk.quantise(df)
    got = Counter((r.query_id, r.vec_id, r.score) for r in topk.top_k(q, q.filter("vec_id % 20 = 0")).collect())
    of = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    want = Counter((i, j, of(v, w)) for a, (i, v) in enumerate(rows) if i is not None and i % 20 == 0 for b, (j, w) in enumerate(rows) if j is not None and a != b and len(v) == len(w))
    assert got == want and got[20, 21, of(rows[0][1], rows[1][1])] == 2


@pytest.mark.parametrize("crowded", [2000, 1])
def test_substring(docs, rows, crowded):
    seen, all_words = Counter(), [split(t) for _, t, *_ in rows]
    for w in all_words:
        seen.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = []
    for (i, *_), w in zip(rows, all_words):
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = dedup_substring.remove_repeats(docs, crowded=crowded, shard_words=500).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_token_counts(docs, rows):
    library = Tokenizer.from_file(WORDS)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, WORDS).collect())
    assert got == sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)


def test_long_pretokens():
    library, counter = Tokenizer.from_file(WORDS), tokens.load_counter(WORDS)
    for t in ("ab" * 3000, "x" * 5000, "é" * 700 + "!" * 300):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    alphabet = ["a", "s", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", " ", "é", "1", "!", "漢", "x" * 40]
    many = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(3000)] + ["ab" * 2000 + "'", "a" * 3000]
    import pyarrow as pa

    vocabulary = bpe.load_ranks(RANKS)
    got = [[x for p in parts for x in p] for _, _, parts in bpe.encode_batch(pa.array(many), vocabulary)]
    assert got == [library.encode_ordinary(t) for t in many]
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, RANKS).collect()}
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        assert digests[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}


def test_pii(docs, rows):
    got = {r.doc_id: r for r in pii.find_spans(docs, lambda df, _: df).collect()}
    n = len(rows)
    r, t = got[n - 5], rows[n - 5][1]
    kinds = [(s["kind"], t[s["start"] : s["end"]]) for s in r.all_spans]
    assert kinds == [("email", "me.now+x@mail.example.com"), ("ip", "1.2.3.4"), ("phone", "+1 (476) 555-6291"), ("card", "4111 1111 1111 1111")]
    assert r.n_email == r.n_ip == r.n_card == r.n_phone == 1
    assert got[n - 4].spans == "secret:9:49" and got[0].spans == "" and got[4].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs, lambda df, _: df).collect()}
    assert masked[n - 4].startswith('token = "[SECRET]"') and masked[0] is None and masked[4] == rows[4][1]


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_of(text):
    out = []
    for place, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_pii_base_spans_match_the_patterns(spark, rows):
    rng = random.Random(31)
    parts = ["a@b.co", "x.y@", "@", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49 30 1234567", "+", "12", " ", "-", ".", "word", "é", "\n", "5500000000000004"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + [t for _, t, *_ in rows] + [None]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.find_spans(df, lambda df, _: df).collect():
        want = _base_of(made[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in CONTRACT]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_pii_recall_and_precision_on_planted_rows(spark):
    rng, rows, truth = random.Random(12), [], {}
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k=n))
    secret = [lambda: f'token = "{hexed(40)}"', lambda: f"api key: {mixed(32)}", lambda: f"password={mixed(20)}", lambda: f"Authorization: Bearer {mixed(36)}", lambda: f"secret ghp_{mixed(36)}"]
    plain = [lambda: f"commit {hexed(40)} was merged", lambda: f"the number {rng.randrange(10**15, 10**16)} is prime", lambda: f"sha256 {hexed(64)} of the file", lambda: "a-very-long-hyphenated-compound-word2", lambda: f"order {rng.randrange(10**17, 10**18)} shipped"]
    for i in range(600):
        truth[i] = i % 2 == 0
        rows.append((i, f"some words here {rng.choice(secret if truth[i] else plain)()} and more words"))
    got = {r.doc_id: bool(r.spans) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), lambda df, _: df).collect()}
    hit = sum(got[i] and truth[i] for i in got)
    assert hit >= 0.9 * sum(truth.values()) and hit >= 0.9 * sum(got.values()), (hit, sum(truth.values()), sum(got.values()))


def groups(rows, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = split((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("crowded", [10, 1])
def test_ngram_join(docs, rows, crowded):
    got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in ngram_join.similar_documents(docs, crowded=crowded).collect()]
    assert len(got) == len(rows) and dict(got) == groups(rows)


def test_large_lists_meet_in_blocks(spark, monkeypatch):
    """Copies around the threshold: only lists of few classes are paired, with the groups of all pairs."""
    rng = random.Random(21)
    base, rows = [f"w{i}" for i in range(120)], []
    spots = [(f, f"y{v}") for f in range(6, 115, 12) for v in range(2)]
    for i in range(90):
        words = list(base)
        for at, word in rng.sample(spots, rng.randrange(1, 7)):
            words[at] = word
        rows.append((i, " ".join(words)))
    docs, listed, settle = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [], ngram_join.settle

    def spy(df, name):
        out = settle(df, name)
        if name == "lists":
            listed.append(out.groupBy("t").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "settle", spy)
    for paired in (0, 8):
        got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in ngram_join.judged_rows(docs, paired=paired).collect()]
        assert len(got) == len(rows) and dict(got) == groups(rows)
    assert len(set(c for _, (_, c) in got)) > 1 and len(listed) == 1 and (listed[0] or 0) <= 8


def by_row(rows):
    """doc_id, n_shingles, component_id of each row, judged by its text, and the number of components."""
    found = groups([(i, t) for i, (_, t) in enumerate(rows)])
    named = {}
    for i, (_, c) in found.items():
        if rows[i][0] is not None:
            named[c] = min(named.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], n, named.get(c, rows[i][0])) for i, (n, c) in found.items()]


def same_ids_and_none():
    rng = random.Random(8)
    prose = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    changed = lambda base, *at: " ".join(w if i not in at else f"x{i}" for i, w in enumerate(base))
    shared = [prose() for _ in range(12)]
    rows = [(1, changed(base)) for base in shared] + [(10 + i, changed(base, 50)) for i, base in enumerate(shared)]
    rows += [(2, changed(shared[0], 100)), (2, changed(prose()))]  # one of 1's group, one of its own
    bridge, alone = prose(), changed(prose())
    rows += [(40, changed(bridge)), (None, changed(bridge, 30, 60, 90)), (None, changed(bridge, 30, 60, 90)), (41, changed(bridge, 30, 60, 90, 120, 150, 180))]
    return rows + [(None, alone), (None, alone + " end"), (None, None), (3, None), (3, "")]


def test_ngram_join_repeated_and_null_ids(spark):
    rows = same_ids_and_none()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=order) == sorted(by_row(rows), key=order)


def test_near_duplicates_keeps_other_texts_of_an_id(spark):
    rows = same_ids_and_none()
    rows.append(rows[0])  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    parts = defaultdict(list)
    for i, (n, c) in groups([(i, t) for i, (_, t) in enumerate(rows)]).items():
        parts[c if n else -1 - i].append(rows[i])
    want = [r for r in rows if r[0] is None]
    for part in parts.values():
        ids = [r[0] for r in part if r[0] is not None]
        if ids:
            want += sorted({r for r in part if r[0] == min(ids)})[:1]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_url_feed_has_every_junk_name(spark, tmp_path):
    names = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    pages = [(i, f"http://www.{n}.example.net/x/{i}") for i, n in enumerate(names)] + [(9, "http://ok.example.net/x/9")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in llm_queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: "block" for i in range(6)} | {9: "allow"}


def test_url_filter(spark):
    pages = [(1, "http://A.example.org/es/5?x"), (2, "https://spam.example.net/a/"), (3, "https://www.spam.example.net/a.html#t"), (4, None), (5, "no url"), (6, "http://x.com/de/1"), (7, "http://example.org"), (8, "http://example.org/en/17"), (9, "http://ok.example.net/a"), (9, "http://ok.example.net/a")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([("spam.example.net/a",), (None,)], "canonical string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, listed, URL_RULES, n_blocks=1).collect() if r.page_id != 9)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "example.org/es/", "block"), (2, None, "block"), (3, None, "block"), (4, None, "allow"), (5, None, "allow"), (6, "com/de/", "block"), (7, None, "allow"), (8, "example.org/en/1", "block")]
    assert got[3][1:3] == ("", "") and got[0][1:3] == ("a.example.org", "/es/5")
    assert urls.judge_urls(df, listed, URL_RULES).count() == len(pages)


def test_mixing(docs, rows):
    mix = mixing.Mix(block_docs=4)
    out = mixing.mix_sources(docs, mix).toPandas()
    size = lambda t: len(split(t)) + 1
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    passes = {s: out[out.source.isna() if s is None else out.source == s].mix_tokens.sum() / n for s, n in total.items()}
    # every row once at least; no source beyond the repetition limit, and the lightest near it
    assert set(out.doc_id) == {i for i, *_ in rows} and (out.mix_pass == 1).sum() == len(rows)
    assert max(passes.values()) <= 2.0 and passes[max(total, key=total.get)] == 1
    a = 1 - math.log(2) / math.log(max(total.values()) / min(total.values()))
    exponent = mixing.find_exponent(mixing.source_totals(docs.withColumn("__key", F.coalesce("source", F.lit("-"))).withColumn("__tokens", mixing.tokens_of(F.col("text")))), mix)
    assert exponent == pytest.approx(max(0.0, a), abs=1e-6)
    clashing = docs.withColumns({c: F.lit(-1) for c in ("weight", "full", "rest", "tokens", "passes", "n_blocks", "mix_pass")})
    again = mixing.mix_sources(clashing, mix)
    assert {"weight", "full", "rest", "tokens", "passes", "n_blocks"} <= set(again.columns)
    same = again.select("doc_id", "mix_pass", "mix_block", "full").toPandas()
    assert set(same.full) == {-1} and sorted(zip(same.doc_id, same.mix_pass, same.mix_block)) == sorted(zip(out.doc_id, out.mix_pass, out.mix_block))


def _fate(rows, limits=quality.Limits()):
    """kept by row: the rules, hosts and prior in plain Python."""
    def facts(t):
        w = [x.decode() for x in split(t)]
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        symbols, chars, dup = sum((t or "").count(c) for c in quality.SYMBOLS), sum(map(len, w)), len(lines) - len(set(lines))
        fails = lambda s, d: symbols * 100 > chars * s or dup * 100 > len(lines) * d
        return len(w) < limits.min_words or 100 * len(cover) > limits.max_repeat_pct * len(w), fails(20, 50), fails(15, 30)

    found = [(host, *facts(t)) for host, t in rows]
    hosts = defaultdict(list)
    for host, base, soft, _ in found:
        hosts[host].append(base or soft)
    rates = [sum(v) / len(v) for v in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = max(limits.least_strength, min(limits.most_strength, m * (1 - m) / v - 1 if v > 0 else limits.most_strength))
    limit = round(min(limits.host_rate, m + limits.host_z * math.sqrt(m * (1 - m) / (k + 1))), 9)
    bad = {h: round((sum(x) + m * k) / (len(x) + k), 9) > limit for h, x in hosts.items()}
    return [not base and not (strict if bad[host] else soft) for host, base, soft, strict in found], bad


def test_host_verdicts_change_rows(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows = []
    for h in range(8):
        for _ in range(40):
            junk = rng.random() < (0.45 if h == 0 else 0.1)
            rows.append((f"h{h}", "short" if junk else prose(60) + " " + "#" * rng.choice([0, 0, 50, 60, 70, 90])))
    rows += [(None, prose(60)), (None, None), ("h1", "")]
    want, bad = _fate(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, text string").withColumns({"n": F.lit(1), "host": F.lit("x")})
    failed = quality.failures(quality.measure(df))
    got = {r.doc_id: r.kept for r in quality.judge(failed, quality.host_verdicts(failed)).collect()}
    assert [got[i] for i in range(len(rows))] == want and bad["h0"] and sum(bad.values()) < len(bad)
    lenient, _ = _fate(rows, quality.Limits(host_rate=2.0, host_z=100.0))
    assert lenient != want  # some rows go because of their host alone


def test_url_filter_by_brute_force(spark):
    rng = random.Random(17)
    hosts = ["example.org", "a.example.org", "x.com", "COM", "bad.net", "www.bad.net", "m.ok.net", "notexample.org", "spam-farm.net", ""]
    paths = ["", "/", "/es/1", "/en/17", "/en/2", "/fr/x", "/de/", "/a", "/a/", "/a.html", "/a/index.htm"]
    made = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/de/', '#t'])}" for _ in range(800)] + [None, "no url", "", "://", "http://bad.net/a" + "b" * 5000]
    listed = ["bad.net/a", "ok.net/a", "bad.net", None]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def judged(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(low)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: (len(r.text), r.text))
            return host, path, best.text, best.verdict
        canon = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/index)?(\.html?)?/*$", "", path) if host else None
        return host, path, None, "block" if canon is not None and canon in listed else "allow"

    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").withColumns({"rule": F.lit("clash"), "block": F.lit(7), "canonical": F.lit("clash")})
    feed = spark.createDataFrame([(x,) for x in listed], "canonical string")
    for n_blocks in (1, 64):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, feed, URL_RULES, n_blocks=n_blocks).collect()}
        assert got == {i: judged(u) for i, u in enumerate(made)}
    assert urls.judge_urls(df.limit(0), feed, URL_RULES).count() == 0 and urls.judge_urls(df, feed.limit(0), URL_RULES).filter("rule IS NULL AND verdict = 'block'").count() == 0


def _xx(parts, seed=42):
    """The 64-bit hash of Spark's xxhash64 for strings, ints and longs."""
    import struct

    import xxhash

    for kind, x in parts:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", x), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_mixing_by_brute_force(spark):
    rng = random.Random(41)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choices(["hot", "a", "b", None], weights=[6, 2, 1, 1])[0]) for i in range(400)]
    mix = mixing.Mix(block_docs=16)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.mix_pass, r.mix_block, r.mix_block_pos) for r in mixing.mix_sources(docs, mix).collect())
    size, by = {i: len(t.split()) + 1 for i, t, _ in rows}, defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    tokens = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    a = mixing.find_exponent(mixing.source_totals(docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("__key"), mixing.tokens_of(F.col("text")).alias("__tokens"))), mix)
    raw = {s: n**a for s, n in tokens.items()}
    budget = sum(raw.values()) / min(n ** (a - 1) for n in tokens.values())
    want = []
    for s, ids in by.items():
        n_blocks, passes = -(-len(ids) // mix.block_docs), round(raw[s] / sum(raw.values()) * budget / tokens[s], 9)
        full = math.floor(passes)
        rest, blocks = math.floor((passes - full) * tokens[s]), defaultdict(list)
        for i in ids:
            blocks[_xx([("i", mix.seed), ("l", i)]) % n_blocks].append(i)
        for p in range(1, full + 2):
            order = sorted(blocks, key=lambda b: (_xx([("i", mix.seed), ("i", p), ("l", b)]), b))
            used = 0
            for place, b in enumerate(order, 1):
                whole = sum(size[i] for i in blocks[b])
                room = whole if p <= full else rest - used
                used += whole
                taken, so_far = [], 0
                for i in sorted(blocks[b], key=lambda i: (_xx([("i", mix.seed + 1), ("i", p), ("l", i)]), i)):
                    so_far += size[i]
                    if room >= whole or (room > 0 and so_far <= room):
                        taken.append(i)
                want += [(i, p, b, place) for i in taken] if room > 0 else []
    assert got == sorted(want)


def test_licenses(docs, rows):
    model = licenses.train(docs)
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    hit = got[len(rows) - 3]
    assert hit.families == "apache-2.0,cc-by-nc-4.0" and hit.n_license == 2 and hit.n_paragraphs == 3
    assert sum(r.n_license for r in got.values()) == 2
    texts, kinds = licenses.wordings([t for _, t, *_ in rows if t and len(t) > 100][:20], seed=99)  # other cuts and foreign words
    import pyarrow as pa

    hashes, before = licenses._word_numbers(pa.array(texts))
    guess = licenses._scores(model, hashes, before).argmax(1)
    assert (guess == np.array(kinds)).mean() > 0.9
    # wordings that no training saw
    apart = [(t, k) for k, f in enumerate(licenses.FAMILIES, 1) for t in licenses.HELD_OUT[f]] + [(t, 0) for t in licenses.HELD_OUT_NONE]
    hashes, before = licenses._word_numbers(pa.array([t for t, _ in apart]))
    guess = licenses._scores(model, hashes, before).argmax(1)
    assert (guess == np.array([k for _, k in apart])).mean() >= 0.75, guess


def test_licence_confirmation_by_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    made, want = [], {}
    for i, (family, group) in enumerate((f, t) for f, g in licenses.TEMPLATES.items() for t in g):
        made.append((i, f"{prose(40)}\n{group}\n{prose(30)}"))
        want[i] = family
    made += [(100 + i, "\n".join(prose(20) for _ in range(5))) for i in range(40)] + [(200, None), (201, ""), (201, "")]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("families", F.lit("clash"))
    got = {r.doc_id: r.families for r in licenses.scan(df, licenses.train(df)).collect()}
    assert sum(got[i] == f for i, f in want.items()) >= 0.95 * len(want) and not any(got[i] for i in got if i >= 100)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    failed = quality.failures(quality.measure(none))
    assert quality.judge(failed, quality.host_verdicts(failed)).count() == 0
    assert dedup_substring.remove_repeats(none).count() == 0
    assert tokens.count_tokens(none, WORDS).count() == 0 and bpe.token_digests(none, RANKS).count() == 0
    assert pii.find_spans(none, lambda df, _: df).count() == 0
    assert ngram_join.similar_documents(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert licenses.scan(none, licenses.train(none)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), "").count() == 0, name
    empty = topk.quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).count() == 0


def test_stages_keep_columns_of_clashing_names(spark, rows):
    names = ("n_words", "kept", "soft_failed", "host", "n", "k", "h", "component_id", "mix_pass", "mix_weight", "weight", "tokens", "found", "kind")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "").select(df.columns)
        assert out.count() > 0 and out.filter(" OR ".join(f"{c} != 'mine'" for c in names)).count() == 0, name


def test_null_and_repeated_ids_dont_multiply(spark):
    rows = [(None, f"text {i} " + "same words here " * 20) for i in range(300)] + [(None, "one two three " * 30)] * 200 + [(7, "one two three " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup_substring.remove_repeats(df).count() == len(rows)
    assert ngram_join.similar_documents(df).count() == len(rows)


def test_pipeline(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    stages, now = dict(corpus_pipeline.STAGES), df
    kept = stages["quality_rules"](spark, now, "").select("doc_id", "text").collect()
    good = {r.doc_id for r in kept}
    first = {c for i, (_, c) in groups([r for r in rows if r[0] in good]).items()}
    assert set(out.doc_id) == first and len(out) >= len(first)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = {i: t for i, t, *_ in rows}
    for r in out.itertuples():
        spans = pii.base_spans(whole[r.doc_id])
        if not spans and "token" not in whole[r.doc_id]:
            assert r.n_tokens == len(library.encode_ordinary(whole[r.doc_id]))
