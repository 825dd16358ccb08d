"""Conversation repair, periodic runs and MinHash groups against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidmark.llm import minhash, periodic, repair
from braidmark.llm.words import U

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


# --- conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def plain_repair(rows):
    """Counts and the least audit by trying all states row by row; audits whole."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.encode().rstrip(SPACES)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1:] not in (b".", b"!", b"?") else 0)
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def keep(to, q, found):
        if q not in to or found < to[q]:
            to[q] = found

    def inserts(now):
        for _ in range(3):
            for (p, x), q in list(after.items()):
                if p in now and x in "ua":
                    cost, audit, lines = now[p]
                    keep(now, q, (cost + 2, audit + "I", (*lines, f"{'user' if x == 'u' else 'assistant'}:")))
        return now

    best = inserts(best)
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for p, (cost, audit, lines) in best.items():
            keep(new, p, (cost + 3, audit + "D", lines))
            if fault in (1, 2):
                continue
            more = fault == 3
            if (p, role[:1]) in after and role[:1]:
                keep(new, after[p, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for x, name in (("u", "user"), ("a", "assistant")):
                if (p, x) in after:
                    keep(new, after[p, x], (cost + more + 2, audit + "R", (*lines, f"{name}:{text}")))
        best = inserts(new)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations():
    rng = random.Random(6)
    rows = []
    for conv in [*range(150), None]:
        n = rng.choice([0, 1, 2, 3, 6, 9, 40])
        for t in range(n):
            turn = rng.choice([t, t, t, t + 1, None, 3])
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "u", "assist"])
            rows.append((conv, turn, role, rng.choice(["Hi.", "no end", "  \n\t", "", None, f"say {rng.random()}.", "ünd é!\x0b", "what?  "])))
    rows += [(1000, 0, "user", "same.")] * 30 + [(1001, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(700)]
    rows += [(1002, None, None, None)] * 5 + [(1003, 0, "user", "long text. " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_rows", [256, 3])
def test_conversation_repair(spark, most_rows):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, th string, pos int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(df), most_rows=most_rows).collect()}
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    assert got == {c: plain_repair(r) for c, r in by.items()}


def test_conversations_without_rows_left(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repaired_conversations(df).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair.repaired_conversations(df.limit(0)).count() == 0


def test_least_audit_in_parts():
    """The bidirectional search, whole and over joined parts, against the plain one."""
    rng = random.Random(3)
    for _ in range(150):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"{i}.", f"{i}", "", "x."])) for i in range(rng.randint(0, 9))]
        want = plain_repair(rows)
        seen, steps = set(), []
        for _, _, role, text in rows:
            fault = 1 if not text else 2 if (role, text) in seen else 3 if text[-1] != "." else 0
            seen.add((role, text))
            steps.append((role[:1], fault, 1))
        assert repair.solved(tuple(steps)) == want[5:7]
        cut = rng.randint(0, len(steps))
        halves = [repair.crossings(tuple(x)) for x in (steps[:cut], steps[cut:])]
        assert repair.least_audit(halves, repair.START, repair.ENDS, ()) == want[5:7]


# --- periodic runs


def plain_runs(x, least=24, times=3):
    out = set()
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, times * p) and j > i:
                s = x[i : j + p]
                if not any(p % q == 0 and s[q:] == s[:-q] for q in range(1, p)):
                    out.add((i, len(s), p))
            i = j + 1
    return sorted(out)


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 18))]
        want = [max(k for k in range(1, len(x) - i + 1) if all(x[i : i + k] < x[i + c : i + k] for c in range(1, k))) for i in range(len(x))]
        assert periodic.lyndon_array(x) == want


def test_runs_of_words():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            x += x[-rng.randint(1, 9) :] * rng.randint(1, 9)
        x = x[:400]
        assert [tuple(r) for r in periodic.runs_of(np.array(x, np.int64)).tolist()] == plain_runs(x)
        assert [tuple(r) for r in periodic.runs_of(np.array(x, np.int64), 4, 2).tolist()] == plain_runs(x, 4, 2)
    fib = [0], [0, 1]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    assert [tuple(r) for r in periodic.runs_of(np.array(fib[1]), 2, 2).tolist()] == plain_runs(fib[1], 2, 2)


def plain_periodic(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_periodic_documents(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["äb", "c d", "e", "ff", "g."]) + str(rng.randint(0, 60)) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "a " * 24, "a " * 23, "x y z " * 300, prose(50) + " " + (prose(7) + " ") * 5 + prose(20), (prose(3) + "\n") * 9 + (prose(4) + "\x0b") * 7]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, prose(rng.choice([5, 30, 90, 200]))) for i in range(60)] + [(6, texts[6]), (6, "other"), (None, texts[6]), (None, prose(30))]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, start int, runs string").repartition(3)
    got = sorted(map(tuple, periodic.find_runs(df, order=periodic.planted_repeats).collect()), key=str)
    assert got == sorted((plain_periodic(*r) for r in rows), key=str)
    kept = {r.doc_id: r for r in periodic.find_runs(df.filter("doc_id < 100"), keep=True).collect()}
    assert kept[4].collapsed == "a" and [tuple(x) for x in kept[4].runs] == [(0, 24, 1)] and kept[5].n_runs == 0
    assert periodic.find_runs(df.limit(0)).count() == 0


# --- MinHash


def plain_signature(elements, m):
    values = [2**64 - 1] * m
    for e in elements:
        order = list(range(m))
        for rank in range(m):
            place, fraction = minhash._draws(np.array([e], U), rank, m)
            order[rank], order[int(place[0])] = order[int(place[0])], order[rank]
            values[order[rank]] = min(values[order[rank]], (rank << 48) + int(fraction[0]))
    return values


def test_superminhash_values_and_variance():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n, dtype=U) for n in (1, 2, 0, 15, 40, 300)]
    got = minhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 24)
    assert [list(map(int, g)) for g in got] == [plain_signature(s, 24) for s in sets]
    found = []
    for _ in range(150):
        u = rng.integers(0, 2**63, 100, dtype=U)
        pair = minhash.signatures(np.concatenate([u[:90], u[10:]]), np.array([90, 90]), 128)
        found.append((pair[0] == pair[1]).mean())
    assert abs(np.mean(found) - 0.8) < 0.01 and np.std(found) < 0.9 * (0.8 * 0.2 / 128) ** 0.5


def groups(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in product(range(len(rows)), repeat=2):
        if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_minhash_groups(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (12, 40, 200, 200, 900)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "One two"), (6, "one TWO"), (7, "one two one two one")]
    for b in base:
        for _ in range(14):  # a chain and a star of near copies
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(rng.choices(vocab, k=60))) for i in range(25)]
    rows += [rows[10], rows[10], (10, "another text of that id altogether"), (None, rows[40][1]), (None, "alone without id here"), (None, "alone without id here")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, k string, n int").repartition(3)
    found = minhash.near_duplicates(df).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == sorted(groups(rows, 2, 80), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_forest():
    rng = random.Random(2)
    forest, plain = minhash.Forest(), list(range(60))
    for _ in range(45):
        a, b = rng.sample(range(60), 2)
        forest.join(a, b)
        x, y = plain[a], plain[b]
        plain = [min(x, y) if r in (x, y) else r for r in plain]
    assert [forest.root(i) for i in range(60)] == plain
    assert dict(zip(*forest.edges())) == {i: r for i, r in enumerate(plain) if i != r}


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, n).astype(U)) for n in (1, 5, 90, 300, 40, 7)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[2:]] for a in sets[:4]]
    assert minhash.common_counts(sets[:4], sets[2:], at_once=64).astype(int).tolist() == want


def test_mixing_deals_null_and_repeated_ids_by_row(spark):
    from braidmark.llm import mixing

    rows = [(None, f"w{i} x", "hot", i) for i in range(3000)] + [(i, "a b c", "hot", i) for i in range(2000)] + [(7, "a b c", "hot", 7)] * 2500 + [(9, f"t{i}", "cold", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    mix = mixing.Mix(block_docs=500)
    pick = lambda df: sorted((repr(tuple(r)) for r in mixing.mix_sources(df, mix).select("doc_id", "text", "source", "extra", "mix_pass", "mix_block", "mix_order").collect()))
    got = pick(docs)
    assert got == pick(docs.repartition(7, "extra").orderBy(F.rand(3)))
    out = mixing.mix_sources(docs, mix).toPandas()
    first = out[out.mix_pass == 1]
    assert len(first) == len(rows)
    # 3000 null ids and 2501 equal rows are spread over their source's blocks
    assert first[first.source == "hot"].groupby("mix_block").size().max() < 1.25 * 500
    assert sorted(first.text) == sorted(r[1] for r in rows)


def test_few_links_are_joined_without_stars(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = spark.createDataFrame(pairs + [(7, 7)], "a long, b long").repartition(4)
    by_stars = {(r.node, r.component) for r in minhash.union_find(edges, most_edges=10).collect()}
    monkeypatch.setattr(minhash, "components", lambda *_: pytest.fail("stars"))
    assert sorted(tuple(r) for r in minhash.union_find(edges).collect()) == sorted(by_stars)
    plain = list(range(1200))
    for a, b in pairs * 300:
        if plain[a] != plain[b]:
            plain[a] = plain[b] = min(plain[a], plain[b])
    assert by_stars == {(x, plain[x]) for p in pairs if p[0] != p[1] for x in p}
    assert minhash.union_find(edges.limit(0)).count() == 0
