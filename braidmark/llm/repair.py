"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A repaired conversation's role initials read (s?(ua)+)?: nothing, or an optional system message
and pairs of user and assistant. Edits: Keep (0), Rerole to user or assistant (2), Delete (3,
required for blank and duplicate rows), Insert an empty user or assistant message (2); a truncated
row that stays adds 1. Among the cheapest the audit (the edits' initials in order) that is least
in ASCII is taken; it fixes the roles too, as the place in (ua)+ does.

The edit lattice has a node for each (rows read, state of the pattern). A forward and a reverse
heap walk it from both ends until their least costs together exceed the best crossing; by then
every crossing of that cost is known, and the least concatenated audit of them is the answer.
Audits of one cost between two nodes are never prefixes of each other (the same rows give the same
number of K, R and D, and more I cost more), so least parts make least wholes.

Equal rows of a turn are counted before they are shuffled. Rows are then dealt by range of
(conversation, turn, role, text), so a conversation of any length is spread over tasks, and
written in that order. Each task walks its rows in stretches of one conversation (at most
`most_rows`). A stretch whose both ends are seen is finished at once. Others give their cheapest
audit between every two states; stretches side by side make a lattice of their own and are joined,
JOINED at a time, until one is left. The digest of a long conversation's repaired text is serial
by nature: one task streams its rows, a batch at a time.

Defined results: rows are taken by turn (nulls first), ties by role, then by the text's md5; a
null text, role, turn or conv_id counts as one space in keys and texts; a null conv_id is a
conversation of its own, returned as null; a role without s, u or a at its start (an empty one
too) can't be kept; repeated rows are duplicates; very long texts are whole; extra columns are
ignored; an empty table gives an empty result. Texts are told apart by md5.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmark.llm.store import bound_batches, discard, settle

#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. Ends: nothing or after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_AFTER = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
_NEW_ROLE = _AFTER["u"] + _AFTER["a"]
_INSERTS = tuple((p, q, 2, "I") for p, q in _NEW_ROLE)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
Edge = tuple[int, int, int, str]  # from state, to state, cost, letters


@lru_cache(1 << 12)
def row_edges(initial: str, fault: int, times: int = 1) -> tuple[Edge, ...]:
    """The edits of one row; of a duplicate that stands there so many times."""
    out = [(q, q, 3 * times, "D" * times) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = fault == TRUNCATED
        out += [(p, q, int(more), "K") for p, q in _AFTER.get(initial, ())]
        out += [(p, q, 2 + more, "R") for p, q in _NEW_ROLE]
    return tuple(out)


def least_audit(steps: list[tuple[Edge, ...]], start: int, ends: tuple[int, ...], within: tuple[Edge, ...] = _INSERTS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest walk over all steps from a state to one of ends, ties to the least audit; None if there is none.

    within: edges that stay between the same two steps.
    """
    n = len(steps)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in ends}
    heap, back = [(0, 0, start)], [(0, -n, q) for q in ends]
    gone: set[tuple[int, int]] = set()
    gone_back: set[tuple[int, int]] = set()
    best = None
    if (0, start) in behind:  # no steps
        best = (0, "")

    def relax(labels, others, queue, node, cost, audit, forward):
        nonlocal best
        old = labels.get(node)
        if old is not None and old <= (cost, audit):
            return
        labels[node] = (cost, audit)
        heappush(queue, (cost, node[0] if forward else -node[0], node[1]))
        if (other := others.get(node)) is not None:
            met = (cost + other[0], audit + other[1] if forward else other[1] + audit)
            if best is None or met < best:
                best = met

    while heap and back and (best is None or heap[0][0] + back[0][0] <= best[0]):
        # edges of no cost go to later rows, so at one cost rows are settled in order
        if heap[0][0] <= back[0][0]:
            _, i, q = heappop(heap)
            if (i, q) in gone:
                continue
            gone.add((i, q))
            cost, audit = ahead[i, q]
            for edges, j in ((within, i), (steps[i], i + 1)) if i < n else ((within, i),):
                for p, r, c, letters in edges:
                    if p == q:
                        relax(ahead, behind, heap, (j, r), cost + c, audit + letters, True)
        else:
            _, i, q = heappop(back)
            i = -i
            if (i, q) in gone_back:
                continue
            gone_back.add((i, q))
            cost, audit = behind[i, q]
            for edges, j in ((within, i), (steps[i - 1], i - 1)) if i else ((within, i),):
                for p, r, c, letters in edges:
                    if r == q:
                        relax(behind, ahead, back, (j, p), cost + c, letters + audit, False)
    return best


@lru_cache(1 << 16)
def solved(rows: tuple[tuple[str, int, int], ...]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of (initial, fault, times) rows; short ones come again and again."""
    return least_audit([row_edges(*x) for x in rows], START, ENDS)


@lru_cache(1 << 12)
def crossings(rows: tuple[tuple[str, int, int], ...]) -> tuple[Edge, ...]:
    """The cheapest audit between every two states."""
    steps = [row_edges(*x) for x in rows]
    return tuple((p, q, *found) for p in range(4) for q in range(4) if (found := least_audit(steps, p, (q,))))


class RepairedDigest:
    """sha256 of the repaired `role:text` lines, fed row by row; holds one row at a time."""

    def __init__(self, audit: str):
        self.hash, self.first, self.letters, self.state = hashlib.sha256(), True, iter(audit), START

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def _new_role(self) -> str:
        return "assistant" if self.state == USER else "user"

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._line(self._new_role(), "")
                continue
            if letter != "D":
                self._line(role if letter == "K" else self._new_role(), text)
            return

    def hexdigest(self) -> str:
        for _ in self.letters:  # inserts at the end
            self._line(self._new_role(), "")
        return self.hash.hexdigest()


LOWEST = -(2**63)
ORDER = ("conv_id", "turn", "role", "th")
JOINED = 32  # stretches joined at a time
_SPACES = " \t\n\x0b\x0c\r"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
_EDGES = "array<struct<p: int, q: int, cost: long, audit: string>>"
_PART = "conv_id long, at long, " + "".join(f"{c} long, " for c in _COUNTS) + f"low long, high long, head string, tail string, done boolean, cost long, audit string, repaired_sha256 string, edges {_EDGES}"
_PART_NAMES = [x.split()[0] for x in _PART.split(", edges")[0].split(", ")] + ["edges"]
_EDGE_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PART_TYPES = [pa.int64()] * 10 + [pa.string()] * 2 + [pa.bool_(), pa.int64(), pa.string(), pa.string(), _EDGE_TYPE]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times (equal rows) after damage by crc32(`conv_id:turn`) % 20.

    0 drops a row, 1 empties its text, 2 takes out its [.!?], 3 repeats it, 4 sets role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    given = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), case.alias("case")).filter("case != 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = given.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("times"))
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) written in order, with pos, fault and, if seen in an earlier turn, again."""
    rows = settle(rows.withColumn("th", F.md5(F.col("text").cast("binary"))), "turns")
    turn = F.coalesce("turn", F.lit(LOWEST))
    often = rows.groupBy("conv_id", "role", "th").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    often = settle(often.selectExpr("conv_id AS often_id", "role AS often_role", "th AS often_th", "first"), "often")  # a table of known size: sent to all tasks only if small
    same = F.col("conv_id").eqNullSafe(F.col("often_id")) & (F.col("role") == F.col("often_role")) & (F.col("th") == F.col("often_th"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1)
    later = F.coalesce(turn > F.col("first"), F.lit(False))
    fault = F.when(end == "", BLANK).when(later, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    judged = rows.join(often, same, "left").select("conv_id", "turn", "role", "th", "text", "times", fault.alias("fault"))
    out = settle(judged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id()).drop("th"), "ordered")
    discard(rows, often)
    return out


class _Stretch:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv_id, at: int, starts: bool):
        self.conv_id, self.at, self.next, self.starts, self.bytes = conv_id, at, at, starts, 0
        self.rows: list[tuple[str, int, int]] = []
        self.texts: list[tuple[str, str, int]] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.head = self.tail = None

    def add(self, turn, role: str, text: str, times: int, fault: int) -> None:
        initial, counts = role[:1], self.counts
        self.rows.append((initial, fault, 1))
        if times > 1:
            self.rows.append(("", BLANK if fault == BLANK else DUPLICATE, times - 1))
            counts["blank" if fault == BLANK else "duplicate"] += times - 1
        if fault:
            counts[_COUNTS[fault]] += 1
        counts["n"] += times
        counts["illegal"] += (initial * 2 not in ("su", "ua", "au")) * (times - 1)
        if self.tail is not None:
            counts["illegal"] += self.tail + initial not in ("su", "ua", "au")
        if turn is not None and turn != self.high:
            counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.head, self.tail = initial if self.head is None else self.head, initial
        self.texts.append((role, text, times))
        self.bytes += len(text)
        self.next += 1

    def row(self, ends: bool) -> tuple:
        """Finished if both ends of the conversation are here."""
        cost = audit = digest = edges = None
        rows = tuple(self.rows)
        if done := self.starts and ends:
            cost, audit = solved(rows)
            digest = RepairedDigest(audit)
            for role, text, times in self.texts:
                for _ in range(times):
                    digest.row(role, text)
            digest = digest.hexdigest()
        else:
            edges = [dict(zip("pq", e[:2], strict=True), cost=e[2], audit=e[3]) for e in crossings(rows)]
        return (self.conv_id, self.at, *self.counts.values(), self.low, self.high, self.head, self.tail, done, cost, audit, digest, edges)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_PART_NAMES), _PART_TYPES, strict=True)], names=_PART_NAMES)


def _walked(most_rows: int, most_bytes: int):
    """Stretches of the ordered rows of a task."""

    def run(batches):
        stretch, last, out = None, None, []
        for batch in batches:
            for conv_id, turn, role, text, times, fault, pos in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                follows = stretch is not None and stretch.next == pos
                same = follows and stretch.conv_id == conv_id
                if not same or len(stretch.rows) >= most_rows or stretch.bytes > most_bytes:
                    if stretch is not None:
                        out.append(stretch.row(follows and not same))
                    stretch = _Stretch(conv_id, pos, follows and not same)
                    if len(out) >= 2000:
                        yield _table(out)
                        out = []
                stretch.add(turn, role, text, times, fault)
        if stretch is not None:
            out.append(stretch.row(False))
        yield _table(out)

    return run


def _joined(table: pa.Table) -> pa.Table:
    """One stretch of those of a conversation that follow one another."""
    parts = sorted(table.select(_PART_NAMES).to_pylist(), key=lambda r: r["at"])
    steps = [tuple((e["p"], e["q"], e["cost"], e["audit"]) for e in r["edges"]) for r in parts]
    edges = [{"p": p, "q": q, "cost": found[0], "audit": found[1]} for p in range(4) for q in range(4) if (found := least_audit(steps, p, (q,), ()))]
    out = parts[0] | {"edges": edges}
    for r in parts[1:]:
        for c in _COUNTS:
            out[c] += r[c]
        out["illegal"] += out["tail"] + r["head"] not in ("su", "ua", "au")
        out["turns"] -= out["high"] is not None and out["high"] == r["low"]
        out |= {"low": r["low"] if out["low"] is None else out["low"], "high": out["high"] if r["high"] is None else r["high"], "tail": r["tail"]}
    return pa.Table.from_batches([_table([tuple(out[c] for c in _PART_NAMES)])])


def _streamed(batches):
    """conv_id, repaired_sha256: rows of a conversation come in order, its audit (as the text of a first row) before them."""
    digest, of, ids, digests = None, None, [], []
    for batch in batches:
        for conv_id, pos, role, text, times in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if pos < 0:
                if digest is not None:
                    ids.append(of)
                    digests.append(digest.hexdigest())
                digest, of = RepairedDigest(text), conv_id
                continue
            for _ in range(times):
                digest.row(role, text)
    if digest is not None:
        ids.append(of)
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def _whole(parts: DataFrame) -> DataFrame:
    """The stretches joined until each conversation is one; with its cost and audit."""
    bits = 0
    while True:
        most = parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        bits = 63 if most <= JOINED else bits + 5
        # positions of JOINED stretches at most: each round's stretches are alone in their span
        span = F.lit(0).cast("bigint") if bits == 63 else F.shiftright("at", bits)
        before, parts = parts, settle(parts.groupBy("conv_id", span.alias("span")).applyInArrow(_joined, _PART), "joined")
        discard(before)
        if bits == 63:
            break
    ends = F.filter("edges", lambda e: (e["p"] == START) & e["q"].isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    return parts.withColumn("best", best).withColumn("cost", F.col("best.cost")).withColumn("audit", F.col("best.audit")).drop("best", "edges")


def repair(rows: DataFrame, most_rows: int = 256, most_bytes: int = 1 << 22) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: of rows (conv_id, turn, role, text, times), for each conversation."""
    ordered = in_order(rows)
    columns = ("conv_id", "turn", "role", "text", "times", "fault", "pos")
    parts = settle(ordered.select(*columns).mapInArrow(_walked(most_rows, most_bytes), _PART), "stretches")
    done = parts.filter("done").drop("edges")
    rest = settle(_whole(settle(parts.filter("NOT done"), "open")), "whole")
    # the digests of conversations that were cut
    heads = rest.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("bigint").alias("times"))
    cut = rest.select(F.col("conv_id").alias("cut_id"))
    texts = ordered.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi").select("conv_id", "pos", "role", "text", "times")
    fed = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    digests = fed.mapInArrow(_streamed, "conv_id long, repaired_sha256 string").select(F.col("conv_id").alias("cut_id"), F.col("repaired_sha256").alias("digest"))
    rest = rest.join(digests, F.col("conv_id").eqNullSafe(F.col("cut_id"))).withColumn("repaired_sha256", F.col("digest")).drop("digest", "cut_id")
    both = done.unionByName(rest.select(*done.columns))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return both.select("conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The damaged rows' repair, a row for each conv_id of the given ones: zeros where damage left no row."""
    bound_batches(rows.sparkSession)
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "__found")
    given = rows.select("conv_id").distinct()
    out = given.join(found, F.col("conv_id").eqNullSafe(F.col("__found")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
