"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended to runs.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(least, times * q) that no neighbouring word extends keeping the period.

A run that long has, at each of its words, a window of `least * (times - 1) / times` words that
comes again one period on or back. So the words under windows that come again in their document
are found first, by sorted window hashes of whole batches; stretches of such words hold every run
whole. A document without one has no run.

In each stretch the maximal Lyndon word at every place is found under the order of the words'
numbers and under the inverse order, by the first phase of Baier's suffix sorter: suffixes are
grouped by their first word, groups are taken from the greatest down, and each group's context is
appended to that of the suffixes that stand right before it, which move to new, greater groups. A
group's context, when its turn comes, is the longest Lyndon word at each of its suffixes. Every
run has a Lyndon root under one of the two orders. Roots are extended to both sides by longest
common extensions, read from the names of all windows of 1, 2, 4, ... words (exact, no hashes of
windows), and each run is kept once.

Words are compared by 64-bit hash; the windows that pick the stretches likewise.

Defined results: a null or wordless text has no words and no run; a run may cover a whole text;
repeated rows and ids are rows of their own; very long texts are whole (a stretch of n words takes
about 8 * n * log2(n) bytes); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm.store import bound_batches
from braidmark.llm.words import U, hash_words, mix, pieces, rolling


def lyndon_array(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place (phase one of Baier's suffix sorter).

    A group is a list of suffixes in text order; groups stand in a chain from least to greatest.
    A suffix that moves on stays in its old list, but names its new group.
    """
    n = len(ranks)
    out, before, group = [0] * n, [-1] * n, [0] * n
    by_rank: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        by_rank.setdefault(r, []).append(i)
    members, length, lower, upper = [], [], [], []
    for g, r in enumerate(sorted(by_rank)):
        members.append(by_rank[r])
        length.append(1)
        lower.append(g - 1)
        upper.append(g + 1)
        for i in by_rank[r]:
            group[i] = g
    top = len(members) - 1
    if members:
        upper[top] = -1
    while top >= 0:
        size, parents = length[top], {}
        last = times = -1
        for i in members[top]:
            if group[i] != top:
                continue
            out[i] = size
            j = i - 1
            while j >= 0 and out[j]:  # done, or of this group
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
                continue
            if last >= 0:
                parents.setdefault((group[last], times), []).append(last)
            last, times = j, 1
        if last >= 0:
            parents.setdefault((group[last], times), []).append(last)
        nxt = lower[top]
        if nxt >= 0:
            upper[nxt] = -1
        for old, count in sorted(parents, reverse=True):  # falling counts: each new group stands right above the old one
            new, above = len(members), upper[old]
            moved = parents[old, count]
            members.append(moved)
            length.append(length[old] + count * size)
            for i in moved:
                group[i] = new
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
            else:
                nxt = new
        top = nxt
    return out


class Extensions:
    """Longest common extensions of pairs of places, from the names of all windows of 2^k words."""

    def __init__(self, x: np.ndarray):
        self.n, self.names = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int64)]
        k = 1
        while 2 * k <= self.n:
            last = self.names[-1]
            self.names.append(np.unique(last[: self.n - 2 * k + 1] * self.n + last[k : self.n - k + 1], return_inverse=True)[1])
            k *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on; i < j."""
        return self._along(i, j, 1)

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree up to i and up to j, not counting those at i and j."""
        return self._along(i, j, -1)

    def _along(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size, names = 1 << level, self.names[level]
            shift = total if way > 0 else -total - size
            at = np.flatnonzero((j + shift < len(names)) & (i + shift >= 0))
            same = names[(i + shift)[at]] == names[(j + shift)[at]]
            total[at[same]] += size
        return total


def runs_of(x: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of words (any integers), by start, then period."""
    if len(x) < least:
        return np.empty((0, 3), np.int64)
    same = Extensions(x)
    ranks = same.names[0]
    found = []
    for order in (ranks, -ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        i = np.flatnonzero(np.arange(len(x)) + period < len(x))
        i = i[ranks[i] == ranks[i + period[i]]]
        p = period[i]
        back = same.left(i, i + p)
        whole = p + same.right(i, i + p) + back
        keep = whole >= np.maximum(least, times * p)
        found.append(np.stack([(i - back)[keep], whole[keep], p[keep]], 1))
    return np.unique(np.concatenate(found), axis=0) if sum(map(len, found)) else np.empty((0, 3), np.int64)


def stretches(hashes: np.ndarray, before: np.ndarray, window: int) -> np.ndarray:
    """Whether each word is under a window that comes again in its document; before: words before each document (len + 1)."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) < window:
        return covered
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    starts = np.flatnonzero(doc[: len(hashes) - window + 1] == doc[window - 1 :])
    keys = mix(rolling(hashes, window)[starts] + U(0x9E3779B97F4A7C15) * doc[starts].astype(U))
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(starts), bool)
    hit[order[1:][again]] = True
    hit[order[:-1][again]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts[hit], 1)
    np.add.at(edges, starts[hit] + window, -1)
    return np.cumsum(edges[:-1]) > 0


def runs_in(hashes: np.ndarray, covered: np.ndarray, least: int, times: int) -> np.ndarray:
    """The runs of one document, from its stretches."""
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    found = []
    for s, e in edge.reshape(-1, 2).tolist():
        runs = runs_of(hashes[s:e], least, times)
        runs[:, 0] += s
        found.append(runs)
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether a run contains each word after the run's first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for s, length, p in runs.tolist():
        if best is None or length * best[2] > best[1] * p:
            best = s, length, p
    return best


def planted_repeats(doc_id, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a damaged document; None where it stays as it is (a null id too).

    h = crc32 of the decimal id, g = h // 10: where h % 10 = 0, the words from g % n on repeat the
    first 1 + (n - a) // (3 + g % 8) of them.
    """
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3, order: Callable | None = None, keep: bool = False) -> DataFrame:
    """SCHEMA, a row for each row of docs: number of runs, the strongest, digests of all runs and of the text without repetitions.

    order: (doc_id, n words) -> which word stands at each place, or None; planted_repeats
    damages documents. keep: also the runs themselves (runs: start, length, period) and the
    collapsed text.
    """
    bound_batches(docs.sparkSession)
    window = least - least // times if times > 1 else 1

    def rows(batch: pa.RecordBatch) -> list[tuple]:
        ids = batch.column(batch.schema.get_field_index("__id")).to_pylist()
        hashes, before, data, starts, ends = hash_words(batch.column(batch.schema.get_field_index("__text")))
        places: list[np.ndarray | None] = [None] * len(ids)
        if order is not None:
            places = [order(i, int(e - s)) for i, s, e in zip(ids, before[:-1], before[1:], strict=True)]
            for at, s in zip(places, before[:-1], strict=True):
                if at is not None:
                    hashes[s : s + len(at)] = hashes[s + at]
        covered = stretches(hashes, before, window)
        raw, out = data.tobytes(), []
        for i, at, s, e in zip(ids, places, before[:-1].tolist(), before[1:].tolist(), strict=True):
            runs = np.empty((0, 3), np.int64)
            if covered[s:e].any():
                runs = runs_in(hashes[s:e], covered[s:e], least, times)
            words = raw[starts[s] : ends[e - 1]].split() if e > s else []
            if at is not None:
                words = [words[k] for k in at.tolist()]
            if len(runs):
                gone = dropped(e - s, runs).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            collapsed = b" ".join(words)
            best = strongest(runs)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
            row = (i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
            out.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], collapsed.decode("utf-8", "replace")) if keep else row)
        return out

    names = [x.split()[0] for x in SCHEMA.split(", ")] + (["runs", "collapsed"] if keep else [])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + ([pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()] if keep else [])
    schema = SCHEMA + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if keep else "")

    def run(batches):
        for batch in pieces(batches, "__text"):
            found = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)
