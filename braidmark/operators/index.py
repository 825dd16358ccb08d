"""A block-max index: postings in written blocks, with bounds that let a search skip most of a block.

A block holds some thousand documents as arrays, those next to one another that have their least
terms (by two hashes) in common, so copies and texts of one language mostly: its terms (64-bit hashes), the
documents of each and how often they have it. Every SUB documents of a block are a sub-block; for
each term and sub-block the greatest count and the least length are kept, whose contribution no
document of the sub-block can exceed. Blocks are made where the documents are read: no posting is
shuffled.

A search sends a group of queries, of bounded size, to all tasks. A task keeps the k best of each
query over its blocks; a sub-block whose bounds add up to less than the k-th score so far is
skipped. k rows for each query leave a task. Scores are raw sums, added in the order in which a
query gives its terms, so equal documents have equal scores.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.session import written

SUB = 8
_SALTS = (0x5BD1E995A1B2C3, 0x2BD1E295A1B2C7F1)
_BLOCK = {"ids": "long", "lens": "double", "terms": "long", "starts": "int", "places": "int", "tfs": "int", "sub_starts": "int", "subs": "int", "most_tf": "int", "least_len": "double"}
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_SCHEMA = ", ".join(f"{c} array<{t}>" for c, t in _BLOCK.items())


@dataclasses.dataclass(frozen=True)
class BM25:
    """tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len))."""

    avg_len: float
    k1: float = 1.5
    b: float = 0.75

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avg_len))


@dataclasses.dataclass(frozen=True)
class Share:
    """tf / len: with lengths of vectors, their unit weights."""

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf / length


@dataclasses.dataclass(frozen=True)
class Once:
    """1 for each term that a document has."""

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.ones(len(tf))


def packed_block(ids: np.ndarray, lens: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """A block of documents whose terms (with repetitions) follow one another, counts[i] of document i."""
    least = np.zeros((2, len(ids)), np.int64)
    some = counts > 0
    if some.any():
        begins = (np.cumsum(counts) - counts)[some]
        for i, salt in enumerate(_SALTS):
            least[i, some] = np.minimum.reduceat(terms ^ np.int64(salt), begins)
    near = np.lexsort((ids, lens, least[1], least[0]))
    place = np.empty(len(ids), np.int64)
    place[near] = np.arange(len(ids))
    of = np.repeat(place, counts)
    order = np.lexsort((of, terms))
    t, d = terms[order], of[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.empty(0, np.int64)
    tf, t, d = np.diff(np.append(new, len(order))), t[new], d[new]
    lens = lens[near]
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
    sub = d // SUB
    cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (sub[1:] != sub[:-1]))) if len(t) else np.empty(0, np.int64)
    return {
        "ids": ids[near],
        "lens": lens,
        "terms": t[starts],
        "starts": np.append(starts, len(t)),
        "places": d,
        "tfs": tf,
        "sub_starts": np.append(np.searchsorted(cuts, starts), len(cuts)),
        "subs": sub[cuts],
        "most_tf": np.maximum.reduceat(tf, cuts) if len(cuts) else tf,
        "least_len": np.minimum.reduceat(lens[d], cuts) if len(cuts) else lens[d],
    }


def _row(block: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.ListArray.from_arrays(pa.array([0, len(block[c])], pa.int32()), pa.array(block[c], _TYPES[t])) for c, t in _BLOCK.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_BLOCK))


def _packed(block_docs: int, block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, terms = [], 0, 0

        def block() -> pa.RecordBatch:
            return _row(packed_block(*(np.concatenate([h[i] for h in held]) for i in range(4))))

        for batch in batches:
            ids, lens = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy()
            ends, i = np.cumsum(counts), 0
            while i < len(ids):
                before = ends[i - 1] if i else 0
                j = min(i + block_docs - docs, int(np.searchsorted(ends, before + block_terms - terms, "left")) + 1, len(ids))
                j = max(j, i + 1)
                held.append((ids[i:j], lens[i:j], flat[before : ends[j - 1]], counts[i:j]))
                docs, terms, i = docs + j - i, terms + int(ends[j - 1] - before), j
                if docs >= block_docs or terms >= block_terms:
                    yield block()
                    held, docs, terms = [], 0, 0
        if held:
            yield block()

    return run


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Best:
    """The k best documents of a query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        """What a document must reach; 0 while there are fewer than k."""
        return self.scores[-1] if len(self.scores) == self.k else 0.0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= kth], ids[scores >= kth]
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Queries:
    """A group of queries as arrays: ids, and the terms and weights of each, one after another."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        self.ids = table.column("id").to_numpy()
        sizes = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.terms, self.weights = (flat("terms"), flat("weights")) if len(self.ids) else (np.empty(0, np.int64), np.empty(0))


def search_block(block: dict[str, np.ndarray], asked: Queries, best: list[Best], value, first: int = 4, slack: float = 1e-9, digits: int | None = None) -> tuple[int, int]:
    """Adds a block's documents to the k best of each query; (sub-blocks with a term of a query, those of them skipped).

    slack: bounds are added in another order than scores, so they may be less by a rounding.
    """
    if not len(block["terms"]):
        return 0, 0
    at = np.minimum(np.searchsorted(block["terms"], asked.terms), len(block["terms"]) - 1)
    has = block["terms"][at] == asked.terms
    n, n_subs, met, skipped = len(block["ids"]), -(-len(block["ids"]) // SUB), 0, 0
    for q, (s, e) in enumerate(zip(asked.starts.tolist(), asked.ends.tolist(), strict=True)):
        own = has[s:e]
        if not own.any():
            continue
        terms, weights = at[s:e][own], asked.weights[s:e][own]
        a, b = block["sub_starts"][terms], block["sub_starts"][terms + 1]
        entries = _ranges(a, b)
        bound = np.bincount(block["subs"][entries], np.repeat(weights, b - a) * value(block["most_tf"][entries], block["least_len"][entries]), n_subs)
        present = int(np.count_nonzero(bound))
        met += present
        bound = bound * (1 + slack) + (0 if digits is None else 10.0**-digits) * (bound > 0)
        left = bound > 0
        # the most promising first: they raise what the others must reach
        if present > first:
            turns = [bound >= np.partition(bound, n_subs - first)[n_subs - first], None]
        else:
            turns = [left]
        for turn in turns:
            live = left & (bound >= best[q].least)
            live = live if turn is None else live & turn
            left = left & ~live
            if not live.any():
                continue
            a, b = block["starts"][terms], block["starts"][terms + 1]
            postings = _ranges(a, b)
            places = block["places"][postings]
            keep = live[places // SUB]
            places = places[keep]
            score = np.bincount(places, np.repeat(weights, b - a)[keep] * value(block["tfs"][postings][keep], block["lens"][places]), n)
            score = score if digits is None else np.round(score, digits)
            found = np.flatnonzero(score > 0)
            best[q].add(score[found], block["ids"][found])
        skipped += int(np.count_nonzero(left))
    return met, skipped


_OUT = "query_id long, doc_id long, score double, met long, skipped long"
_FOUND = ["query_id", "doc_id", "score", "met", "skipped"]


def _searched(asked, k: int, value, digits: int | None):
    """The k best of a task for each query; its last row counts sub-blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, met, skipped = asked.value, 0, 0
        best = [Best(k) for _ in queries.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(j)[i].values.to_numpy() for j, c in enumerate(_BLOCK)}
                m, s = search_block(block, queries, best, value, digits=digits)
                met, skipped = met + m, skipped + s
        for i in range(0, len(best), 4096):  # rows leave as arrays, a few thousand queries at a time
            some = best[i : i + 4096]
            ids = np.repeat(queries.ids[i : i + 4096], [len(b.ids) for b in some])
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([b.ids for b in some])), pa.array(np.concatenate([b.scores for b in some])), none, none], names=_FOUND)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([met]), pa.array([skipped])], names=_FOUND)

    return run


class Index:
    """docs: id long, len double, terms array<long> (with repetitions)."""

    def __init__(self, docs: DataFrame, block_docs: int = 2048, block_terms: int = 1 << 20):
        cores = docs.sparkSession.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:  # a small table in few files: its texts are dealt to all cores
            docs = docs.repartition(cores, "id")
        packed = docs.select("id", F.col("len").cast("double"), "terms").mapInArrow(_packed(block_docs, block_terms), _SCHEMA)
        # a row group holds one block, so that a task holds one at a time however many it writes or reads
        self.blocks = written(packed, "index", {"parquet.block.row.count.limit": 1})

    def totals(self) -> tuple[int, float]:
        """Number of documents, and the sum of their lengths."""
        length = F.aggregate("lens", F.lit(0.0), lambda a, x: a + x)
        row = self.blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(length), F.lit(0.0)).alias("total")).first()
        return row.n, row.total

    def df(self) -> DataFrame:
        """term (hash), df: a row of a block has a term's own number of documents, so few rows are shuffled."""
        sizes = F.zip_with(F.slice("starts", 2, F.size("terms")), F.slice("starts", 1, F.size("terms")), lambda b, a: b - a)
        own = self.blocks.filter("size(terms) > 0").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("df"))))
        return own.groupBy("term").agg(F.sum("df").alias("df"))

    def search(self, asked: DataFrame, k: int, value, group_terms: int = 1 << 20, group_hits: int = 1 << 22, digits: int | None = None) -> DataFrame:
        """query_id, doc_id, score, met, skipped: the k best documents of each query and task, and a row for each task that counts sub-blocks.

        asked: id long, terms array<long>, weights array<double> (over 0), a row for each query.
        Queries go to the tasks in groups of about group_terms terms and group_hits rows of a task's
        answer. digits: scores are rounded before they are compared.
        """
        asked = written(asked.select("id", "terms", "weights"), "asked")
        n, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        groups, out = max(1, -(-total // group_terms), -(-n * k // group_hits)), None
        for g in range(groups):
            some = asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()  # bounded
            sent = asked.sparkSession.sparkContext.broadcast(Queries(some))
            one = self.blocks.mapInArrow(_searched(sent, k, value, digits), _OUT)
            out = one if out is None else out.unionByName(one)
        return out


def hits_of(found: DataFrame) -> DataFrame:
    return found.filter("query_id IS NOT NULL").select("query_id", "doc_id", "score")


def skipped_share(found: DataFrame) -> float:
    """The share of sub-blocks with a term of a query that were skipped, over all tasks and queries of a search."""
    row = found.filter("query_id IS NULL").agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped")).first()
    return row.skipped / row.met if row.met else 0.0
