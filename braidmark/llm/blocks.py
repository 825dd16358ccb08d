"""Links of classes that share a list with a large star (its hub), met in blocks of sets.

The classes outside a list's hub meet the hub's members and one another in blocks of sets of like
sizes. A block's intersections are counted exactly, as products of 0/1 matrices, and only the trees
of a union-find over its links leave the task: no row is made for a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm.store import discard, settle
from braidmark.llm.words import U, class_of, pieces, shingle_sets


class Forest:
    """Union-find over 64-bit nodes with path halving; a root is the least node of its tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[list[int], list[int]]:
        found = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return [x for x, _ in found], [r for _, r in found]


def _key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of class keys k (which are random) with two of its bits each: bits / 8 bytes, however many keys."""
    of = [F.col("k").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("k", 32).bitwiseAND(F.lit(bits - 1))]
    at = keys.select(F.explode(F.array(*of)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(U)


def _sets(size: int, keys):
    """k, set of the texts whose class may be among the keys (a filter)."""

    def run(batches):
        table = keys.value
        among = lambda bit: (table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1)
        last = U(64 * len(table) - 1)
        for batch in pieces(batches, "__text"):
            found = [(class_of(s), s) for s in shingle_sets(batch, "__text", size) if len(s)]
            k = np.array([x for x, _ in found], np.int64).view(U)
            keep = np.flatnonzero(among(k & last) & among((k >> U(32)) & last)).tolist() if len(k) else []
            yield pa.RecordBatch.from_arrays([pa.array([found[i][0] for i in keep], pa.int64()), pa.array([found[i][1].tobytes() for i in keep], pa.binary())], names=["k", "set"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of both sides: products of 0/1 matrices over the elements that both sides have."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, x = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(both, x)
        here = at < len(both)
        here[here] = both[at[here]] == x[here]
        order = np.argsort(at[here], kind="stable")
        return at[here][order], row[here][order]

    (i, of_i), (j, of_j) = placed(left), placed(right)
    for start in range(0, len(both), at_once):
        parts = []
        for at, row, n in ((i, of_i, len(left)), (j, of_j, len(right))):
            a, b = np.searchsorted(at, (start, start + at_once))
            part = np.zeros((n, min(at_once, len(both) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out  # whole numbers below 2^24


def _met(percent: int):
    """The trees of the links between two blocks of sets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        forest = Forest()
        if left.num_rows and right.num_rows:
            keys = [t.column("k").to_pylist() for t in (left, right)]
            sets = [[np.frombuffer(x, U) for x in t.column("set").to_pylist()] for t in (left, right)]
            sizes = [np.array([len(s) for s in x], np.int64) for x in sets]
            both = common_counts(*sets).astype(np.int64)
            for i, j in np.argwhere(100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)).tolist():
                if keys[0][i] != keys[1][j]:
                    forest.join(keys[0][i], keys[1][j])
        a, b = forest.edges()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def in_blocks(percent: int, size: int, most_rows: int = 512, most_elements: int = 1 << 20, filter_bits: int = 1 << 26):
    """For linked_classes: links (as trees) of the classes outside each hub with those of the hub and with one another.

    Their sets come from one more pass over the texts, which a Bloom filter of fixed size lets
    through: no text is shuffled; what it lets through by mistake meets nothing.
    """

    def rest(work, named: DataFrame, lists: DataFrame) -> DataFrame:
        outside = settle(lists.filter("c != major").select("k", F.col("major").alias("hub"), "n").distinct(), "outside")
        if outside.isEmpty():
            return outside.select(F.col("k").alias("a"), F.col("k").alias("b"))
        hubs = outside.select("hub").distinct()
        inside = named.select("k", F.col("c").alias("hub"), "n").join(hubs, "hub", "left_semi").select("k", "hub", "n")
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 - 1e-9)))  # sets of a link are in neighbouring bands
        left = outside.select("k", "hub", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
        right = settle(inside.unionByName(outside).select("k", "hub", band.alias("band"), "n"), "met")
        rows = F.greatest(F.lit(1), F.least(F.lit(most_rows), F.floor(most_elements / F.max("n")).cast("int")))
        blocks = right.groupBy("hub", "band").agg(rows.alias("rows"), F.count(F.lit(1)).alias("n_right")).join(left.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("n_left")), ["hub", "band"])
        blocks = settle(blocks.select("hub", "band", F.ceil(F.col("n_left") / F.col("rows")).cast("int").alias("lefts"), F.ceil(F.col("n_right") / F.col("rows")).cast("int").alias("rights")), "blocks")
        asked = right.join(blocks, ["hub", "band"], "left_semi").select("k").unionByName(outside.select("k")).distinct()
        keys = work.docs.sparkSession.sparkContext.broadcast(_key_filter(asked, filter_bits))
        sets = settle(work.docs.select("__text").mapInArrow(_sets(size, keys), "k long, set binary").dropDuplicates(["k"]), "sets")
        deal = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = left.join(blocks, ["hub", "band"]).select("k", "hub", "band", deal("lefts").alias("i"), upto("rights").alias("j"))
        two = right.join(blocks, ["hub", "band"]).select("k", "hub", "band", upto("lefts").alias("i"), deal("rights").alias("j"))
        key = ("hub", "band", "i", "j")
        with_sets = lambda df: df.join(sets, "k").select(*[F.col(c).alias(c) for c in (*key, "k", "set")]).groupBy(*key)  # noqa: E731  (columns of its own on either side)
        out = settle(with_sets(one).cogroup(with_sets(two)).applyInArrow(_met(percent), "a long, b long"), "trees")
        discard(outside, right, blocks, sets)
        return out

    return rest
