"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers. Rows are dealt by hash into blocks; in a block, each
attribute is kept as slices: one bitmap over the block's rows for each binary digit of the
attribute's distance from its least value. A query adds the slices that its own digits call for
(those of a negative weight complemented) with carry-save adders on whole bitmaps, which gives
the slices of all rows' scores. The best rows are then selected from the most significant slice
downward; rows that still tie at the k-th place are resolved by the least id, and the scores of
the selected rows are computed anew as whole numbers.

The index is one table, a row for each block: its ids, its values and its slices, built once.
Queries are packed into groups of bounded size that are sent to the blocks (a group is much
smaller than a block); each block gives k rows per query, and the best k of all blocks remain. A
block's row is copied only while there are fewer blocks than `spread`, to keep more tasks busy.

Defined results: vectors that are null or hold a null or non-finite component take no part;
rows without a vec_id can't be named and take no part either; every other row is a row and, if
asked, a query of its own, also one that repeats an id or a vector too: a query meets all rows but
itself; vectors of different length don't meet, empty ones meet each other with a score of 0; ties
go to the smaller id; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.llm.store import settle

U = np.uint64


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, q array<long>, dim, row (a number of its own): the usable vectors. Write them before they are used twice, so that numbers stay."""
    x = F.col(embedding)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    usable = vectors.filter(ok & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), q.alias("q"))
    return usable.withColumns({"dim": F.size("q"), "row": F.monotonically_increasing_id()})


def _sliced(ids: np.ndarray, own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers and values in order of id, and the slices: bitmaps by digit and attribute."""
    order = np.lexsort((own, ids))
    ids, own, values = ids[order], own[order], values[order]
    n, dims = values.shape
    above = values - values.min(0)
    digits = max(1, int(above.max(initial=0)).bit_length())
    bits = np.zeros((digits, dims, -(-n // 64) * 64), np.uint8)
    for j in range(digits):
        bits[j, :, :n] = ((above >> j) & 1).T
    return ids, own, values, np.packbits(bits, axis=2, bitorder="little").view(U)


class SlicedBlock:
    def __init__(self, ids: np.ndarray, own: np.ndarray, values: np.ndarray, plain: np.ndarray):
        self.ids, self.own, self.values = ids, own, values
        self.digits, dims, words = plain.shape
        plain = plain.reshape(self.digits * dims, words)
        self.slices = np.concatenate([plain, ~plain])
        full = np.zeros(words * 64, np.uint8)
        full[: len(ids)] = 1
        self.full = np.packbits(full, bitorder="little").view(U)

    def _score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of all rows' scores (less a constant), least significant first."""
        size = np.abs(weights)
        dims, top = len(weights), int(size.max(initial=0)).bit_length()
        at = {}
        for b in range(top):
            d = np.flatnonzero((size >> b) & 1)
            if not len(d):
                continue
            for j in range(self.digits):
                at.setdefault(b + j, []).append(j * dims + d + (weights[d] < 0) * (self.digits * dims))
        out, carry, k = [], [], 0
        while k < top + self.digits or carry:
            own = [self.slices[np.concatenate(at[k])]] if k in at else []
            maps = np.concatenate(own + carry) if own or carry else np.zeros((1, len(self.full)), U)
            carry = []
            while len(maps) > 1:
                if len(maps) == 2:
                    carry.append(maps[:1] & maps[1:])
                    maps = maps[:1] ^ maps[1:]
                    break
                m = len(maps) // 3
                x, y, z = maps[:m], maps[m : 2 * m], maps[2 * m : 3 * m]
                odd = x ^ y
                carry.append((x & y) | (odd & z))
                maps = np.concatenate([odd ^ z, maps[3 * m :]])
            out.append(maps[0])
            k += 1
        return out

    def best(self, query_row: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own."""
        tied = self.full.copy()
        for own in np.flatnonzero(self.own == query_row).tolist():
            tied[own >> 6] &= ~(U(1) << U(own & 63))
        sure, n_sure = np.zeros_like(tied), 0
        if int(np.bitwise_count(tied).sum()) > k:
            for s in reversed(self._score_slices(weights)):
                high = tied & s
                n = int(np.bitwise_count(high).sum())
                if n_sure + n > k:
                    tied = high
                else:
                    sure, n_sure, tied = sure | high, n_sure + n, tied & ~s
                    if n_sure == k:
                        break
        else:
            sure, n_sure, tied = tied, k, np.zeros_like(tied)
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if n_sure < k:  # rows are in order of id
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - n_sure]])
        return self.ids[rows], self.values[rows] @ weights


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten()) for c in column.chunks]) if n else np.empty(0, np.int64)
    return flat.astype(np.int64).reshape(n, len(flat) // max(1, n))


_BEST = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _index(table: pa.Table) -> pa.Table:
    """A block's rows to its row in the index."""
    n = table.num_rows
    ids, own, values, slices = _sliced(np.asarray(table.column("vec_id")), np.asarray(table.column("row")), _matrix(table.column("q"), n))
    small = np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int64
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (ids, own, values.astype(small), slices)]
    return pa.table([table.column("dim").slice(0, 1), table.column("block").slice(0, 1), pa.array([n], pa.int32()), *packed], names=["dim", "block", "n", "ids", "own", "vals", "slices"])


_INDEX = "dim int, block long, n int, ids binary, own binary, vals binary, slices binary"


def _packed_queries(table: pa.Table) -> pa.Table:
    asked, nth = (np.asarray(table.column(c)).astype(np.int64) for c in ("vec_id", "row"))
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (asked, nth, _matrix(table.column("q"), table.num_rows))]
    return pa.table([table.column("dim").slice(0, 1), table.column("part").slice(0, 1), *packed], names=["dim", "part", "asked", "rows", "weights"])


def _meet(k: int):
    """Rows of a block with a group of queries to the queries' best rows of the block; rows come in order of block."""

    def run(batches):
        held, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r]  # noqa: B023, E731
                dim, n, key = get("dim").as_py(), get("n").as_py(), (get("dim").as_py(), get("block").as_py())
                if key != held:
                    raw = np.frombuffer(get("vals").as_buffer(), np.uint8)
                    values = raw.view(np.int16 if len(raw) == 2 * n * dim else np.int64).reshape(n, dim).astype(np.int64)
                    words = -(-n // 64)
                    plain = np.frombuffer(get("slices").as_buffer(), U).reshape(-1, dim, words) if dim else np.zeros((1, 0, words), U)
                    held, block = key, SlicedBlock(*(np.frombuffer(get(c).as_buffer(), np.int64) for c in ("ids", "own")), values, plain)
                asked, rows = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("asked", "rows"))
                weights = np.frombuffer(get("weights").as_buffer(), np.int64).reshape(len(asked), dim)
                best = [block.best(int(i), w, k) for i, w in zip(rows, weights, strict=True)]
                sizes = [len(ids) for ids, _ in best]
                cols = [np.repeat(asked, sizes), np.repeat(rows, sizes), *(np.concatenate(x) for x in zip(*best, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_BEST)

    return run


def top_k(quantised: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 16384, group_queries: int = 512, spread: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of quantised other than itself; queries are rows of quantised."""
    n_blocks = max(1, -(-quantised.count() // block_rows))
    n_groups = max(1, -(-queries.count() // group_queries))
    copies = min(n_groups, -(-spread // n_blocks))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))  # noqa: E731  (by row: an id may have many)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    rows = quantised.select("vec_id", "row", "q", "dim", deal(n_blocks).alias("block"))
    index = settle(rows.groupBy("dim", "block").applyInArrow(_index, _INDEX), "sliced")
    asked = queries.select("vec_id", "row", "q", "dim", deal(n_groups).alias("part"))
    groups = settle(asked.groupBy("dim", "part").applyInArrow(_packed_queries, "dim int, part long, asked binary, rows binary, weights binary"), "asked")
    sent = groups.select("*", F.explode(upto(n_blocks)).alias("block"), F.pmod("part", F.lit(copies)).alias("copy"))
    copied = index.withColumn("copy", F.explode(upto(copies)))
    met = sent.hint("merge").join(copied, ["dim", "block", "copy"])  # sorted by block, so a block is unpacked once a task
    best = met.select("dim", "block", "n", "ids", "own", "vals", "slices", "asked", "rows", "weights").mapInArrow(_meet(k), "query_id long, row long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
