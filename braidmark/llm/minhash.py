"""MinHash near-duplicates: SuperMinHash signatures, bands, verified links, groups by union-find.

A document's set is its distinct shingles of `size` words (A-Z lower-cased, 64-bit hashes); a
document of fewer words has its whole sequence as one. Equal sets are one class.

SuperMinHash: each element deals the ranks 0, 1, 2, ... to the components of the signature by a
permutation of its own, and a component's value is the least rank + random fraction that any
element gives it. As one element's ranks are all different, the components are negatively
correlated and the estimate has a lower variance than independent minima. All sets of a batch are
dealt together, a rank at a time: a set is done as soon as every component has a value, since
later ranks can only be greater (the early stop). Large sets end after one rank; n elements and m
components take about max(n, m log m) steps in all.

Rows of a signature make bands; two classes with an equal band are candidates. Two sets at the
threshold share none of 40 bands of 5 values with a chance of 1.3e-7. Bands that one class alone
has are dropped. Candidates are confirmed on their full sets. A class is first checked against one
member of each of its bands, which makes stars, and then only pairs outside a band's largest star
are met, so a large group of copies doesn't pair all its members: the classes outside a band's
largest star (its hub) meet the hub's members in blocks of sets of like sizes. A block's
intersections are counted exactly, as products of 0/1 matrices, and only the trees of a union-find
over its links leave the task. All links are contracted by a union-find inside each task, then, where they are
many, by alternating stars between tasks.

Defined results: a null or wordless text has an empty set and links with nothing; repeated rows
keep their rows and share their component; rows that repeat a doc_id with other texts, or have
none, each get their own text's component (see ngram_join); very long texts are whole; kept is
true where doc_id and component_id are the same, so for all rows of the representative, and for
rows with neither; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm.blocks import Forest, common_counts, in_blocks  # noqa: F401
from braidmark.llm.components import components
from braidmark.llm.ngram_join import judged_by, linked_classes, text_hash
from braidmark.llm.store import discard, settle
from braidmark.llm.words import U, class_of, mix, pieces, shingle_sets

_UNSET = U(2**64 - 1)
_FRACTION = 48  # bits of a value's random fraction; the rank stands above it
_AT_ONCE = 1 << 15


def _draws(elements: np.ndarray, rank: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place its permutation swaps with `rank`, and the fraction of that rank."""
    h = mix(elements + U((rank * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64))
    place = rank + (((h >> U(32)) * U(m - rank)) >> U(32)).astype(np.int64)
    return place, mix(h + U(1)) >> U(64 - _FRACTION)


def signatures(elements: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of m values for each set; sets follow one another in elements. Empty sets have no values."""
    out = np.full((len(counts), m), _UNSET, U)
    of = np.repeat(np.arange(len(counts)), counts)
    place, fraction = _draws(elements, 0, m)
    np.minimum.at(out.reshape(-1), of * m + place, fraction)
    todo = np.flatnonzero((counts > 0) & (out == _UNSET).any(1))
    todo = todo[np.argsort(counts[todo], kind="stable")]  # sets of a size end at about the same rank
    starts, sums, at = np.cumsum(counts) - counts, np.cumsum(counts[todo]), 0
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _AT_ONCE, "right")))
        some, at = todo[at:end], end
        out[some] = _later_ranks(np.concatenate([elements[starts[i] : starts[i] + counts[i]] for i in some]), counts[some], out[some], m)
    return out


def _later_ranks(elements: np.ndarray, counts: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """The signatures of a few sets whose rank 0 is dealt."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
    flat, each = values.reshape(-1), np.arange(len(elements))
    for rank in range(m):
        place, fraction = _draws(elements, rank, m)
        component = order[each, place]
        order[each, place] = order[each, rank]
        if rank:
            np.minimum.at(flat, of * m + component, (U(rank) << U(_FRACTION)) + fraction)
        unset = (values == _UNSET).any(1)
        if not unset.any():
            break
        going = unset[of]
        if 2 * np.count_nonzero(going) < len(of):
            elements, of, order = elements[going], of[going], order[going]
            each = np.arange(len(elements))
    return values


def bands_of(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature; the band's number is part of it."""
    out = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (len(values), 1))
    cut = values[:, : bands * rows].reshape(len(values), bands, rows)
    for i in range(rows):
        out = mix(out + cut[:, :, i])
    return out


def _sign(text: str, doc_id: str, text_hash_at: str, size: int, bands: int, rows: int):
    def run(batches):
        for batch in pieces(batches, text):
            sets = list(shingle_sets(batch, text, size))
            counts = np.array([len(s) for s in sets], np.int64)
            lists = bands_of(signatures(np.concatenate(sets), counts, bands * rows), bands, rows).view(np.int64)
            keys = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            ids, hashes = (batch.column(batch.schema.get_field_index(c)) for c in (doc_id, text_hash_at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lists.size + 1, bands, dtype=np.int32)), pa.array(lists.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, hashes, keys, pa.array(counts.astype(np.int32)), lists], names=["doc_id", "h", "k", "n", "t"])

    return run


def _contracted(most_nodes: int = 500_000, roots: bool = False):
    """Edges to the stars of each task's trees; a task's forest is handed on when it has most_nodes nodes. roots: also a row of each root with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars():
            a, b = forest.edges()
            own = [x for x, y in forest.up.items() if x == y] if roots else []
            return pa.RecordBatch.from_arrays([pa.array(a + own, pa.int64()), pa.array(b + own, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b")), strict=True):
                forest.join(a, b)
            if len(forest.up) >= most_nodes:
                yield stars()
                forest = Forest()
        yield stars()

    return run


def union_find(edges: DataFrame, most_rounds: int | None = None, most_edges: int = 200_000) -> DataFrame:
    """node, component of an edge table (a, b long): forests in tasks of about most_edges edges, then stars between tasks (see components).

    Forests of at most most_edges edges in all are joined by one more task, which leaves nothing for the stars to do.
    """
    made = _contracted(max(500_000, 2 * most_edges + 1))
    forest = settle(edges.select("a", "b").mapInArrow(made, "a long, b long"), "forest")
    n = forest.count()
    if n <= most_edges:
        out = settle(forest.coalesce(1).mapInArrow(_contracted(2 * most_edges + 1, roots=True), "a long, b long"), "components")
        discard(forest)
        return out.selectExpr("a AS node", "b AS component")
    return components(forest.coalesce(-(-n // most_edges)).mapInArrow(made, "a long, b long"), most_rounds)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    percent: links are confirmed at 100 * intersection >= percent * union. bands, rows: of the
    signature, which has bands * rows values; for lower thresholds take more bands.
    """
    docs = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), text_hash(F.col(text)).alias("__h"))
    signed = settle(docs.mapInArrow(_sign("__text", "__id", "__h", size, bands, rows), "doc_id long, h long, k long, n int, t array<long>"), "signed")
    named = signed.filter("k IS NOT NULL")
    address = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))  # null ids last
    least = settle(named.groupBy("k").agg(address.alias("r")).selectExpr("k", "r.doc_id AS first_id", "r.h AS first_h"), "classes")

    # bands that two different sets have: most have none
    dealt = named.select("k", F.explode("t").alias("t"))
    shared = settle(dealt.groupBy("t").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low != high").select("t"), "bands")
    listed = dealt.join(shared, "t").groupBy("k").agg(F.sort_array(F.collect_set("t")).alias("t"))  # at most `bands` values
    sizes = named.groupBy("k").agg(F.first("n").alias("n"))
    heads = listed.join(sizes, "k").join(least, "k").withColumn("pos", F.transform("t", lambda _: F.lit(0)))
    heads = settle(heads, "heads")
    discard(shared)
    out = judged_by(signed, least, linked_classes(docs, heads, least.count(), size, percent, group=union_find, rest=in_blocks(percent, size)))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
