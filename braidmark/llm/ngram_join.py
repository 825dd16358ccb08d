"""N-gram Jaccard join: components of documents whose word-shingle sets are similar.

A document's set is its distinct 5-word shingles (64-bit hashes of the words, A-Z lower-cased);
a document of fewer words has its whole sequence as one. Two sets link when
100 * intersection >= percent * union. Equal sets are one class from the start.

Every set is put into one order: shingles of no other row first, then those of a few rows, then
the crowded ones (of more than `crowded` rows: a passage or a base that many documents share), by
hash within each kind. The kinds are two Bloom filters of fixed size over fingerprints of 40 bits
or, for larger inputs, more; the fingerprints are counted in spans of many documents, uniqued per
span before they are shuffled. Any order that all sets share is exact, so what the filters mistake loses no pair, and
nothing is capped.

The index lists, for each shingle, the classes that have it in their prefix: the shingles in this
order that a similar set can't miss all of. A set with enough shingles of its own is in no list
at all. Set relations then skip work twice.

1. Answers from a similar set: each class is checked against one member of each of some of its
   lists, in two turns, and in more while they find many links; linked classes make a star.
   Every other turn the member with the least before the shingle is taken, so that the base of a
   group of near copies is met. A star's members share all answers inside it, so a list of one
   star is dropped, and in other lists only pairs outside the list's largest star are read. A
   large group of near copies costs a few checks for each member.
2. Blocks skipped by position: what is left of a list is cut into blocks by set size (powers of
   the inverse threshold, so only neighbouring blocks can link), and a pair is read only if the
   shingles after its places in both sets still suffice. A list of more than `paired` classes
   gives no pairs: its classes outside its largest star meet that star's, and one another, in
   blocks of sets (see blocks).

Candidates pass a count sketch (shared shingles per hash bucket: the sum of the lesser counts
bounds the intersection from above), then the sets themselves are intersected. Links become components
by stars of stars.

Defined results: a null or wordless text has an empty set and links with nothing; repeated rows
keep their rows and share their component; rows that repeat a doc_id with other texts, or have
none, each get their own text's component, named by its least doc_id if any row of it has one,
else by the row's own; texts are told apart by 64-bit hash; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmark.llm.blocks import in_blocks
from braidmark.llm.components import components
from braidmark.llm.store import discard, settle
from braidmark.llm.words import U, class_of, mix, pieces, shingle_sets

PER_BUCKET = 1
SPAN = 1_000_000  # shingles counted together before they are shuffled


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch_of(s: np.ndarray) -> bytes:
    """Shingles per bucket of the hash's high bits; PER_BUCKET on average at most, never over 255."""
    bits = max(5, int(len(s) // PER_BUCKET).bit_length())
    while True:
        counts = np.bincount((mix(s) >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def overlap_bound(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(1)
    return int(np.minimum(a, b).sum())


def print_bytes(total: int) -> int:
    """Bytes of a shingle's hash in lists and filters: so many that few of all shingles share one by chance. The sets themselves are compared whole."""
    return min(8, max(5, -(-(total.bit_length() + 8) // 8)))


def _prints(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> U(64 - 8 * width)


def _packed(t: np.ndarray, width: int) -> bytes:
    return t.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view(">u8").ravel().astype(U)


def _bucket_of(t: np.ndarray, buckets: int, width: int) -> np.ndarray:
    return (((t >> U(8 * width - 32)) * U(buckets)) >> U(32)).astype(np.int64)


_SIGNED = "doc_id long, h long, k long, n int"


def _sign(text: str, doc_id: str, text_hash: str, size: int):
    def run(batches):
        for batch in pieces(batches, text):
            keys, sizes = [], []
            for s in shingle_sets(batch, text, size):
                keys.append(class_of(s) if len(s) else None)
                sizes.append(len(s))
            ids, hashes = (batch.column(batch.schema.get_field_index(c)) for c in (doc_id, text_hash))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "h", "k", "n"])

    return run


def _dealt(text: str, size: int, buckets: int, crowded: int, width: int):
    """Distinct fingerprints of a span of texts by hash range: met once, a few times, or more than `crowded` times.

    A span gives a row for each range that it has fingerprints in: never more rows than fingerprints.
    """

    def dealt(sets):
        t, count = np.unique(np.concatenate(sets), return_counts=True)
        of = _bucket_of(t, buckets, width)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        rows = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
            x, c = t[s:e], count[s:e]
            rows.append((_packed(x[c == 1], width), _packed(x[(c > 1) & (c <= crowded)], width), _packed(x[c > crowded], width)))
        return pa.RecordBatch.from_arrays([pa.array(of[starts]), *(pa.array(v, pa.binary()) for v in zip(*rows, strict=True))], names=["bucket", "once", "few", "many"])

    def run(batches):
        sets, held = [], 0
        for batch in pieces(batches, text):
            for s in shingle_sets(batch, text, size):
                sets.append(_prints(s, width))
                held += len(s)
                if held >= SPAN:
                    yield dealt(sets)
                    sets, held = [], 0
        if held:
            yield dealt(sets)

    return run


def _places(t: np.ndarray, bits: int) -> np.ndarray:
    """Four bits inside the fingerprint's part of the filter."""
    h = mix(t + U(7))
    return np.stack([mix(h + U(i)) & U(bits - 1) for i in range(4)])


def _filter_parts(bits: int, crowded: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        found = [_unpacked(b"".join(table.column(c).to_pylist()), width) for c in ("once", "few", "many")]
        weight = np.repeat([1, 2, crowded + 1], [len(x) for x in found])
        t, at = np.unique(np.concatenate(found), return_inverse=True)
        rows = np.bincount(at, weight, len(t))
        parts = []
        for least in (1, crowded):
            part = np.zeros(bits, bool)
            part[_places(t[rows > least], bits).ravel()] = True
            parts.append(pa.array([np.packbits(part).tobytes()], pa.binary()))
        return pa.table([table.column("bucket").slice(0, 1), *parts], names=["bucket", "shared", "hot"])

    return run


def _joined_parts(table: pa.Table) -> pa.Table:
    """The bits of all buckets that share a part."""
    both = [pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column(c).to_pylist()]).tobytes()], pa.binary()) for c in ("shared", "hot")]
    return pa.table([table.column("part").slice(0, 1), *both], names=["part", "shared", "hot"])


def _among(t: np.ndarray, table: np.ndarray, part: np.ndarray) -> np.ndarray:
    keep = np.ones(len(t), bool)
    for bit in _places(t, 8 * table.shape[1]).astype(np.int64):
        keep &= (table[part, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
    return keep


def _picked(text: str, size: int, percent: int, filters, buckets: int, width: int):
    """The shared fingerprints in each text's prefix, with their places, and a sketch of all its shared shingles; texts without one in the prefix are left out."""

    def run(batches):
        shared, hot = filters.value
        for batch in pieces(batches, text):
            keys, sizes, lists, places, sketches = [], [], [], [], []
            sets = list(shingle_sets(batch, text, size))
            t = _prints(np.concatenate(sets), width) if sets else np.empty(0, U)
            part = _bucket_of(t, buckets, width) % len(shared)
            kind = _among(t, shared, part).astype(np.int8)
            kind[kind == 1] += _among(t[kind == 1], hot, part[kind == 1])
            end = 0
            for s in sets:
                begin, end = end, end + len(s)
                prefix = prefix_length(len(s), percent)
                own = kind[begin:end]
                alone = int(np.count_nonzero(own == 0))
                if not len(s) or alone >= prefix:
                    continue
                order = np.argsort(own, kind="stable")[alone:prefix]
                keys.append(class_of(s))
                sizes.append(len(s))
                lists.append(t[begin:end][order].view(np.int64))
                places.append(np.arange(alone, prefix, dtype=np.int32))
                sketches.append(sketch_of(s[own > 0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], names=["k", "n", "t", "pos", "sketch"])

    return run


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True)
            keep = [overlap_bound(sa, sb) * (100 + percent) >= percent * (na + nb) for na, sa, nb, sb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(text: str, size: int, percent: int):
    """Pairs (a, b, ta, tb) whose texts' sets link; a row whose text is another class's gives nothing."""

    def run(batches):
        for batch in pieces(batches, "tb"):
            a, b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b"))
            each, first, which = np.unique(a, return_index=True, return_inverse=True)
            left = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("ta")).take(pa.array(first))], names=["ta"])
            sets = [s if len(s) and class_of(s) == k else None for s, k in zip(shingle_sets(left, "ta", size), each.tolist(), strict=True)]
            keep = np.zeros(len(a), bool)
            for i, y in enumerate(shingle_sets(batch, "tb", size)):
                x = sets[which[i]]
                if x is not None and len(y) and class_of(y) == b[i]:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class _Join:
    """The steps share the documents, the listed classes and the threshold."""

    def __init__(self, docs: DataFrame, heads: DataFrame, size: int, percent: int, most_sent: int = 1_000_000):
        self.docs, self.heads, self.size, self.percent, self.most_sent = docs, heads, size, percent, most_sent

    def texts(self, asked: DataFrame) -> DataFrame:
        """k, __text of classes (k, first_id, first_h)."""
        address = F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__h") == F.col("first_h"))
        return self.docs.join(asked, address).select("k", "__text").dropDuplicates(["k"])  # repeated rows have one address

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b: class keys) that link.

        Each class has the address (doc_id, which may be null, and text hash) of one text. Texts
        are picked by a join with the addresses of the pairs that the sketches leave: sent to all
        tasks while the pairs are few (at most most_sent), else shuffled by address.
        """
        near = pairs
        if "sketch" in self.heads.columns:
            of = lambda x: self.heads.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
            near = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_bounded(self.percent), "a long, b long")
        near = settle(near, "near")
        sent = F.broadcast if near.count() <= self.most_sent else lambda df: df
        asked = near.selectExpr("a AS k").union(near.selectExpr("b AS k")).distinct()
        asked = settle(self.heads.join(asked, "k", "left_semi").select("k", "first_id", "first_h"), "asked")
        texts = self.texts(sent(asked))
        right = near.join(texts.select(F.col("k").alias("b"), F.col("__text").alias("tb")), "b")
        met = right.join(texts.select(F.col("k").alias("a"), F.col("__text").alias("ta")), "a").select("a", "b", "ta", "tb")
        out = settle(met.mapInArrow(_linked("text", self.size, self.percent), "a long, b long").distinct(), "links")
        discard(near, asked)
        return out


def _prefixes(docs: DataFrame, total: int, size: int, percent: int, crowded: int, bucket_prints: int = 500_000, most_bits: int = 1 << 26) -> DataFrame:
    """k, n, t, pos, sketch: the fingerprints in each class's prefix that another row may have too; total: of the sizes of all sets.

    Buckets of about bucket_prints fingerprints are counted apart. Each fills a part of the two
    filters, which have most_bits bits each at most, however large the input: beyond that, buckets
    share parts.
    """
    buckets, width = total // bucket_prints + 1, print_bytes(total)
    parts = min(buckets, max(1, most_bits >> 10))
    bits = 1 << max(10, (min(most_bits, 4 * total) // parts).bit_length() - 1)
    dealt = docs.select("__text").mapInArrow(_dealt("__text", size, buckets, crowded, width), "bucket long, once binary, few binary, many binary")
    made = dealt.groupBy("bucket").applyInArrow(_filter_parts(bits, crowded, width), "bucket long, shared binary, hot binary")
    part = F.pmod("bucket", F.lit(parts).cast("bigint"))
    joined = made.select(part.alias("part"), "shared", "hot").groupBy("part").applyInArrow(_joined_parts, "part long, shared binary, hot binary").collect()
    filters = np.zeros((2, parts, bits // 8), np.uint8)
    for row in joined:  # at most 2 * most_bits in all
        for which, bitmap in enumerate((row.shared, row.hot)):
            filters[which, row.part] = np.frombuffer(bitmap, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select("__text").mapInArrow(_picked("__text", size, percent, sent, buckets, width), "k long, n int, t array<long>, pos array<int>, sketch binary").dropDuplicates(["k"])


def _sizes_fit(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _enough_left(percent: int) -> str:
    """Whether two sets can link whose first common shingle is at places ia and ib."""
    return f"{100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)"


def _star_pairs(heads: DataFrame, stars: DataFrame | None, percent: int, turn: int, first: int = 12) -> DataFrame:
    """a, b: each class with one member, chosen anew each turn, of each list of some of its shingles, if that is of another star."""
    label = heads.withColumn("c", F.col("k")) if stars is None else heads.join(stars.selectExpr("node AS k", "component AS own"), "k", "left").withColumn("c", F.coalesce("own", "k"))
    parts = [F.slice(x, 1 + turn // 2 % 4 * first, first).alias(x) for x in ("t", "pos")]
    some = label.select("k", "n", "c", F.inline(F.arrays_zip(*parts)))
    before = F.floor(32 * F.col("pos") / F.col("n")) if turn % 2 == 0 else F.lit(0).cast("bigint")
    chosen = F.min(F.struct(before.alias("before"), F.xxhash64("k", F.lit(turn)).alias("h"), "k", "n", "c", "pos")).alias("r")
    lists = some.groupBy("t").agg(chosen, F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high")
    lists = settle(lists.select("t", "r"), "star-lists")  # a table, so that a hot list's join can be split
    met = some.selectExpr("t", "k", "c", "n AS na", "pos AS ia").join(lists.selectExpr("t", "r.k AS r", "r.n AS nb", "r.c AS rc", "r.pos AS ib"), "t")
    return met.filter(f"c != rc AND {_sizes_fit(percent)} AND {_enough_left(percent)}").select(F.least("k", "r").alias("a"), F.greatest("k", "r").alias("b")).distinct()


def linked_classes(docs: DataFrame, heads: DataFrame, n_classes: int, size: int, percent: int, few_per: int = 500, group: Callable[..., DataFrame] = components, rest: Callable[..., DataFrame] | None = None, paired: int = 0) -> DataFrame:
    """node, component: the classes that links hold together, found from the lists they share.

    docs: __id, __text, __h. heads: k, n, t (the class's lists), pos (its place in each),
    first_id, first_h and, where candidates are to be bounded first, sketch. group: makes
    components of links. rest: (join, classes with their star c, lists with their largest star)
    -> the links of classes of different stars that share a list, in place of pairs of classes.
    paired: lists of so many classes at most give pairs all the same (a list's pairs grow with its
    square, those of all such lists with their number). Without rest all lists give pairs.
    """
    work = _Join(docs, heads, size, percent)

    # answers from a similar set: a few checks for each class, each round against other members of its first lists
    star_links, stars, turn = None, None, 0
    while True:
        new = work.links(_star_pairs(heads, stars, percent, turn))
        n_new, turn = new.count(), turn + 1
        star_links = new if star_links is None else star_links.unionByName(new)
        if n_new or stars is None:
            old, stars = stars, settle(group(star_links if stars is None else new.unionByName(stars.selectExpr("node AS a", "component AS b")), most_rounds=2), "stars")
            discard(old)
        if turn >= 2 and n_new * few_per <= n_classes:
            break

    named = heads.join(stars.selectExpr("node AS k", "component AS c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    known = named.select("k", "c", "n", F.inline(F.arrays_zip("t", "pos")))
    counted = known.groupBy("t", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("t")
    spread = counted.agg(F.count(F.lit(1)).alias("stars"), F.max_by("c", F.struct("m", "c")).alias("major"), F.sum("m").alias("classes"))
    spread = settle(spread.filter("stars > 1").drop("stars"), "spread")
    links = stars.selectExpr("node AS a", "component AS b").unionByName(star_links)
    if rest is not None:
        links = links.unionByName(rest(work, named, known.join(spread.filter(F.col("classes") > paired), "t")))
        if not paired:
            return group(links)
        spread = spread.filter(F.col("classes") <= paired)
    lists = settle(known.join(spread, "t").select("t", "k", "c", "n", F.col("pos").alias("at"), (F.col("c") != F.col("major")).alias("minor")), "lists")

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 - 1e-9)))

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        x = left.select("t", F.col("k").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
        y = right.select("t", F.col("k").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"), band.alias("band"))
        met = x.join(y, ["t", "band"]).filter(f"ca != cb AND {_sizes_fit(percent)} AND {_enough_left(percent)}")
        return met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")

    # of two members of different stars, one at least is outside the list's largest star
    more = work.links(settle(pairs_of(lists.filter("minor"), lists).distinct(), "pairs"))

    return group(links.unionByName(more))


def judged_by(signed: DataFrame, least: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, is_first of the signed rows, by the components found for their classes."""
    # the least doc_id of each component
    found = found.withColumnRenamed("node", "k")
    head = F.min(F.struct(F.col("first_id").isNull(), "first_id", "k"))
    owner = found.join(least, "k").groupBy("component").agg(head.alias("r")).selectExpr("component", "r.first_id AS component_id", "r.k AS head")
    owned = found.join(owner, "component").select("k", "component_id", "head")
    named_to = least.join(owned, "k", "left").select("k", F.when(F.col("head").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.coalesce("head", "k") == F.col("k"), F.col("first_h")).alias("head_h"))
    out = signed.join(named_to, "k", "left")
    is_first = F.col("k").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("h").eqNullSafe(F.col("head_h")))
    return out.select("doc_id", F.col("h").alias("text_hash"), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), is_first.alias("is_first"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, crowded: int = 10, few_per: int = 500) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs."""
    return judged_rows(docs, doc_id, text, size, percent, crowded, few_per).select("doc_id", "n_shingles", "component_id")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def judged_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, crowded: int = 10, few_per: int = 500, paired: int = 16) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, is_first: a row for each row of docs.

    is_first: whether the row has the doc_id and text of its component's first row, which are
    those of one row (and its repetitions) in each component. paired: see linked_classes.
    """
    docs = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), text_hash(F.col(text)).alias("__h"))
    signed = settle(docs.mapInArrow(_sign("__text", "__id", "__h", size), _SIGNED), "signed")
    named = signed.filter("k IS NOT NULL")
    address = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))  # null ids last
    least = settle(named.groupBy("k").agg(address.alias("r")).selectExpr("k", "r.doc_id AS first_id", "r.h AS first_h"), "classes")
    total = signed.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    heads = settle(_prefixes(docs, total, size, percent, crowded).join(least, "k"), "heads")
    return judged_by(signed, least, linked_classes(docs, heads, least.count(), size, percent, few_per, rest=in_blocks(percent, size), paired=paired))
