"""Crosswalks between two vocabularies of codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BooleanType

from braidmark.operators.index import Index, Share, hits_of
from braidmark.operators.retrieval import packed_queries, top_k
from braidmark.session import discard, written

#: Rows of a table of hashes that are sent to all tasks at most (16 bytes each as arrays, some 50 in a join); beyond that, tables are joined by shuffles.
MOST_SENT = 4_000_000


def idf(target: DataFrame) -> DataFrame:
    """token, df, idf = ln(N / df) + 0.1 over the target's keys with a token (key, tokens; no key twice)."""
    n = target.filter("size(tokens) > 0").agg(F.count(F.lit(1)).alias("n"))
    own = target.select(F.explode(F.array_distinct("tokens")).alias("token"))
    return own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", "df", (F.log(F.col("n") / F.col("df")) + 0.1).alias("idf"))


def _normed(sent):
    """id, len, terms of id, terms: the length of each document's vector by the idf of its terms: sorted hashes, their idf, and that of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, rest = sent.value
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            of, terms = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            order = np.lexsort((terms, of))
            of, terms = of[order], terms[order]
            new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (terms[1:] != terms[:-1]))) if len(of) else np.empty(0, np.int64)
            at = np.searchsorted(known, terms[new])
            own = np.where(np.append(known, 0)[at] == terms[new], np.append(weight, rest)[at], rest)
            w = np.diff(np.append(new, len(of))) * np.where(at < len(known), own, rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.bincount(of[new], w * w, n))), lists], names=["id", "len", "terms"])

    return run


def text_crosswalk(source: DataFrame, target: DataFrame, n: int = 3, most_sent: int = MOST_SENT) -> DataFrame:
    """key, rank, target, score: IDF-weighted cosine over shared tokens; pairs without any never meet. Unknown tokens weigh 1.

    source, target: key (long), tokens (merged by collocation, see merged_tokens). The targets are
    read some times, so give a written table; rows that repeat a key are one target. Their index
    bounds what a block of them can reach, as for the sparse arms. Up to most_sent tokens of two
    targets and more, their weights are sent to where the targets are read, else joined. Ranked by scores to nine
    digits (norms are sums in any order), ties to the smaller key; shown to six digits.
    """
    known = target.select("key", "tokens")
    if not known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        known = written(known.groupBy("key").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), "bags")
    weights = written(idf(known), "idf")

    def norms(bags_: DataFrame) -> tuple[DataFrame, DataFrame]:
        w = bags_.join(weights, "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
        return w, w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    some = known.filter("size(tokens) > 0").select(F.col("key").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("terms"))
    common = weights.filter("df > 1")  # tokens of one document all weigh the same, and most
    if common.count() <= most_sent:
        table = common.select(F.xxhash64("token").alias("h"), "idf").orderBy("h").toArrow()
        rest = weights.agg(F.coalesce(F.max("idf"), F.lit(0.0))).first()[0]
        sent = target.sparkSession.sparkContext.broadcast((*(table.column(c).to_numpy() for c in ("h", "idf")), rest))
        docs = some.mapInArrow(_normed(sent), "id long, len double, terms array<long>")
    else:
        docs = some.join(norms(bags_of(known))[1].selectExpr("key AS id", "norm AS len"), "id")
        docs = written(docs.select("id", "len", "terms"), "normed")  # else the number of its partitions is found by running it
    index = Index(docs)
    own, own_norms = norms(bags_of(source))
    # a target's weight is tf * idf / norm: its idf goes to the source's side, as only shared tokens count
    asked = own.filter("idf IS NOT NULL").join(own_norms, "key").select(F.col("key").alias("id"), F.col("token").alias("term"), (F.col("w") / F.col("norm") * F.col("idf")).alias("w"))
    best = hits_of(index.search(packed_queries(asked), n, Share(), digits=9))
    ranked = top_k(best, ["query_id"], [F.desc("score"), "doc_id"], n)
    return ranked.select(F.col("query_id").alias("key"), "rank", F.col("doc_id").alias("target"), F.round("score", 6).alias("score"))


def collocations(docs: DataFrame, key: str, tokens: Column, least: int = 2, ratio: float = 0.7, most_sent: int = MOST_SENT) -> DataFrame:
    """first, second, df of adjacent pairs in enough documents, by number and by share of each word's documents.

    A pair has as many documents as its rarer word at most. Up to most_sent words, their numbers
    are sent to where the documents are read, so that only pairs are shuffled that can be enough.
    """
    own = docs.select(F.col(key).alias("key"), tokens.alias("t"))
    # words have no spaces; distinct strings are found by hash, structs by comparing all
    joined = F.array_distinct(F.filter(F.zip_with("t", F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))
    words = own.select(F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    words = written(words, "word-df")
    pairs = own.select(F.explode(joined).alias("pair"))
    if words.count() <= most_sent:
        n_of = lambda i: F.broadcast(words.select(F.xxhash64("w").alias(f"h{i}"), F.col("n").alias(f"n{i}")))
        pairs = pairs.withColumns({f"h{i}": F.xxhash64(F.split("pair", " ")[i]) for i in (0, 1)}).join(n_of(0), "h0").join(n_of(1), "h1")
        pairs = pairs.filter(F.least("n0", "n1") >= ratio * F.greatest("n0", "n1")).select("pair")
    pair_df = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    pair_df = pair_df.select(F.split("pair", " ")[0].alias("first"), F.split("pair", " ")[1].alias("second"), "df")
    met = pair_df.join(words.selectExpr("w AS first", "n AS n1"), "first").join(words.selectExpr("w AS second", "n AS n2"), "second")
    return met.filter((F.col("df") >= ratio * F.col("n1")) & (F.col("df") >= ratio * F.col("n2"))).select("first", "second", "df")


def apply_crosswalk(declared: DataFrame, walk: DataFrame, present: DataFrame, tiers: list[str], least: str) -> DataFrame:
    """entity_id, doc_id, turn: mapped targets of a sure enough tier that the entity lacks."""
    tier = F.array_position(F.array(*map(F.lit, tiers)), F.col("confidence"))
    good = walk.withColumn("__t", tier).filter((F.col("__t") > 0) & (F.col("__t") <= tiers.index(least) + 1))
    new = declared.join(good, "source_code").select("entity_id", F.col("target_code").alias("doc_id"), "__t")
    new = new.join(present.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti").groupBy("entity_id", "doc_id").agg(F.min("__t").alias("__t"))
    return top_k(new, ["entity_id"], ["__t", "doc_id"], 1 << 30, "turn").select("entity_id", "doc_id", "turn")


def tier(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def _starts(sent):
    """Which of a row's adjacent pairs (hashes) begin a merged token: of those in the sent table every other one of a row of them."""

    @F.pandas_udf(ArrayType(BooleanType()))
    def starts(pairs: pd.Series) -> pd.Series:
        known = sent.value
        counts = np.array([len(p) for p in pairs], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *pairs])
        hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        ends = np.cumsum(counts)
        begins = np.zeros(len(flat) + 1, bool)
        begins[ends - counts] = True
        at = np.flatnonzero(hit)
        new = np.append(True, (at[1:] != at[:-1] + 1) | begins[at[1:]]) if len(at) else np.empty(0, bool)
        turn = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
        out = np.zeros(len(flat), bool)
        out[at[turn % 2 == 0]] = True
        some = np.add.reduceat(np.append(out, False), ends - counts) * (counts > 0) if len(counts) else counts
        return pd.Series([out[e - c : e] if x else None for e, c, x in zip(ends, counts, some, strict=True)], dtype=object)

    return starts


def merged_tokens(df: DataFrame, key: str, tokens: Column, pairs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """key, tokens: adjacent words of a pair (first, second) as one token first_second, greedily from left to right.

    pairs: collocations. Of pairs that overlap in a row of them every other one is taken, which is
    what going from left to right comes to. Up to most_sent pairs, their 64-bit hashes are sent to
    where the rows are read. More are joined with the rows' pairs; a row of df is then looked up by
    a number of its own, so repeated keys keep their own tokens.
    """
    pairs = written(pairs.select("first", "second").distinct(), "collocations")
    after = lambda make: F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), make)
    if pairs.count() <= most_sent:
        hashes = pairs.select(F.xxhash64("first", "second").alias("h")).orderBy("h").toArrow().column("h").to_numpy()
        sent = df.sparkSession.sparkContext.broadcast(hashes)
        met = df.select(F.col(key).alias("key"), tokens.alias("t")).withColumn("starts", _starts(sent)(after(lambda a, b: F.xxhash64(a, b))))
    else:
        own = written(df.select(F.col(key).alias("key"), tokens.alias("t"), F.monotonically_increasing_id().alias("row")), "tokens")
        found = own.select("row", F.size("t").alias("n"), F.posexplode(after(lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("i", "p")).select("row", "n", "i", "p.*").join(pairs, ["first", "second"], "left_semi")
        island = F.col("i") - F.row_number().over(W.partitionBy("row").orderBy("i"))
        found = found.withColumn("island", island).withColumn("at", F.row_number().over(W.partitionBy("row", "island").orderBy("i"))).filter("at % 2 = 1")
        at = found.groupBy("row", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", F.lit(True)))).alias("at"))
        starts = at.select("row", F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.coalesce(F.col("at")[i], F.lit(False))).alias("starts"))
        met = own.join(starts, "row", "left")
    begins = lambda i: F.coalesce(F.get("starts", i), F.lit(False))
    one = F.transform("t", lambda w, i: F.when(begins(i), F.concat(w, F.lit("_"), F.get("t", i + 1))).when(~begins(i - 1), w))
    return met.select("key", F.when(F.col("starts").isNull(), F.col("t")).otherwise(F.array_compact(one)).alias("tokens"))


def merged_sides(source: DataFrame, target: DataFrame, stop: tuple[str, ...] = (), least: int = 2, ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """key, tokens of both sides (key, text), merged by the collocations of both together."""
    both = source.select("key", "text", F.lit("s").alias("side")).unionByName(target.select("key", "text", F.lit("t").alias("side")))
    own = written(both.select(F.struct("side", "key").alias("key"), words_of(F.col("text"), stop).alias("t")), "words")
    merged = merged_tokens(own, "key", F.col("t"), collocations(own, "key", F.col("t"), least, ratio))
    merged = written(merged, "merged")
    discard(own)
    one, two = (merged.filter(F.col("key.side") == s).select("key.key", "tokens") for s in ("s", "t"))
    return one, two


def bags_of(merged: DataFrame) -> DataFrame:
    """key, token, tf of merged tokens."""
    return merged.select("key", F.explode("tokens").alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))


def words_of(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of two letters or more outside parentheses, without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\([^)]*\)", " ")
    return F.filter(F.regexp_extract_all(plain, F.lit("[a-z']+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def band(score: Column) -> Column:
    """Coverage band 0 to 5 of a share in per cent."""
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor(score / 20).cast("int") + F.when(score > 0, 1).otherwise(0)))


def embedding_crosswalk(source: DataFrame, target: DataFrame, key: str, vector: str, n: int = 3) -> DataFrame:
    """key, rank, target, score: the n targets of greatest cosine of each source, in blocks; ties to the smaller id.

    A pair of which one vector has no length (null, empty, zero, or not a number) scores 0 and counts as the others do:
    for that, the n smallest ids of such targets, and of all targets, are sent to all sources.
    """
    from braidmark.operators.retrieval import dense_top_k, top_k

    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    flat = ~F.coalesce((norm > 0) & ~F.isnan(norm), F.lit(False))
    of = lambda df, name: df.select(F.col(key).cast("long").alias(name), flat.alias("flat"))
    least = lambda df: df.select("target").orderBy("target").limit(n)
    targets = of(target, "target")
    flats = least(targets.filter("flat")).withColumn("flat", F.lit(False)).unionByName(least(targets).withColumn("flat", F.lit(True)))
    level = of(source, "key").join(F.broadcast(flats), "flat").select("key", "target", F.lit(0.0).alias("score"))  # 2 * n rows
    best = dense_top_k(target, source, key, key, vector, n, digits=6).select(F.col("query_id").alias("key"), F.col("doc_id").alias("target"), "score")
    return top_k(best.unionByName(level), ["key"], [F.desc("score"), "target"], n).select("key", "rank", "target", "score")


def untaught(declared: DataFrame, walk: DataFrame, taught: DataFrame) -> DataFrame:
    """entity_id, doc_id that an entity declares, by way of the crosswalk, but isn't found to teach."""
    claimed = declared.join(walk.select("source_code", F.col("target_code").alias("doc_id")), "source_code").select("entity_id", "doc_id").distinct()
    return claimed.join(taught.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti")
