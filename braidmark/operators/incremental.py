"""Incremental work lists, fingerprints and sanity checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmark.session import written


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def embed_plan(corpus: DataFrame, index: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """key, action: embed where the index lacks a row or a stamp differs, prune what the corpus lacks, else skip."""
    old = index.select(key, *[F.col(s).alias(f"__{s}") for s in stamps], F.lit(True).alias("__old"))
    met = corpus.select(key, *stamps, F.lit(True).alias("__new")).join(old, key, "full_outer")
    same = F.lit(True)
    for s in stamps:
        same = same & F.col(s).eqNullSafe(F.col(f"__{s}"))
    action = F.when(F.col("__new").isNull(), "prune").when(F.col("__old").isNotNull() & same, "skip").otherwise("embed")
    return met.select(key, action.alias("action"))


def corpus_digest(df: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: the sha-256 of all `key:digest` lines in order of key.

    The digest is serial, so one task reads all lines; for corpora of some hundred thousand rows. `fingerprint` is the form for any size.
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(digest).alias("h")))), lambda x: F.concat_ws(":", x["k"], x["h"])), "\n")
    return df.agg(F.sha2(lines, 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))


def fingerprint(df: DataFrame, key: str, digest: str, bucket_rows: int = 4096) -> DataFrame:
    """One hash of all rows in any order of arrival: rows are dealt by the hash of their key to buckets of about bucket_rows, each bucket's sorted lines are hashed, then the buckets' hashes."""
    line = F.concat_ws(":", F.col(key).cast("string"), F.col(digest))
    digits = max(1, math.ceil(math.log(max(1, df.count()) / bucket_rows, 16)))
    own = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)
    one = df.select(own.alias("b"), line.alias("l")).groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("l")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return one.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n_rows"))


def _leaf(key: str, levels: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")), 256), 1, 2 * levels)


def hash_tree(df: DataFrame, key: str, digest: str, levels: int = 2) -> DataFrame:
    """level, node, hash, n_rows: a tree of hashes over ranges of the keys' own hash, 256 nodes under each; level 0 has the root.

    A leaf's hash is of the sums of its rows' hashes, in four pieces, and their number: rows come in
    any order, are summed up before any shuffle, and a repeated key makes no group that a task must
    hold. A node's is of its children's, 256 at most. Leaves number 256 ** levels at most: 2 levels
    do for 10^8 rows, 3 for 10^10. An empty table has no nodes.
    """
    line = F.sha2(F.concat_ws(":", F.length(F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(digest), F.lit(""))), 256)
    pieces = [F.conv(F.substring("l", at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16, 31, 46)]
    sums = [F.sum(p).cast("string") for p in pieces]
    n = F.count(F.lit(1))
    nodes = df.select(_leaf(key, levels).alias("node"), line.alias("l")).groupBy("node").agg(F.sha2(F.concat_ws(",", *sums, n.cast("string")), 256).alias("hash"), n.alias("n_rows"))
    nodes = written(nodes.select(F.lit(levels).alias("level"), "node", "hash", "n_rows"), "leaves")
    tree = nodes
    for level in range(levels - 1, -1, -1):
        under = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        nodes = nodes.groupBy(F.substring("node", 1, 2 * level).alias("node")).agg(F.sha2(under, 256).alias("hash"), F.sum("n_rows").alias("n_rows"))
        nodes = nodes.select(F.lit(level).alias("level"), "node", "hash", "n_rows")
        tree = tree.unionByName(nodes)
    return tree


def changed_leaves(new: DataFrame, old: DataFrame, levels: int = 2) -> DataFrame:
    """node: leaves in which two trees of hash_tree differ, found from the root down; only children of differing nodes are compared."""
    differ = None
    for level in range(levels + 1):
        of = lambda tree, name: tree.filter(F.col("level") == level).select("node", F.col("hash").alias(name))  # noqa: B023, E731
        a, b = of(new, "a"), of(old, "b")
        if differ is not None:
            up = differ.withColumnRenamed("node", "__up")
            a, b = (t.join(up, F.substring("node", 1, 2 * (level - 1)) == F.col("__up"), "left_semi") for t in (a, b))
        differ = a.join(b, "node", "full_outer").filter("NOT (a <=> b)").select("node")
    return differ


def changed_keys(new: DataFrame, old: DataFrame, key: str, stamps: list[str], levels: int = 2, new_tree: DataFrame | None = None, old_tree: DataFrame | None = None) -> DataFrame:
    """key, action (embed or prune) of embed_plan, from rows of those leaves only in which the trees differ.

    Trees are made here unless given: hash_tree over the key and the stamps' cache_key, written beside the table that they sum up.
    """
    stamped = lambda df: df.select(key, *stamps, cache_key(*map(F.col, stamps), nulls=True).alias("__stamp"))
    a, b = stamped(new), stamped(old)
    trees = [given if given is not None else written(hash_tree(df, key, "__stamp", levels), "tree") for given, df in ((new_tree, a), (old_tree, b))]
    leaves = written(changed_leaves(*trees, levels), "changed")
    read = lambda df: df.withColumn("node", _leaf(key, levels)).join(leaves, "node", "left_semi").select(key, *stamps)
    return embed_plan(read(a), read(b), key, stamps).filter("action != 'skip'")


def cache_key(*parts: Column, nulls: bool = False) -> Column:
    """Hash of length-delimited parts, so that no two lists of parts share one; a null counts as empty, or with nulls as a value of its own."""
    text = [F.coalesce(F.concat(F.lit("="), p.cast("string")) if nulls else p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def point_id(namespace: str, key: Column) -> Column:
    """The name-based UUID (version 5) of a key in a namespace UUID."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), key.cast("string").cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def index_count(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """One row: both counts, and equal, partial (fewer vectors) or stale (more)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    state = F.when(F.col("vectors") < F.col("documents"), "partial").when(F.col("vectors") > F.col("documents"), "stale").otherwise("equal")
    return n(corpus, "documents").join(F.broadcast(n(index, "vectors"))).withColumn("state", state)  # one row each


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 3.5).cast("int") + 1)


def vector_violations(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """key, violation: empty, wrong dimension, or all zero."""
    v = F.col(vector)
    kind = F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != dims, "dimension").when(F.forall(v, lambda x: x == 0), "zero")
    return df.select(key, kind.alias("violation")).filter("violation IS NOT NULL")


def uncached(work: DataFrame, memo: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key the memo lacks."""
    return work.join(memo.select(*keys), keys, "left_anti")


def restamped(work: DataFrame, memo: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Work whose key the memo has, with the memo's answer; every other column is the work's own."""
    return work.drop(answer).join(memo.select(*keys, answer), keys)
