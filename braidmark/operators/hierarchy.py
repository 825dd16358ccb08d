"""Dotted codes and parent-linked trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.session import discard, written

LEVELS = ("grade", "domain", "big_idea", "standard", "substandard")


def split_label(df: DataFrame, text: str, most: int = 40) -> DataFrame:
    """label: what stands before the first colon, if it is short and has no dot, else empty; body: what is left."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    at = F.locate(":", t)
    head = F.trim(F.substring(t, F.lit(1), at - 1))
    good = (at > 1) & (F.length(head) <= most) & ~F.contains(head, F.lit("."))
    return df.withColumns({"label": F.when(good, head).otherwise(""), "body": F.when(good, F.trim(F.substr(t, at + 1))).otherwise(t)})


def code_columns(df: DataFrame, code: str) -> DataFrame:
    """level (by depth), parent (null at the domain) and grade (K is 0; bands give null)."""
    parts = F.split(F.col(code), r"\.")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(F.size(parts), F.lit(len(LEVELS))))
    parent = F.when(F.size(parts) > 2, F.regexp_replace(F.col(code), r"\.[^.]*$", ""))
    grade = F.when(parts[0] == "K", 0).otherwise(parts[0].try_cast("int"))
    return df.withColumns({"level": level, "parent": parent, "grade": grade})


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor, distance (the least) for every ancestor in the table, however deep; a missing parent or a cycle ends a chain.

    Pairs up to a distance are joined with those at just that distance, which doubles it: a tree
    of depth d takes log2(d) + 1 rounds. Each round is written and the one before it deleted; a
    pair that is met again (a cycle, or a longer way) is dropped.
    """
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor IS NOT NULL AND node != ancestor").distinct()
    known = edges.join(nodes.select(F.col(node).alias("ancestor")).distinct(), "ancestor", "left_semi").select("node", "ancestor", F.lit(1).alias("distance"))
    known, reach = written(known, "pairs"), 1
    while True:
        near = known.select(F.col("node").alias("mid"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
        further = known.filter(F.col("distance") == reach).join(near, F.col("ancestor") == F.col("mid")).filter("far != node")
        further = further.select("node", F.col("far").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        new = written(further.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "distance"), "pairs")
        if new.isEmpty():
            discard(new)
            return known
        both = written(known.unionByName(new), "pairs")
        discard(known, new)
        known, reach = both, 2 * reach


def paths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, path (from its root down to its parent) and depth; a root's path is empty."""
    up = ancestors(nodes, node, parent).groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("a"))
    found = nodes.select(F.col(node).alias("node")).distinct().join(up, "node", "left")
    path = F.coalesce(F.transform("a", lambda x: x["ancestor"]), F.array().cast("array<string>"))
    return found.select("node", path.alias("path"), F.size(path).alias("depth"))


def children_of(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node and its children in order of code (an empty list for a leaf)."""
    kids = nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("node")).agg(F.array_sort(F.collect_set(node)).alias("children"))
    none = F.array().cast(nodes.select(F.array(node)).schema[0].dataType)
    return nodes.select(F.col(node).alias("node")).distinct().join(kids, "node", "left").withColumn("children", F.coalesce("children", none))


def context(nodes: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """Each node with its label, the labels of its ancestors from the root down, and those of its children in order of code."""
    named = nodes.select(F.col(node).alias("ancestor"), F.col(label).alias("__l"))
    up = ancestors(nodes, node, parent).join(named, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "__l"))).alias("a"))
    down = nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("node")).agg(F.array_sort(F.collect_list(F.struct(node, label))).alias("c"))
    met = nodes.select(F.col(node).alias("node"), F.col(label).alias("label")).join(up, "node", "left").join(down, "node", "left")
    none = F.array().cast("array<string>")
    return met.select("node", "label", F.coalesce(F.transform("a", lambda x: x["__l"]), none).alias("ancestor_labels"), F.coalesce(F.transform("c", lambda x: x[label]), none).alias("child_labels"))


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows without a parent, or whose parent isn't in the table."""
    known = nodes.select(F.col(node).alias(parent)).distinct()
    return nodes.join(known, parent, "left_anti")
