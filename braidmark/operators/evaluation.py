"""Retrieval and label evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strongest(gold: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    """One row per pair, with its strongest status (the first in order); a status that isn't in order never counts (null if there is no other)."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    return gold.groupBy(*keys).agg(F.min_by(status, rank).alias(status))


def recall_and_mrr(gold: DataFrame, ranked: DataFrame, keys: list[str], cutoffs: list[int], by: list[str] = (), distinct_gold: bool = False) -> DataFrame:
    """n_gold, n_found, recall_<k>, mrr. Gold rows count as often as they occur unless distinct_gold."""
    wanted = gold.distinct() if distinct_gold else gold
    best = ranked.groupBy(*keys).agg(F.min("rank").alias("rank"))
    met = wanted.join(best, keys, "left")
    n = F.count(F.lit(1))
    recalls = [F.bround(F.count(F.when(F.col("rank") <= k, 1)) / n, 6).alias(f"recall_{k}") for k in cutoffs]
    return met.groupBy(*by).agg(n.alias("n_gold"), F.count("rank").alias("n_found"), *recalls, F.bround(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / n, 6).alias("mrr"))


def score_labels(gold: DataFrame, predicted: DataFrame, keys: list[str], truth: str, guess: str, positive: list[str], by: list[str] = ()) -> DataFrame:
    """Exact rate, and the binary counts, precision and recall; pairs without a prediction are counted apart."""
    met = gold.join(predicted, keys, "left")
    has = F.col(guess).isNotNull()
    t, g = F.col(truth).isin(*positive), F.col(guess).isin(*positive)
    n = lambda c: F.count(F.when(has & c, 1))
    out = met.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold"), F.count(F.when(~has, 1)).alias("missing"), n(F.col(truth) == F.col(guess)).alias("exact"), n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    rate = lambda a, b: F.bround(F.try_divide(a, b), 6)
    return out.withColumns({"exact_rate": rate(F.col("exact"), F.col("n_gold") - F.col("missing")), "precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})


def label_agreement(gold: DataFrame, predicted: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """Predictions that are among a pair's allowed labels: over the overlap, and over all gold."""
    allowed = gold.groupBy(*keys).agg(F.collect_set(truth).alias("allowed"))
    met = allowed.join(predicted, keys, "left")
    right = F.count(F.when(F.array_contains("allowed", F.col(guess)), 1))
    return met.agg(F.count(F.lit(1)).alias("n_gold"), F.count(guess).alias("n_overlap"), right.alias("n_right"), F.bround(F.try_divide(right, F.count(guess)), 6).alias("overlap_accuracy"), F.bround(right / F.count(F.lit(1)), 6).alias("gold_accuracy"))


def sweep(hits: DataFrame, gold: DataFrame, configs: list[tuple], cutoffs: list[int]) -> DataFrame:
    """Recall and MRR of each fusion setting (name, mode, rrf_k, top_arms), all replayed at once from the same ranked lists."""
    from braidmark.operators.retrieval import fuse_arms, top_k

    table = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(m).alias("mode"), F.lit(k).alias("rrf_k"), F.lit(a).alias("top_arms")) for n, m, k, a in configs])).alias("__s")
    every = hits.select("*", table).select("*", "__s.*").drop("__s")
    fused = fuse_arms(every, F.col("mode"), F.col("rrf_k"), F.col("top_arms"), by=["config"])
    ranked = top_k(fused, ["config", "entity_id"], [F.desc("score"), "doc_id"], max(cutoffs))
    wanted = gold.distinct().select("*", F.explode(F.array(*[F.lit(n) for n, *_ in configs])).alias("config"))
    return recall_and_mrr(wanted, ranked, ["config", "entity_id", "doc_id"], cutoffs, by=["config"])


def entity_recall(gold: DataFrame, ranked: DataFrame, keys: list[str], cutoff: int, bar: float) -> DataFrame:
    """Per entity (the first of keys): gold rows, those found up to the cutoff, recall, the missed documents in order, and whether it passes the bar."""
    best = ranked.groupBy(*keys).agg(F.min("rank").alias("rank"))
    met = gold.select(*keys).distinct().join(best, keys, "left").withColumn("__hit", F.coalesce(F.col("rank") <= cutoff, F.lit(False)))
    out = met.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n_gold"), F.count_if("__hit").alias("n_found"), F.array_sort(F.collect_list(F.when(~F.col("__hit"), F.col(keys[1])))).alias("missed"))
    return out.withColumns({"recall": F.bround(F.col("n_found") / F.col("n_gold"), 6), "passes": F.col("n_found") >= bar * F.col("n_gold")})


def recall_before_and_after(gold: DataFrame, before: DataFrame, after: DataFrame, scanned: DataFrame, keys: list[str], cutoffs: list[int]) -> DataFrame:
    """Recall over gold rows before and after a stage, with the gold entities that no artifact covers and those whose artifact lacks the list counted apart.

    scanned: entity (the first of keys), has_before, has_after.
    """
    wanted = gold.select(keys[0]).distinct().join(scanned, keys[0], "left")
    counts = wanted.agg(F.count_if(F.col("has_after").isNull()).alias("missing_files"), F.count_if(~F.col("has_before")).alias("missing_before"), F.count_if(~F.col("has_after")).alias("missing_after"))
    both = None
    for name, ranked in (("before", before), ("after", after)):
        one = recall_and_mrr(gold, ranked, keys, cutoffs).select(F.lit(name).alias("stage"), "*")
        both = one if both is None else both.unionByName(one)
    return both.join(F.broadcast(counts))  # one row of counts


def pool_comparison(single: DataFrame, union: DataFrame, gold: DataFrame) -> DataFrame:
    """Per kind of pool: average and greatest size, how many rows the union adds, and the share of gold rows inside."""
    out = None
    for name, pool in (("single", single), ("union", union)):
        size = pool.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("added").alias("a"))
        sizes = size.agg(F.bround(F.avg("n"), 6).alias("avg_size"), F.max("n").alias("max_size"), F.bround(F.avg("a"), 6).alias("avg_added"), F.max("a").alias("max_added"))
        inside = gold.join(pool.select("entity_id", "doc_id", F.lit(1).alias("in")), ["entity_id", "doc_id"], "left").agg(F.count(F.lit(1)).alias("n_gold"), F.count("in").alias("n_inside"))
        one = sizes.join(F.broadcast(inside)).select(F.lit(name).alias("pool"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out.withColumn("coverage", F.bround(F.try_divide("n_inside", "n_gold"), 6))


def rescue_sweep(fused: DataFrame, sums: DataFrame, gold: DataFrame, top_n: int, slots: list[int]) -> DataFrame:
    """Per number of slots: gold rows inside the shortlist, those recovered by rescue and those lost against none, and whether the core kept its order."""
    from braidmark.operators.ranking import rescue

    base = rescue(fused, sums, top_n, 0).select("entity_id", "doc_id", F.col("final_rank").alias("__base"))
    out = None
    for n in slots:
        now = rescue(fused, sums, top_n, n)
        met = gold.distinct().join(now, ["entity_id", "doc_id"], "left").join(base, ["entity_id", "doc_id"], "left")
        has, had = F.col("final_rank").isNotNull(), F.col("__base").isNotNull()
        one = met.agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(has).alias("n_inside"), F.count_if(has & ~had & (F.col("rescued_via") == "sum")).alias("recovered"), F.count_if(had & ~has).alias("lost"))
        moved = now.filter(F.col("final_rank") <= top_n - n).join(base, ["entity_id", "doc_id"], "left").agg(F.count_if(~F.col("final_rank").eqNullSafe(F.col("__base"))).alias("core_moved"))
        one = one.join(F.broadcast(moved)).select(F.lit(n).alias("slots"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def label_comparison(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs of either side: both, only_left or only_right; a match if the left label is among the right's; a note."""
    allowed = right.groupBy(*keys).agg(F.array_sort(F.collect_set(b)).alias("allowed"))
    met = left.select(*keys, a).join(allowed, keys, "full_outer")
    where = F.when(F.col("allowed").isNull(), "only_left").when(F.col(a).isNull(), "only_right").otherwise("both")
    match = (where == "both") & F.coalesce(F.array_contains("allowed", F.col(a)), F.lit(False))
    note = F.when(match, "match").when(where == "both", F.concat(F.lit("expected "), F.array_join("allowed", "/"), F.lit(", got "), F.col(a))).otherwise(where)
    return met.select(*keys, where.alias("presence"), match.alias("is_match"), note.alias("note"))


def shortlist_violations(ranked: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """entity_id, violation, n of shortlists (entity_id, rank, doc_id, text): ranks other than 1..n, repeated documents or texts, texts that differ from the source's."""
    per = ranked.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("rank").alias("r"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("doc_id").alias("d"), F.count_distinct(F.lower(F.trim("text"))).alias("t"))
    bad = F.array(
        F.struct(F.lit("ranks").alias("violation"), ((F.col("c") != n) | (F.col("r") != n) | (F.col("lo") != 1) | (F.col("hi") != n)).cast("bigint").alias("n")),
        F.struct(F.lit("repeated_documents").alias("violation"), (F.col("c") - F.col("d")).alias("n")),
        F.struct(F.lit("repeated_texts").alias("violation"), (F.col("c") - F.col("t")).alias("n")),
    )
    own = per.select("entity_id", F.inline(bad)).filter("n > 0")
    differ = ranked.join(texts.select("doc_id", F.col("text").alias("__t")), "doc_id", "left").filter(~F.col("text").eqNullSafe(F.col("__t"))).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(differ.select("entity_id", F.lit("text_differs").alias("violation"), "n"))


def count_gate(df: DataFrame, expected: int) -> DataFrame:
    """One row: expected, found, and whether they agree."""
    return df.agg(F.lit(expected).cast("bigint").alias("expected"), F.count(F.lit(1)).alias("found")).withColumn("verdict", F.when(F.col("found") == F.col("expected"), "PASS").otherwise("FAIL"))
