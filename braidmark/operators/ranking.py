"""Scores to final lists: scaling, rerank with preserved heads, shortlists, rescue, stage ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.session import written


def order_statistics(df: DataFrame, ranks: str, most_rows: int = 100_000, bins: int = 1024) -> DataFrame:
    """g, at, x: for each group the value at each of its ranks (from 0), exactly.

    df: g, x (double, neither null nor NaN). ranks: SQL for the ranks as an array of longs, from n, the
    group's number of values. While a range of values has more than most_rows, its values are
    counted in equal bins (and, in the end, one by one, when its ends are neighbours or equal) and
    only the bins that hold a rank are read further; a range of fewer is sorted. No task holds a
    group.
    """
    df = written(df.select("g", "x"), "values")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wanted = sizes.select("g", "n", "low", "high", F.explode(F.array_distinct(F.expr(ranks))).alias("at")).withColumn("rest", F.col("at"))
    wanted, done = written(wanted, "wanted"), None
    while True:
        # ranges of one value are settled; small ones are sorted below
        settled = wanted.filter("low = high").select("g", "at", F.col("low").alias("x"))
        done = settled if done is None else done.unionByName(settled)
        large = wanted.filter(f"low < high AND n > {most_rows}")
        small = wanted.filter(f"low < high AND n <= {most_rows}")
        ranges = small.select("g", "low", "high").distinct()
        held = df.join(ranges.withColumnRenamed("g", "__g"), (F.col("g") == F.col("__g")) & F.col("x").between(F.col("low"), F.col("high"))).drop("__g")
        counted = held.groupBy("g", "low", "high", "x").agg(F.count(F.lit(1)).alias("k"))
        upto = F.sum("k").over(W.partitionBy("g", "low", "high").orderBy("x"))
        placed = counted.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("k")).drop("k")
        found = small.join(placed, ["g", "low", "high"]).filter("rest >= after AND rest < upto").select("g", "at", "x")
        done = written(done.unionByName(found), "found")
        if large.isEmpty():
            return done
        ranges = large.select("g", "low", "high").distinct()
        held = df.join(ranges.withColumnRenamed("g", "__g"), (F.col("g") == F.col("__g")) & F.col("x").between(F.col("low"), F.col("high"))).drop("__g")
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: no overflow
        binned = held.withColumn("bin", F.when(F.col("x") == F.col("low"), -1).when(F.col("x") == F.col("high"), bins).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))))
        counts = binned.groupBy("g", "low", "high", "bin").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("a"), F.max("x").alias("b"))
        counts = counts.withColumn("upto", F.sum("k").over(W.partitionBy("g", "low", "high").orderBy("bin"))).withColumn("after", F.col("upto") - F.col("k"))
        hit = large.drop("n").join(counts, ["g", "low", "high"]).filter("rest >= after AND rest < upto")
        wanted = written(hit.select("g", F.col("k").alias("n"), F.col("a").alias("low"), F.col("b").alias("high"), "at", (F.col("rest") - F.col("after")).alias("rest")), "wanted")


def robust_minmax(df: DataFrame, by: list[str], value: str, out: str = "scaled", few: int = 10) -> DataFrame:
    """Scales to 0..1 between the 5th and 95th percentiles (least and greatest of few rows); constant: 0.5.

    few counts all rows of a group, those without a value too; percentiles are linear between the
    values at the two nearest ranks, found by order_statistics.
    """
    x = F.when(F.isnan(value), None).otherwise(F.col(value)).cast("double")
    key = F.struct(*by)  # a null key is a group of its own
    own = df.groupBy(key.alias("g")).agg(F.count(F.lit(1)).alias("__n"), F.count(x).alias("__k"), F.min(x).alias("__a"), F.max(x).alias("__b"))
    spot = lambda p: f"{p} * (n - 1)"
    ranks = ", ".join(f"cast({f}({spot(p)}) AS bigint)" for p in ("0.05D", "0.95D") for f in ("floor", "ceil"))
    values = df.select(key.alias("g"), x.alias("x")).filter("x IS NOT NULL")
    at = order_statistics(values, f"array({ranks})").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("__v"))
    own = own.join(at, "g", "left")

    def percentile(p: float) -> Column:
        place = F.lit(p) * (F.col("__k") - 1)
        low, high = (F.try_element_at("__v", f(place).cast("bigint")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    low = F.when(F.col("__n") >= few, percentile(0.05)).otherwise(F.col("__a"))
    high = F.when(F.col("__n") >= few, percentile(0.95)).otherwise(F.col("__b"))
    own = own.select(F.col("g").alias("__g"), "__a", low.alias("__low"), high.alias("__high"))
    filled = F.coalesce(x, F.col("__a"))
    scaled = F.when(F.col("__high") > F.col("__low"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (filled - F.col("__low")) / (F.col("__high") - F.col("__low"))))).otherwise(F.lit(0.5))
    return df.join(own, key == F.col("__g")).withColumn(out, F.round(scaled, 9)).select(*[c for c in df.columns if c != out], out)


def blend(df: DataFrame, alpha: float) -> DataFrame:
    """blended_score = (1 - alpha) * rerank + alpha * prior, both scaled per entity."""
    scaled = robust_minmax(robust_minmax(df, ["entity_id"], "rerank_score", "__ce"), ["entity_id"], "rrf_score", "__rrf")
    return scaled.withColumn("blended_score", F.round((1 - alpha) * F.col("__ce") + alpha * F.col("__rrf"), 9)).drop("__ce", "__rrf")


def preserve_heads(df: DataFrame, top_n: int, preserve: int) -> DataFrame:
    """The best top_n by blended score, with the first `preserve` rows of the prior order let in for the worst others; rows without a prior rank are never preserved.

    df: entity_id, doc_id, rrf_rank, rerank_score, blended_score. Adds rerank_rank.
    """
    best = [F.desc("blended_score"), F.desc("rerank_score"), "doc_id"]
    e = W.partitionBy("entity_id")
    placed = df.withColumn("__at", F.row_number().over(e.orderBy(*best))).withColumns({"__in": F.col("__at") <= top_n, "__head": F.coalesce(F.col("rrf_rank") <= preserve, F.lit(False))})
    missing, spare = F.col("__head") & ~F.col("__in"), F.col("__in") & ~F.col("__head")
    placed = placed.withColumn("__m", F.least(F.sum(missing.cast("int")).over(e), F.sum(spare.cast("int")).over(e)))
    placed = placed.withColumns(
        {
            "__let": F.row_number().over(W.partitionBy("entity_id", missing).orderBy("rrf_rank")),
            "__out": F.row_number().over(W.partitionBy("entity_id", spare).orderBy("blended_score", "__at")),
        }
    )
    kept = placed.filter((F.col("__in") & ~(spare & (F.col("__out") <= F.col("__m")))) | (missing & (F.col("__let") <= F.col("__m"))))
    return kept.withColumn("rerank_rank", F.row_number().over(e.orderBy(*best))).drop("__at", "__in", "__head", "__m", "__let", "__out")


def fusion_score(df: DataFrame, rrf_k: int = 60, ce_weight: float = 1.0, rrf_weight: float = 10.0) -> DataFrame:
    """Weighted rank priors, with a boost for the middle of the prior list that the reranker likes."""
    middle = F.col("rrf_rank").between(12, 35) & (F.col("ce_rank") <= 26)
    prior = F.coalesce(rrf_weight / (rrf_k + F.col("rrf_rank")), F.lit(0.0))
    score = ce_weight / (rrf_k + F.col("ce_rank")) + prior + F.when(middle, 3 / (rrf_k + F.col("ce_rank"))).otherwise(F.lit(0.0))
    return df.withColumn("fused_score", F.round(score, 9))


def shortlist(df: DataFrame, top_n: int = 50, preserve: int = 12, head: int = 12) -> DataFrame:
    """The top_n by fused score; must-keep rows replace the lowest others, and the prior's head comes first.

    df: entity_id, doc_id, rrf_rank, ce_rank, dense_rank, bm25_rank, fused_score. Must-keep: the
    first rows of the prior, then documents that both arms have in their first ten.
    """
    e = W.partitionBy("entity_id")
    keep_n = F.least(F.lit(preserve), F.lit(4 * top_n // 5), F.count(F.lit(1)).over(e))
    agree = F.greatest("dense_rank", "bm25_rank")
    both = F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull() & (agree <= 10)
    placed = df.withColumns({"__keep_n": keep_n, "__agree": F.when(both, agree)})
    placed = placed.withColumn("__kept", F.coalesce(F.col("rrf_rank") <= F.col("__keep_n"), F.lit(False)))
    extra = both & ~F.col("__kept")
    placed = placed.withColumn("__turn", F.row_number().over(W.partitionBy("entity_id", extra).orderBy("__agree", "doc_id")))
    must = F.col("__kept") | (extra & (F.col("__turn") <= max(1, min(10, top_n // 4))))
    placed = placed.withColumns({"__must": must, "__at": F.row_number().over(e.orderBy(F.desc("fused_score"), "doc_id"))}).withColumn("__in", F.col("__at") <= top_n)
    missing, spare = F.col("__must") & ~F.col("__in"), F.col("__in") & ~F.col("__must")
    placed = placed.withColumn("__m", F.least(F.sum(missing.cast("int")).over(e), F.sum(spare.cast("int")).over(e)))
    placed = placed.withColumns({"__let": F.row_number().over(W.partitionBy("entity_id", missing).orderBy("rrf_rank", "__agree", "doc_id")), "__out": F.row_number().over(W.partitionBy("entity_id", spare).orderBy("fused_score", F.desc("doc_id")))})
    kept = placed.filter((F.col("__in") & ~(spare & (F.col("__out") <= F.col("__m")))) | (missing & (F.col("__let") <= F.col("__m"))))
    first = F.when(F.col("rrf_rank") <= head, F.col("rrf_rank"))
    final = F.row_number().over(e.orderBy(F.asc_nulls_last(first), F.desc("fused_score"), "doc_id"))
    return kept.withColumn("final_rank", final).select(*df.columns, "final_rank")


def interleave_families(df: DataFrame, family: str = "family", rank: str = "rank", most_in_row: int = 3, part_rows: int = 256) -> DataFrame:
    """After most_in_row rows of one family, the next row of another comes first; nothing is dropped.

    Rows are read in order of rank. All that wait at a time are of one family, as the others go on
    at once: one that waits is let in after the next row of another family, up to most_in_row
    together. So the last family, how many of it came in a row, how many wait and how many were
    let in are all there is to carry. An entity's list (a shortlist, some dozens of rows) is one
    sorted array, folded in parts of part_rows. Tied ranks: by the other columns, which are comparable.
    """
    row = F.struct(F.col(rank).alias("__rank"), F.col(family).alias("__family"), F.struct(*df.columns).alias("__row"))
    listed = df.groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # turn: how many waiting rows come up to this one; one that waits comes before the row let in at once
    found = "array<struct<turn: bigint, at_once: boolean>>"
    none = lambda kind: F.array().cast(kind)
    state = lambda last, length, wait, let_in, out: F.struct(last.alias("last"), length.cast("bigint").alias("length"), wait.cast("bigint").alias("wait"), let_in.cast("bigint").alias("let_in"), out.alias("out"))

    def after_row(s: Column, x: Column) -> Column:
        same, busy = s["last"].eqNullSafe(x["__family"]), s["wait"] > 0
        held = same & (s["length"] >= most_in_row)
        freed = F.least(s["wait"], F.lit(most_in_row).cast("bigint"))
        note = F.struct(F.when(held, s["let_in"] + s["wait"] + 1).otherwise(s["let_in"]).alias("turn"), (~held).alias("at_once"))
        last = F.when(held | busy, s["last"]).otherwise(x["__family"])
        length = F.when(held, s["length"]).when(busy, freed).when(same, s["length"] + 1).otherwise(1)
        wait = F.when(held, s["wait"] + 1).otherwise(s["wait"] - freed)
        return state(last, length, wait, F.when(held, s["let_in"]).otherwise(s["let_in"] + freed), F.concat(s["out"], F.array(note)))

    def after_part(s: Column, part: Column) -> Column:
        read = F.aggregate(part, state(s["last"], s["length"], s["wait"], s["let_in"], none(found)), after_row)
        return F.get(F.transform(F.array(read), lambda t: state(t["last"], t["length"], t["wait"], t["let_in"], F.concat(s["out"], F.array(t["out"])))), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / part_rows).cast("int")), lambda i: F.slice("rows", i * part_rows + 1, F.lit(part_rows)))
    begin = state(F.lit(None).cast(df.schema[family].dataType), F.lit(0), F.lit(0), F.lit(0), none(f"array<{found}>"))
    noted = listed.withColumn("notes", F.flatten(F.aggregate(parts, begin, after_part, lambda s: s["out"])))
    placed = F.zip_with("rows", "notes", lambda x, n: F.struct(n["turn"].alias("turn"), n["at_once"].alias("at_once"), x.alias("x")))
    ordered = noted.select(F.array_sort(placed).alias("rows")).select(F.posexplode("rows").alias("at", "x"))
    kept = [(F.col("at") + 1).cast(df.schema[c].dataType).alias(c) if c == rank else F.col(f"x.x.__row.{c}") for c in df.columns]
    return ordered.select(*kept)


def rescue(fused: DataFrame, sums: DataFrame, top_n: int, slots: int) -> DataFrame:
    """Lets documents that the fused head lacks and the sum ranking has in its own into the last `slots` places.

    fused, sums: entity_id, doc_id, rank. Gives entity_id, final_rank, doc_id, rescued_via. The
    first top_n - slots fused rows stay; then come the rescued, then the fused rows that follow,
    then other documents of the sum ranking, then of the fused one. An entity without anything to
    rescue keeps its fused head as it is.
    """
    if slots < 0 or (slots >= top_n and top_n >= 20):
        raise ValueError("slots must be fewer than rows")
    e, core = W.partitionBy("entity_id"), top_n - (0 if slots >= top_n else slots)
    head = fused.filter(F.col("rank") <= top_n).select("entity_id", "doc_id")
    absent = sums.join(head, ["entity_id", "doc_id"], "left_anti")
    lost = absent.filter(F.col("rank") <= top_n).withColumn("__turn", F.row_number().over(e.orderBy("rank", "doc_id"))).filter(F.col("__turn") <= top_n - core)
    row = lambda df, source, via: df.select("entity_id", "doc_id", source.alias("__source"), F.col("rank").alias("__by"), F.lit(via).cast("string").alias("rescued_via"))
    place = F.when(F.col("rank") <= core, 0).when(F.col("rank") <= top_n, 2).otherwise(4)
    rest = absent.join(lost.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti")
    every = row(fused, place, None).unionByName(row(lost, F.lit(1), "sum")).unionByName(row(rest, F.lit(3), "sum"))
    rescued = lost.select("entity_id").distinct().withColumn("__any", F.lit(True))
    # one row a document, its best source; entities without a rescue have fused rows only
    best = every.join(rescued, "entity_id", "left").filter(F.col("__any") | F.col("__source").isin(0, 2))
    best = best.withColumn("__n", F.row_number().over(W.partitionBy("entity_id", "doc_id").orderBy("__source", "__by"))).filter("__n = 1")
    ranked = best.withColumn("final_rank", F.row_number().over(e.orderBy("__source", "__by", "doc_id")))
    return ranked.filter(F.col("final_rank") <= top_n).select("entity_id", "final_rank", "doc_id", "rescued_via")


def stage_ranks(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One rank column per stage (each: keys, rank), and the deepest stage that still has the row."""
    out = None
    for name, df in stages.items():
        one = df.groupBy(*keys).agg(F.min("rank").alias(f"{name}_rank"))
        out = one if out is None else out.join(one, keys, "full_outer")
    deepest = F.lit(None).cast("string")
    for name in stages:
        deepest = F.when(F.col(f"{name}_rank").isNotNull(), F.lit(name)).otherwise(deepest)
    return out.withColumn("deepest", deepest)


def unique_ranked(df: DataFrame, by: str, code: str, text_key: str, rank: str, n: int) -> DataFrame:
    """Best row of each code, then of each text, renumbered up to n."""
    one = df.withColumn("__c", F.row_number().over(W.partitionBy(by, code).orderBy(rank))).filter("__c = 1")
    two = one.withColumn("__t", F.row_number().over(W.partitionBy(by, text_key).orderBy(rank))).filter("__t = 1")
    return two.withColumn("new_rank", F.row_number().over(W.partitionBy(by).orderBy(rank))).filter(F.col("new_rank") <= n).drop("__c", "__t")


def insert_at(df: DataFrame, new: DataFrame, at: int, keep: int) -> DataFrame:
    """Puts new rows (entity_id, doc_id, turn) at a rank, moves the rest down, and notes what is added, kept or dropped."""
    added = new.join(df.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti")
    added = added.withColumn("rank", at - 1 + F.row_number().over(W.partitionBy("entity_id").orderBy("turn", "doc_id"))).select("entity_id", "doc_id", "rank", F.lit("added").alias("action"))
    k = added.groupBy("entity_id").agg(F.count(F.lit(1)).alias("__k"))
    moved = df.join(k, "entity_id", "left").withColumn("rank", F.col("rank") + F.when(F.col("rank") >= at, F.coalesce("__k", F.lit(0))).otherwise(0))
    rows = added.unionByName(moved.select("entity_id", "doc_id", "rank", F.lit("kept").alias("action")))
    return rows.withColumn("action", F.when(F.col("rank") > keep, "dropped").otherwise(F.col("action")))


def first_by_priority(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows by source priority and place, renumbered."""
    return df.withColumn("new_index", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("new_index") <= n)


def rank_deltas(stages: DataFrame, names: list[str]) -> DataFrame:
    """Adds <b>_delta for each stage after the first: how many places a row rose since the stage before (null where it lacks either)."""
    return stages.withColumns({f"{b}_delta": F.col(f"{a}_rank") - F.col(f"{b}_rank") for a, b in zip(names, names[1:], strict=False)})


def lost_at(gold: DataFrame, stages: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """gold's rows with the stage ranks of each and the first stage that lacks it; null if all have it."""
    met = gold.select(*keys).distinct().join(stages, keys, "left")
    lost = F.lit(None).cast("string")
    for name in reversed(names):
        lost = F.when(F.col(f"{name}_rank").isNull(), F.lit(name)).otherwise(lost)
    return met.withColumn("lost_at", lost)


def ordered_union(lists: list[DataFrame], keys: list[str], rank: str = "rank") -> DataFrame:
    """Rows of all lists (entity_id first among keys), list by list in order of rank; a row that several have counts where it first comes."""
    out = None
    for place, df in enumerate(lists):
        one = df.select(*keys, F.struct(F.lit(place).alias("p"), F.col(rank).alias("r")).alias("__at"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy(*keys).agg(F.min("__at").alias("__at"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(keys[0]).orderBy("__at", *keys[1:]))).drop("__at")


def sum_ranks(pool: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """entity_id, doc_id, sum_rank: the stored ranks where at least 3 and a quarter of an entity's rows have one, else those rebuilt.

    pool: entity_id, doc_id, rrf_rank; rebuilt: entity_id, doc_id, score of the plain sum.
    """
    stored = F.when(F.col("rrf_rank") > 0, F.col("rrf_rank"))
    enough = pool.groupBy("entity_id").agg((F.count(stored) >= F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) / 4))).alias("__stored"))
    e = W.partitionBy("entity_id")
    kept = pool.join(enough.filter("__stored"), "entity_id", "left_semi").filter("rrf_rank > 0").select("entity_id", "doc_id", F.row_number().over(e.orderBy("rrf_rank", "doc_id")).alias("sum_rank"))
    made = rebuilt.join(enough.filter("NOT __stored"), "entity_id", "left_semi").select("entity_id", "doc_id", F.row_number().over(e.orderBy(F.desc("score"), "doc_id")).alias("sum_rank"))
    return kept.unionByName(made)
