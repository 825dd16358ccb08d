"""Mixing sources to target weights (native): temperature, budgets, block permutations.

A source with share p of all tokens gets weight p^a / sum(p^a). The exponent a is bisected
between 0 (all sources alike) and 1 (as they come) to the smallest that keeps every source's
number of passes within max_repeat, or to the one whose weights have target_entropy. The
budget is the least that gives every source one whole pass, so that no document is left out,
unless one is given.

Each source's documents are dealt by hash into blocks of about block_docs. A source with
weight w is read for w * budget / tokens passes: whole passes, then blocks in the order of a
permutation seeded by the pass until the rest of its budget is used; only in the block where
the budget ends are single documents put in order. No window covers more rows than a source
has blocks or a block has documents.

Tokens are words and one separator a document: tokenizers need Python, and this path uses
DataFrame functions only. Shares by words and by tokens differ as far as sources differ in tokens
a word; a table with a column of real counts may give it as `tokens`.

Defined results: a null source is a source of its own; documents are dealt and
put in order by doc_id, those of a null or repeated doc_id by their text too, and rows that also
repeat the text by their other columns and their number among equals, so that no order of arrival shows; texts of any length are counted whole; a null or empty text counts one token
(its separator), as every document does besides its words; repeated rows are dealt row by row;
extra columns pass through, but for those of the names in ADDED, which are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidmark.llm import store

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    max_repeat: float = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    block_docs: int = 1000
    seed: int = 17
    salts: int = 64
    rounds: int = 6
    fan: int = 16


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint") + 1


def source_totals(sized: DataFrame) -> DataFrame:
    """__key, docs, tokens: one row per source; partial sums come first."""
    return sized.groupBy("__key").agg(F.count(F.lit(1)).alias("docs"), F.sum("__tokens").alias("tokens"))


def measures_at(totals: DataFrame, exponents: list[float]) -> DataFrame:
    """For each exponent: the weights' entropy (nats), and most and least passes in proportion."""
    at = totals.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    raw = F.pow(F.col("tokens").cast("double"), F.col("a"))
    passes = F.pow(F.col("tokens").cast("double"), F.col("a") - 1)
    return at.groupBy("a").agg(
        (F.log(F.sum(raw)) - F.sum(raw * F.log(raw)) / F.sum(raw)).alias("entropy"),
        (F.max(passes) / F.min(passes)).alias("spread"),
        (F.max(passes) / F.sum(raw)).alias("most"),
    )


def find_exponent(totals: DataFrame, mix: Mix) -> float:
    """Section search on [0, 1]: each round measures `fan` exponents in one small aggregate.

    Both measures fall as the exponent grows, so the interval that holds the wanted exponent
    is known after each round; `rounds` rounds leave fan ** -rounds of it.
    """
    low, high = 0.0, 1.0
    for _ in range(mix.rounds):
        grid = [low + (high - low) * i / mix.fan for i in range(mix.fan + 1)]
        for row in measures_at(totals, grid).sort("a").collect():
            if mix.target_entropy is not None:
                met = row.entropy <= mix.target_entropy
            elif mix.budget is not None:
                met = row.most * mix.budget <= mix.max_repeat
            else:
                met = row.spread <= mix.max_repeat
            if met:
                high = row.a
                break
            low = row.a
        else:
            return 1.0
        if high <= 0.0:
            return 0.0
    return high


def plan_sources(totals: DataFrame, mix: Mix) -> DataFrame:
    """__key, weight, passes, n_blocks, full (whole passes), rest (tokens of the last pass)."""
    a = find_exponent(totals, mix)
    n = F.col("tokens").cast("double")
    sums = totals.agg(F.sum(F.pow(n, F.lit(a))).alias("total"), F.min(F.pow(n, F.lit(a - 1))).alias("least"))
    # without a given budget, the source with the fewest passes gets exactly one
    budget = F.lit(float(mix.budget)) if mix.budget is not None else F.col("total") / F.col("least")
    planned = totals.join(F.broadcast(sums), F.lit(True)).withColumn("weight", F.pow(n, F.lit(a)) / F.col("total"))
    planned = planned.withColumn("passes", F.round(F.col("weight") * budget / n, 9))
    full = F.floor("passes")
    return planned.select(
        "__key",
        "weight",
        "passes",
        F.ceil(F.col("docs") / mix.block_docs).alias("n_blocks"),
        full.cast("int").alias("full"),
        F.floor((F.col("passes") - full) * n).cast("bigint").alias("rest"),
    )


def repeated(thin: DataFrame) -> DataFrame:
    """__same, __n: how many rows have an id and text, for rows whose id is null or comes again."""
    texts = thin.groupBy("__id", "__same").agg(F.count(F.lit(1)).alias("__n"))
    ids = texts.filter("__id IS NOT NULL").groupBy("__id").agg(F.sum("__n").alias("__all")).filter("__all > 1").select("__id")
    named = texts.join(ids, "__id", "left_semi").unionByName(texts.filter("__id IS NULL"))
    return named.groupBy("__same").agg(F.sum("__n").alias("__n"))


def numbered(rows: DataFrame, at_once: int = 1000) -> DataFrame:
    """rows with __more, which differs from row to row, also between equal ones: those are counted, and as many rows made again in stretches of at_once."""
    counted = store.settle(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")), "mix-counted")
    # columns beside id and text count only where they tell rows apart
    counted = counted.join(counted.groupBy("__same").agg((F.count(F.lit(1)) > 1).alias("__differ")), "__same")
    stretches = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(at_once).cast("bigint")))).repartition(F.xxhash64("__same", "__from"))
    each = stretches.withColumn("__i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + at_once, F.col("__n")) - 1)))
    return each.withColumn("__more", F.xxhash64("__same", F.when(F.col("__differ"), F.to_json(F.struct(*rows.columns))), "__i")).drop("__n", "__from", "__i", "__differ")


ADDED = ("mix_pass", "mix_block", "mix_block_pos", "mix_order", "mix_tokens", "mix_weight")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text", settle=lambda df: df, tokens: str | None = None) -> DataFrame:
    """docs' rows, once for each pass that takes them.

    Adds mix_pass (from 1), mix_block, mix_block_pos (the block's place in that pass), mix_order
    (order inside the block), mix_tokens and mix_weight. settle may write the sized documents,
    which are read three times. Sizes, sources and blocks are written as tables of their own, so
    that Spark knows their size: while they are small, texts meet them without a shuffle.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    sized = settle(docs.drop(*ADDED).withColumns({"__key": key, "__tokens": F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)) + 1 if tokens else tokens_of(F.col(text)), "__same": F.xxhash64(doc_id, text)}))
    thin = store.settle(sized.select("__key", "__tokens", F.col(doc_id).alias("__id"), "__same"), "mix-sizes")
    totals = store.settle(source_totals(thin), "mix-totals")
    again = store.settle(repeated(thin), "mix-repeated")
    copies = store.settle(numbered(sized.join(again, "__same").filter("__n > 1").drop("__n")), "mix-copies")

    def told_apart(rows: DataFrame, own: DataFrame) -> DataFrame:
        once = rows.join(again, "__same", "left").filter("__n IS NULL OR __n = 1").withColumn("__more", F.when(F.col("__n") == 1, F.col("__same"))).drop("__n", "__same")
        return once.unionByName(own.drop("__same"))

    sized, thin = told_apart(sized, copies), told_apart(thin, copies.select("__key", "__tokens", F.col(doc_id).alias("__id"), "__same", "__more"))
    plan = plan_sources(totals, mix).select("__key", *(F.col(c).alias(f"__{c}") for c in ("weight", "n_blocks", "full", "rest")))
    # a hot source's rows meet its one planned row in `salts` places
    salted = store.settle(plan.withColumn("__salt", F.explode(F.array(*map(F.lit, range(mix.salts))))), "mix-plan")

    def dealt(rows: DataFrame, row_id: str) -> DataFrame:
        spread = rows.withColumn("__salt", F.pmod(F.xxhash64(row_id, "__more", F.lit("salt")), F.lit(mix.salts)).cast("int"))
        met = spread.join(salted, ["__key", "__salt"])
        return met.withColumn("mix_block", F.pmod(F.xxhash64(F.lit(mix.seed), F.col(row_id), F.col("__more")), F.col("__n_blocks"))).drop("__salt", "__n_blocks")

    blocks = dealt(thin, "__id").groupBy("__key", "mix_block").agg(F.sum("__tokens").alias("tokens"), F.max("__full").alias("full"), F.max("__rest").alias("rest"))
    blocks = blocks.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("full") + 1)))
    turn = F.xxhash64(F.lit(mix.seed), F.col("mix_pass"), F.col("mix_block"))
    order = W.partitionBy("__key", "mix_pass").orderBy(turn, "mix_block")
    placed = blocks.withColumns({"mix_block_pos": F.row_number().over(order), "__end": F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0))})
    room = F.when(F.col("mix_pass") <= F.col("full"), F.col("tokens")).otherwise(F.col("rest") - F.col("__end") + F.col("tokens"))
    # what of the budget is left when this block's turn comes; nothing: the block isn't read
    placed = placed.withColumn("__room", room).filter("__room > 0").select("__key", "mix_block", "mix_pass", "mix_block_pos", "__room", (F.col("__room") >= F.col("tokens")).alias("__whole"))
    placed = store.settle(placed, "mix-blocks")
    taken = dealt(sized, doc_id).join(placed, ["__key", "mix_block"]).withColumn("mix_order", F.xxhash64(F.lit(mix.seed + 1), F.col("mix_pass"), F.col(doc_id), F.col("__more")))
    inside = W.partitionBy("__key", "mix_block", "mix_pass").orderBy("mix_order", doc_id, "__more").rowsBetween(W.unboundedPreceding, 0)
    last = taken.filter("NOT __whole").withColumn("__so_far", F.sum("__tokens").over(inside)).filter("__so_far <= __room").drop("__so_far")
    out = taken.filter("__whole").unionByName(last)
    return out.withColumnsRenamed({"__tokens": "mix_tokens", "__weight": "mix_weight"}).drop("__key", "__full", "__rest", "__room", "__whole", "__more")
