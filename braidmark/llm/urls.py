"""URL filters (native): longest rule, then a list of canonical URLs behind a blocked Bloom filter.

The list's canonical URLs set bits in a blocked Bloom filter: the hash names one 64-bit block
and a few bits in it. A URL whose bits are all set is a possible hit and goes on to the exact
hash join with the list, which removes the false positives; every other URL skips that join.
The filter is packed into rows of 1024 blocks and has `MOST_BLOCKS` of them (8 MB) at most, however
long the list, so it is sent to all tasks and pages are not shuffled to be asked. A longer list
fills it up: more URLs go on to the exact join, the results stay the same. Only possible hits take
part in the exact join; for that the pages are read once more.

Defined results: of rules that tie in length the last by name counts; URLs of any length are judged whole; a null URL or one without `://` has an empty host and path, fits no rule, is
in no list and is allowed; repeated rows are judged row by row; an empty list blocks nothing;
extra columns pass through `judge_urls` (its own columns host, path, rule, verdict, canonical
replace those of the same name).
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mirrors of a site share its canonical URL.
MIRRORS = r"^(www|m)\."
PAGE_ENDING = r"(/index)?(\.html?)?/*$"
#: Blocks (of 64 bits) that a filter has at most, and those in one of its rows.
MOST_BLOCKS = 1 << 20
ROW_BLOCKS = 1024


@dataclass(frozen=True)
class Rule:
    """verdict for the host, all its subdomains, and paths with this beginning."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without its mirror's label, path without its page ending; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, MIRRORS, ""), F.regexp_replace(path, PAGE_ENDING, "")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column, n_bits: int) -> Column:
    """The key's bits inside its block."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("bigint")
    for i in range(n_bits):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks).cast("bigint"))


def bloom_filter(keys: DataFrame, key: str, n_blocks: int, n_bits: int = 5) -> DataFrame:
    """__row, __masks: the masks of blocks 1024 * __row on, in order; 0 for a block without a key."""
    own = keys.select(_block(F.col(key), n_blocks).alias("b"), _bits(F.col(key), n_bits).alias("m"))
    every = keys.sparkSession.range(n_blocks).select(F.col("id").alias("b"), F.lit(0).cast("bigint").alias("m"))
    masks = own.unionByName(every).groupBy("b").agg(F.bit_or("m").alias("m"))
    rows = masks.groupBy(F.floor(F.col("b") / ROW_BLOCKS).cast("bigint").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("l"))
    return rows.select("__row", F.col("l.m").alias("__masks"))


def blocks_for(n_keys: int, bits_per_key: int = 12) -> int:
    return min(MOST_BLOCKS, max(64, n_keys * bits_per_key // 64))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", n_blocks: int | None = None) -> DataFrame:
    """Adds host, path, canonical, rule, possible_hit and verdict.

    listed: one column, canonical (nulls and repeats do no harm). The rule's verdict holds;
    without a rule, a listed canonical URL is blocked and any other allowed.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    parsed = parsed.withColumns({"canonical": canonical(F.col("host"), F.col("path")), "__rule": rule_of(F.col("host"), F.col("path"), rules)})
    keys = listed.select(F.col("canonical").alias("__listed")).filter("__listed IS NOT NULL").distinct()
    n_blocks = n_blocks or blocks_for(keys.count())
    filled = bloom_filter(keys, "__listed", n_blocks)
    # a URL that a rule decides needs no look-up
    asks = F.when(F.col("__rule").isNull(), F.col("canonical"))
    at = F.coalesce(_block(asks, n_blocks), F.lit(0).cast("bigint"))
    probed = parsed.withColumns({"__at": at, "__bits": _bits(asks, 5)})
    probed = probed.join(F.broadcast(filled), F.floor(F.col("__at") / ROW_BLOCKS).cast("bigint") == F.col("__row"), "left")  # MOST_BLOCKS of 8 bytes at most
    mask = F.get("__masks", F.pmod("__at", F.lit(ROW_BLOCKS)).cast("int"))
    possible = F.coalesce(mask.bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False)) & asks.isNotNull()
    probed = probed.withColumn("possible_hit", possible).drop("__at", "__bits", "__row", "__masks")
    exact = probed.filter("possible_hit").join(keys, F.col("canonical") == F.col("__listed"), "left")
    exact = exact.unionByName(probed.filter("NOT possible_hit").withColumn("__listed", F.lit(None).cast("string")))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__listed").isNotNull(), "block").otherwise("allow"))
    return exact.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__rule", "__listed")


def feed_of(pages: DataFrame, labels: list[str], url: str = "url") -> DataFrame:
    """canonical: the URLs of pages whose host has one of the given names among its labels."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    return pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))).select(canonical(host, path).alias("canonical"))
