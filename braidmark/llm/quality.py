"""Host-level quality rules (native).

Each document is measured by column expressions alone. Rule failures are added up per host
(partial sums, so one hot host costs no single task its rows), the host's failure rate is
shrunk by a beta prior fitted to all hosts by moments, and the host's verdict is joined back: a
host is bad if its shrunk rate lies more than host_z of the prior's standard deviations above the
prior's mean, or above host_rate at all. Documents of a bad host are held to the strict limits,
all others to the lenient ones.

Defined results: texts of any length are measured whole; hosts that tie have the same verdict; a null text counts as empty (no words, so it fails the word minimum); a null
host is a host of its own; repeated rows are judged row by row; extra columns pass through
`judge` untouched except those it adds; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Base rules, and the lenient and strict limits of the method's verdict (shares in per cent)."""

    min_words: int = 50
    max_repeat_pct: int = 50
    symbol_pct: int = 20
    symbol_pct_strict: int = 15
    dup_line_pct: int = 50
    dup_line_pct_strict: int = 30
    host_rate: float = 0.5
    host_z: float = 1.0
    least_strength: float = 2.0
    most_strength: float = 1000.0


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, body) -> Column:
    """Binds a value, so that lambdas inside body don't compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _adjacent_equal(ordered: Column, key) -> Column:
    """The elements of a sorted array whose key equals a neighbour's."""
    return F.filter(
        ordered,
        lambda x, i: (key(x) == key(F.get(ordered, i - 1))) | (key(x) == key(F.get(ordered, i + 1))),
    )


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array.

    Windows are first compared by 33 bits of their hash packed above their position in one
    long, which sorts fast; only windows that share those bits are compared as strings.
    """
    position = F.lit((1 << 31) - 1).cast("bigint")
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    packed = F.transform(
        starts,
        lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("bigint")),
    )
    near = let(F.sort_array(packed), lambda s: _adjacent_equal(s, lambda x: F.shiftright(x, 31)))
    spelled = F.transform(
        near,
        lambda x: let(
            x.bitwiseAND(position).cast("int"),
            lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
        ),
    )
    same = let(F.sort_array(spelled), lambda s: _adjacent_equal(s, lambda x: x["w"]))
    found = F.sort_array(F.transform(same, lambda x: x["i"]))
    steps = let(found, lambda q: F.zip_with(q, F.slice(q, 2, F.greatest(F.size(q), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.size(words) >= 3, covered).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counts = let(words_of(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("d")))
    out = docs.withColumns(
        {
            "__w": counts,
            "__l": line_counts,
            "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        }
    )
    return out.withColumns(
        {"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r"), "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.n") - F.col("__l.d")}
    ).drop("__w", "__l")


def failures(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds base_failed, and soft_failed and strict_failed for the method's own rules."""

    def soft(symbols: int, lines: int) -> Column:
        return (F.col("n_symbols") * 100 > F.col("word_chars") * symbols) | (F.col("n_dup_lines") * 100 > F.col("n_lines") * lines)

    return measured.withColumns(
        {
            "base_failed": (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_pct),
            "soft_failed": soft(limits.symbol_pct, limits.dup_line_pct),
            "strict_failed": soft(limits.symbol_pct_strict, limits.dup_line_pct_strict),
        }
    )


def host_verdicts(failed: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_bad: one row per host.

    The prior has the hosts' mean rate, and the strength that their variance gives, kept
    between least_strength and most_strength.
    """
    bad = (F.col("base_failed") | F.col("soft_failed")).cast("bigint")
    per_host = failed.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = per_host.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(limits.most_strength))
    prior = moments.select("m", F.greatest(F.lit(limits.least_strength), F.least(F.lit(limits.most_strength), strength)).alias("k"))
    # one row: the two moments of all hosts
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    limit = F.least(F.lit(limits.host_rate), F.col("m") + limits.host_z * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("k") + 1)))
    # rounded, so that equal hosts tie whatever the order of sums
    return (
        per_host.join(F.broadcast(prior), F.lit(True))
        .withColumns({"shrunk_rate": F.round(shrunk, 9), "__limit": F.round(limit, 9)})
        .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") > F.col("__limit")).alias("host_bad"))
    )


def judge(failed: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Adds kept: false for base failures, else by the limits that the host's verdict calls for.

    Only bad hosts are joined, as an anti-join-sized table; an equality join that Spark
    broadcasts by its measured size and whose hot key adaptive execution splits otherwise.
    """
    bad = hosts.filter("host_bad").select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    joined = failed.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    verdict = F.when(F.coalesce(F.col("__bad"), F.lit(False)), ~F.col("strict_failed")).otherwise(~F.col("soft_failed"))
    return joined.withColumn("kept", ~F.col("base_failed") & verdict).drop("__host", "__bad")
