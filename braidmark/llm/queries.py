"""The registered queries of this subpackage, and their oracle SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidmark.llm import bpe, dedup_substring, licenses, minhash, mixing, ngram_join, oracles, periodic, pii, quality, repair, tokens, topk, urls
from braidmark.llm.store import settle
from braidmark.session import table

URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]
#: Every name of a junk host in the given tables of pages; their pages stand in for a feed from outside.
JUNK_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    failed = settle(quality.failures(quality.measure(docs)).drop("text"), "quality")
    judged = quality.judge(failed, quality.host_verdicts(failed))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_topk_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantised = settle(topk.quantise(table(spark, sf_dir, "embeddings")), "quantised")
    return topk.top_k(quantised, quantised.filter("vec_id % 20 = 0"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = lambda df: settle(df.drop("text"), "mixing")
    return mixing.mix_sources(docs, settle=slim).select("doc_id", "source", "mix_pass", "mix_block", "mix_block_pos", "mix_order", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"))


def op9_url_filter(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = JUNK_NAMES) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, urls.feed_of(pages, list(names)), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"), settle).drop("all_spans")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs)).drop("paragraphs")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), order=periodic.planted_repeats)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules,
    op2_topk_bit_sliced,
    op3_substring_dedup,
    op4_token_counts,
    op5_mixing,
    op6_byte_bpe,
    op7_pii,
    op8_ngram_jaccard,
    op9_url_filter,
    op10_license_scan,
    op11_conversation_repair,
    op12_periodic_runs,
    op13_minhash_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op1_quality_rules": oracles.OP1,
    "op2_topk_bit_sliced": oracles.OP2,
    "op3_substring_dedup": oracles.OP3,
    "op8_ngram_jaccard": oracles.OP8,
    "op9_url_filter": oracles.op9(JUNK_NAMES),
    "op11_conversation_repair": oracles.OP11,
    "op13_minhash_dedup": oracles.OP13,
}
