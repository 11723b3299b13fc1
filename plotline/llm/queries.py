"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm import chat, checks, decontaminate, exact_copies, html_pages, jaccard_join, language_score, neighbours, pieces, prefix_trie, quality, ranked_search, secret_scan, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if check is not None:
            ORACLES[key] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_feistel_shards", checks.feistel_shards(16, sharding.round_keys(2024), sharding.MIX_A, sharding.MIX_B, sharding.MODULUS))
def feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"))
    return placed.select(
        F.col("key").alias("doc_id"), (F.col("octets") + 1).alias("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number",
    )


@query("op3_markov_secrets")
def markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs)).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


@query("op4_benchmark_windows", checks.BENCHMARK_WINDOWS)
def benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_piece_encoding")
def piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), lists=False).drop("text")


@query("op7_jaccard_classes", checks.JACCARD_CLASSES)
def jaccard_classes(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.classes(table(spark, folder, "documents"), words=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op5_partial_matching")
def partial_matching(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_score.score(table(spark, folder, "documents"), language_score.training())
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_kneser_ney_quality")
def kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(F.col("key").alias("doc_id"), "lang", "symbols", "perplexity", "threshold", "passage", "passage_threshold", "keep")


@query("op6_projected_neighbours")
def projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest(table(spark, folder, "embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), "score")


@query("op10_role_repair")
def role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repaired(table(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


@query("op1_page_differences")
def page_differences(spark: SparkSession, folder: str) -> DataFrame:
    found = html_pages.extract(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_restored")


@query("op11_radix_copies", checks.EXACT_COPIES)
def radix_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_copies.exact_copies(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op12_prefix_rollup", checks.PREFIX_TRIE)
def prefix_rollup(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_trie.prefix_trie(table(spark, folder, "conversations"))
    return found.withColumnRenamed("conv", "conv_id").withColumnRenamed("parent_conv", "parent_conv_id")


@query("op13_dual_tree_search", checks.RANKED_SEARCH)
def dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    found = ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
