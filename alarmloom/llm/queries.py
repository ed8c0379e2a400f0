"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, store_media

    return media_features(store_media(table(spark, sf_dir, "documents")))


def op2_spliced_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op3_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary
    from .packing import first_line, pack_documents, packed_digests

    return packed_digests(pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, prompt=first_line))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op6_fair_queue_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_perfect_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary
    from .token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op9_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import component_ids

    return component_ids(table(spark, sf_dir, "documents"))


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op11_pair_naming_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import top_phrases

    return top_phrases(table(spark, sf_dir, "documents"), least=30, longest=4, first=2000)


def op12_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import component_report

    return component_report(table(spark, sf_dir, "documents"))


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), count=8, rounds=10)


NUMBERED = (
    op1_jpeg_media,
    op2_spliced_token_counts,
    op3_trigram_secret_scan,
    op4_vector_packing,
    op5_balanced_shards,
    op6_fair_queue_mixture,
    op7_importance_resampling,
    op8_perfect_hash_files,
    op9_anchor_simhash,
    op10_pivot_top_k,
    op11_pair_naming_phrases,
    op12_signature_join,
    op13_elkan_clusters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NUMBERED}


def oracle_sql() -> dict[str, str]:
    from .clustering import cluster_sql
    from .minhash import REPORT_SQL as COMPONENTS_SQL
    from .mixing import MIXTURE_SQL
    from .phrases import PHRASES_SQL
    from .secret_scan import REPORT_SQL
    from .topk import TOP_K_SQL

    return {
        "op3_trigram_secret_scan": REPORT_SQL,
        "op6_fair_queue_mixture": MIXTURE_SQL,
        "op10_pivot_top_k": TOP_K_SQL,
        "op11_pair_naming_phrases": PHRASES_SQL,
        "op12_signature_join": COMPONENTS_SQL,
        "op13_elkan_clusters": cluster_sql(),
    }
