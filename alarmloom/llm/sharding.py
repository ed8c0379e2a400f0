"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, prefix_sums, temp_names, text_of

LAW = "bytes"


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id with the size and checksum of its text: all that sharding needs of a document."""
    body = text_of()
    return docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
    )


def balanced_shards(sized: DataFrame, n_shards: int = 16) -> DataFrame:
    """Puts rows with ``doc_id``, ``size`` and ``text_hash`` into ``n_shards`` contiguous shards.

    Rows stand in the order of doc_id (nulls first), then text_hash; the shard of
    a row is where the middle of its bytes falls among ``n_shards`` equal targets,
    so shard sizes differ from the target by at most one document. Adds ``shard``
    and ``slot``, its number in the shard. Equal rows stand side by side in
    either order; an empty table gives an empty result. A range of the order may
    split the rows of one doc_id, so a doc_id that many rows share is no hot spot.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    summed = prefix_sums(sized, order, {"bytes_before": F.col("size"), "rows_before": F.lit(1)})
    placed = summed.withColumn("shard", F.expr(f"least({n_shards - 1}, ({n_shards} * (2 * bytes_before + size)) div (2 * bytes_before_total))").cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rows_before") - F.col("first_row"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row a document with its shard and slot. A null text has size 1 and the checksum of no bytes."""
    return balanced_shards(with_sizes(docs), n_shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Writes the documents as Parquet below ``path``, a folder ``__shard=N`` for each shard.

    Rows with the same doc_id and text are alike, so they go to one of their places. Null doc_ids and texts
    are documents like others, long texts too; an empty table writes no shard. Columns of ``docs`` may have any names (one
    named __shard stays, the folders' name then ends in another _).
    """
    shard, place, text_hash, doc_id, placed_hash, key, placed_key = temp_names(docs, "__shard", "place", "own_hash", "placed_doc", "placed_hash", "own_key", "placed_key")
    placed = balanced_shards(with_sizes(docs), n_shards).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(placed_hash), "shard", "slot")
    places = placed.groupBy(doc_id, placed_hash).agg(F.min(F.struct("shard", "slot")).alias(place)).withColumn(placed_key, F.xxhash64(doc_id, placed_hash))
    tagged = docs.withColumn(text_hash, F.xxhash64(text_of())).withColumn(key, F.xxhash64("doc_id", text_hash))
    same = (F.col(key) == F.col(placed_key)) & F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(text_hash) == F.col(placed_hash))
    joined = tagged.join(places, same).select(*columns_of(docs), F.col(f"{place}.shard").alias(shard))
    joined.write.mode("overwrite").partitionBy(shard).parquet(path)
