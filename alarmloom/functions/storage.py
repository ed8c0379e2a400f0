"""Frames stored between steps, so that plans stay short and lost executors cost no more than one step."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without that setting a local session gets a folder of its own; on a cluster no folder of one machine would do.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="alarmloom-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    system, held = place(spark, path)
    system.delete(held, True)


def stored_then_removed(df: DataFrame, path: str) -> DataFrame:
    """``df`` stored; the folder it was read from goes."""
    out = stored(df)
    remove(df.sparkSession, path)
    return out


#: Bytes of a file that are digested together, and groups of a folder's files.
CHUNK, GROUPS = 64 << 20, 256


def place(spark: SparkSession, path: str):
    """A path and the file system that holds it, whichever Spark can write."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def content_digest(spark: SparkSession, path: str) -> str:
    """A digest of a file, or of all data files of a folder with their names, wherever Spark can read them.

    A tree: chunks of CHUNK bytes, files, groups of files, all. It does not depend on how files are dealt to tasks. A task
    holds one file, which Spark reads up to 2 GB; a folder without files has the digest of none.
    """
    system, held = place(spark, path)
    if not system.exists(held):
        raise FileNotFoundError(path)
    root = system.makeQualified(held).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("length") / CHUNK) - 1).cast("long"))
    chunks = F.transform(starts, lambda i: F.sha2(F.substring(F.col("content"), (i * CHUNK + 1).cast("int"), F.lit(CHUNK)), 256))
    name = F.element_at(F.split("path", root, 2), 2) if system.getFileStatus(held).isDirectory() else F.lit("")
    lines = files.select(name.alias("name"), F.sha2(F.array_join(chunks, ""), 256).alias("digest")).withColumn("line", F.concat_ws(":", "name", "digest"))
    groups = lines.groupBy(F.pmod(F.xxhash64("name"), F.lit(GROUPS)).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
    return groups.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.format_string("%03d", "g"), "digest"))), "\n"), 256)).first()[0]  # a row a group
