"""Parts that several operators share: the shared folder, keys of rows, global prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

PARTITION = "__part"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Without that setting a local
    session gets a folder of its own; on a cluster no folder of one machine would do,
    so that raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="alarmloom-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; it finds out when the driver's memory is swept."""
    gc.collect()
    spark._jvm.System.gc()


class Stored:
    """Frames written in the shared folder that are given up one by one, for loops that outgrow what they stored."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
        self.count = 0
        self.held: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as stored. What stood under ``name`` before, and may be read to write ``df``, is deleted behind it."""
        path, self.count = f"{self.base}/{self.count}", self.count + 1
        df.write.parquet(path)
        self.drop(name)
        self.held[name] = path
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        if name in self.held:
            remove(self.spark, self.held.pop(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def temp_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed until no column of ``df`` has one of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def numbered(df: DataFrame, *named: str) -> tuple[DataFrame, list[StructField]]:
    """``df`` with its columns called c0, c1, ... but for those ``named``, and their fields: Arrow batches and schemas need plain names."""
    plain = [c if c in named else f"c{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*plain), [StructField(n, f.dataType, f.nullable) for n, f in zip(plain, df.schema)]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, by which equal rows are equal; maps, which have no hash, as JSON."""
    parts = [F.to_json(F.struct(column(f.name))) if "map<" in f.dataType.simpleString() else column(f.name) for f in df.schema]
    return F.xxhash64(*parts)


def join_spread(big: DataFrame, small: DataFrame, key: str, small_key: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, whose ``small_key`` is unique, though many rows of ``big`` may have one key.

    A key with more rows than half a partition's even share goes to all tasks, so its rows
    stay where they are; there are at most twice as many such keys as partitions, which bounds
    the broadcast. All other keys are joined by a shuffle. ``big`` is read four times, so it
    should be stored or a table; ``how`` is inner or left.
    """
    held, is_hot = temp_names(big, *temp_names(small, "hot_key", "is_hot"))
    most = big.count() // (2 * shuffle_partitions(big.sparkSession)) + 1
    counts = big.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(held)).agg(F.count(F.lit(1)).alias(is_hot))
    hot = counts.where(F.col(is_hot) > most).select(held)
    known = hot.join(small, F.col(held) == F.col(small_key), how).withColumn(is_hot, F.lit(True))
    near = big.join(F.broadcast(known), F.col(key) == F.col(held), "left").where(is_hot).drop(held, is_hot)
    far = big.join(F.broadcast(hot), F.col(key) == F.col(held), "left_anti").join(small, F.col(key) == F.col(small_key), how)
    return near.unionByName(far)


#: Rows of 64 bits in a map of keys.
MAP_ROWS = 1 << 16


def likely_rows(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``wanted_key`` of ``wanted``: all that are, and few others while
    those are few, so that wide rows need not be shuffled to be looked up.

    What is broadcast is a map of 64 * MAP_ROWS bits, whatever the number of keys.
    """
    row, bits = temp_names(df, "map_row", "map_bits")

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(64 * MAP_ROWS))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(wanted_key).cast("int"))  # a shift looks at the last six bits
    bit_map = wanted.groupBy(F.shiftright(place(wanted_key), 6).alias(row)).agg(F.bit_or(bit).alias(bits))
    joined = df.join(F.broadcast(bit_map), F.shiftright(place(key), 6) == F.col(row))  # MAP_ROWS rows at most
    held = F.call_function("shiftrightunsigned", F.col(bits), place(key).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return joined.where(held).drop(row, bits)


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, each range in one partition numbered in PARTITION, stored.

    The bounds of the ranges come from a sample, so two runs may differ in them;
    storing the rows with their range number makes every later step see one choice.
    """
    n = shuffle_partitions(df.sparkSession)
    return checkpointed(df.repartitionByRange(n, *order).withColumn(PARTITION, F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds for each name of ``values`` the sum of that value over all rows before this one in
    ``order``, and as ``<name>_total`` the sum over all rows.

    Rows are dealt out by ranges of ``order``; totals of each range (a row a
    partition, so as many as there are partitions) are summed up in order and
    joined back, and a window inside each range does the rest. No task holds more
    than one range. ``order`` should tell all rows apart; rows it does not tell
    apart get sums in either order.
    """
    base = ranged(df, order)
    totals = base.groupBy(PARTITION).agg(*(F.sum(v).alias(f"__sum_{k}") for k, v in values.items()))
    before = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        PARTITION,
        *(F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in values),
        *(F.sum(f"__sum_{k}").over(everywhere).alias(f"{k}_total") for k in values),
    )
    inside = Window.partitionBy(PARTITION).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition: the number of partitions bounds what is broadcast
    joined = base.join(F.broadcast(starts), PARTITION)
    sums = {k: (F.col(f"__base_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in values.items()}
    return joined.select(*df.columns, *sums.values(), *(f"{k}_total" for k in values))
