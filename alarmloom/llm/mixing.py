"""Sources mixed to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order and may be gone through three
times. A copy's virtual finish time is the number of the source's words up to its
end, divided by the source's target; all copies are sorted by it and taken until
the budget is used up. Nothing else decides what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, join_spread, prefix_sums, row_hash, temp_names

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def items(docs: DataFrame, key: str) -> DataFrame:
    """Equal rows of ``docs`` as one item with the number of them; ``key`` names their hash."""
    sized = docs.select("doc_id", "source", row_hash(docs).alias(key), word_count().alias("size"))
    return sized.groupBy("doc_id", "source", key).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))


def targets(sizes: DataFrame) -> DataFrame:
    """Target of each source: ``sizes`` has a row a source with ``source`` and ``source_size``.

    Sources weigh 1, 2, 3, repeating, by code point, null last, and share the sum
    of all sizes. A target stops at three times its source's size, and what is over is
    shared anew. With the sources in the order of the level at which each stops, the
    level that uses the budget up is the largest of those that hold if the sources
    so far have stopped; so one window gives what sharing again and again would.
    All sources go through one task: a mix names a weight for each, so they are few.
    """
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") - 1) % len(WEIGHTS) + 1).cast("double")
    cap = (F.col("source_size") * MOST_COPIES).cast("double")
    all_rows = Window.orderBy("stop", "source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("stop", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("stop", "source_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by_rank = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("source_start", F.coalesce(F.sum("source_size").over(by_rank), F.lit(0)))
        .withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
        .withColumn("best", F.max("level").over(all_rows))
    )
    return levels.select("source", "source_size", "source_rank", "source_start", "budget", F.least(F.col("cap"), F.col("best") * F.col("weight")).alias("target"))


ORDER = ("finish", "place", "doc_id", "row_key", "copy", "epoch")


def finish(epoch: Column, copy: Column) -> Column:
    """Virtual time at which a row's copy ends: the words of its source up to there over the source's target."""
    words = epoch * F.col("source_size") + F.col("within") + (copy + 1) * F.col("size")
    return words.cast("double") / F.col("target")


def mix(docs: DataFrame) -> DataFrame:
    """``items`` of ``docs`` (their hash as row_key) with source_size, target, and ``taken_copies``: how often each of the item's rows is taken.

    Every row has three places in the queue, one for each time its source is gone
    through; equal rows stand one behind another with a place each. The order of a
    source's documents follows from the hash of doc_id, so reruns agree. All
    copies are sorted by their finish times, over all sources, and taken up to
    the budget. When every source has just met its target, the words taken make
    up the budget; so a source falls short of its target by less than a document,
    and shares with the others what such shortfalls leave over.
    Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is
    a document. Sources of size 0 have target 0 and take nothing. An empty table gives no rows.
    """
    all_items = items(docs, "row_key")
    sources = targets(all_items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")))
    joined = all_items.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("i.*", *(f"s.{c}" for c in sources.columns if c != "source"))
    shuffled = joined.withColumn("place", F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))))
    order = [F.col(c) for c in ("source_rank", "place", "doc_id", "row_key")]
    summed = prefix_sums(shuffled, order, {"so_far": F.col("size") * F.col("rows")}).withColumn("within", F.col("so_far") - F.col("source_start"))
    waiting = summed.where(F.col("target") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    waiting = waiting.withColumn("epoch", F.explode(F.array(*map(F.lit, range(MOST_COPIES)))))
    queue = waiting.select(finish(F.col("epoch"), F.col("copy")).alias("finish"), *ORDER[1:], "size", "budget")
    sums = prefix_sums(queue, [F.col(c) for c in ORDER], {"used": F.col("size")})
    last = sums.where(F.col("used") + F.col("size") <= F.col("budget")).agg(F.max(F.struct(*ORDER)).alias("last")).first()["last"]  # one row
    places = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)
    if last is None:
        counts = F.transform(places, lambda c: F.lit(0))
    else:
        kinds = dict(queue.dtypes)
        bound = F.struct(*(F.lit(last[c]).cast(kinds[c]).alias(c) for c in ORDER))
        epochs = F.array(*map(F.lit, range(MOST_COPIES)))

        def reached(copy: Column, epoch: Column) -> Column:
            own = F.struct(finish(epoch, copy).alias("finish"), *(F.col(c) for c in ORDER[1:4]), copy.alias("copy"), epoch.alias("epoch"))
            return (F.col("target") > 0) & (own <= bound)

        counts = F.transform(places, lambda c: F.size(F.filter(epochs, lambda e: reached(c, e))))
    return summed.select("doc_id", "source", "row_key", "size", "rows", "source_size", "target", counts.alias("taken_copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: its size, its source's size and target, and the words taken of it.

    A null text has size 0, a null source is one of its own, a null doc_id is a document; equal rows have a row each, an empty table
    gives none. Texts of any length are counted whole; other columns are not looked at.
    """
    rows = mix(docs.select("doc_id", "source", "text")).withColumn("copies", F.explode("taken_copies"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``.

    A text of any length is counted whole and moved only where equal rows must be told
    apart. Rows equal in all columns are taken together; of what their number does not
    divide, one stands for the rest. Columns of ``docs`` may have any names.
    """
    key, taken, n, copies, there = temp_names(docs, "mix_key", "mix_taken", "mix_rows", "mix_copies", "mix_there")
    total = F.aggregate("taken_copies", F.lit(0).cast("long"), lambda a, x: a + x)
    counted = checkpointed(mix(docs).select(F.col("row_key").alias(key), total.alias(taken), F.col("rows").alias(n)).groupBy(key).agg(F.sum(taken).alias(taken), F.sum(n).alias(n)).where(F.col(taken) > 0))
    columns = columns_of(docs)
    keyed = docs.withColumn(there, row_hash(docs))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn(copies, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*columns)

    joined = join_spread(keyed, counted, there, key)
    out = repeated(joined, F.floor(F.col(taken) / F.col(n)))
    rest = counted.where(F.col(taken) % F.col(n) > 0)
    if rest.isEmpty():
        return out
    one = keyed.join(rest, F.col(there) == F.col(key)).dropDuplicates([there])
    return out.unionByName(repeated(one, F.col(taken) % F.col(n)))


#: The same mix in SQL, for tables whose rows differ in doc_id.
MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((source_rank - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
         (3 * source_size)::DOUBLE / ((source_rank - 1) % 3 + 1)::DOUBLE AS stop
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS budget,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY stop, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY stop, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, budget, least(cap, (max(level) OVER ()) * weight) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.source, d.size, d.place, t.source_size, t.budget, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS within
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT p.*, e.epoch, (e.epoch * source_size + within + size)::DOUBLE / target AS finish
  FROM placed p CROSS JOIN (VALUES (0), (1), (2)) e(epoch)
  WHERE target > 0
), queued AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM copies
), taken AS (
  SELECT doc_id, count(*) AS copies FROM queued WHERE used <= budget GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(t.copies, 0))::BIGINT AS taken, p.source, coalesce(t.copies, 0)::INTEGER AS copies
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id
"""
