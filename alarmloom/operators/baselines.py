"""Upper-tail thresholds from train episodes, for all machines together and for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import upper_place, upper_quantiles, values_at
from ..functions.scalars import ratio

METRICS = ("event_count", "duration_seconds", "distinct_alarm_count")
FIT_SPLIT = "train"


def fit_global(episodes: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row: thresholds over all train episodes."""
    train = episodes.where(F.col("split") == FIT_SPLIT).select(*METRICS)
    found = upper_quantiles(train, METRICS, quantile)
    if found is None:
        raise ValueError("there are no train episodes")
    kinds = ", ".join(f"{m}_threshold double" for m in METRICS)
    row = (float(quantile), FIT_SPLIT, train.count(), *(found[m] for m in METRICS))
    return episodes.sparkSession.createDataFrame([row], f"quantile double, fit_split string, incident_count long, {kinds}")


def fit_machines(episodes: DataFrame, quantile: float = 0.95, least: int = 200) -> DataFrame:
    """A row a machine with train episodes: its thresholds, and whether it has ``least`` episodes to support them."""
    if least < 1:
        raise ValueError("the least support must be above zero")
    train = episodes.where(F.col("split") == FIT_SPLIT).select("machine_id", *METRICS)
    found = values_at(train, ("machine_id",), tuple(upper_place(quantile, m, f"{m}_threshold") for m in METRICS))
    return found.withColumnRenamed("total", "incident_count").select(
        "machine_id", F.lit(float(quantile)).alias("quantile"), F.lit(FIT_SPLIT).alias("fit_split"), "incident_count", F.lit(least).cast("long").alias("minimum_incident_count"),
        (F.col("incident_count") >= least).alias("has_sufficient_support"), *(f"{m}_threshold" for m in METRICS),
    )


def apply_flags(episodes: DataFrame, overall: DataFrame, machines: DataFrame) -> DataFrame:
    """All episodes with the thresholds that hold for them and strict flags above these.

    A machine with enough support has its own thresholds; others have those of all
    machines. ``machines`` must name no machine twice; both tables have a row a machine at most.
    """
    one = overall.first()
    own = machines.select("machine_id", F.col("incident_count").alias("__n"), F.col("has_sufficient_support").alias("__own"), *(F.col(f"{m}_threshold").alias(f"__{m}") for m in METRICS))
    joined = episodes.join(own, "machine_id", "left")
    use = F.coalesce("__own", F.lit(False))
    out = joined.withColumn("baseline_scope", F.when(use, "machine").otherwise("global_fallback"))
    out = out.withColumn("machine_train_incident_count", F.coalesce("__n", F.lit(0)).cast("long"))
    out = out.withColumn("baseline_train_incident_count", F.when(use, F.col("__n")).otherwise(F.lit(one["incident_count"])).cast("long"))
    out = out.withColumn("baseline_quantile", F.lit(one["quantile"]))
    for m in METRICS:
        out = out.withColumn(f"{m}_threshold", F.when(use, F.col(f"__{m}")).otherwise(F.lit(one[f"{m}_threshold"])).cast("double"))
        out = out.withColumn(f"is_high_{m}", F.col(m) > F.col(f"{m}_threshold"))
    flags = sum((F.col(f"is_high_{m}").cast("long") for m in METRICS), F.lit(0))
    out = out.withColumn("upper_tail_flag_count", flags.cast("long")).withColumn("is_upper_tail", F.col("upper_tail_flag_count") > 0)
    added = ["baseline_scope", "machine_train_incident_count", "baseline_train_incident_count", "baseline_quantile"]
    added += [c for m in METRICS for c in (f"{m}_threshold", f"is_high_{m}")] + ["upper_tail_flag_count", "is_upper_tail"]
    return out.select(*episodes.columns, *added)


def check_unique_machines(machines: DataFrame) -> None:
    if machines.groupBy("machine_id").count().where("count > 1").limit(1).count():
        raise ValueError("a machine has more than one baseline")


def upper_tail_shares(flagged: DataFrame) -> DataFrame:
    """Share of upper-tail episodes of each split."""
    high = F.count_if("is_upper_tail")
    return flagged.groupBy("split").agg(F.count(F.lit(1)).alias("incident_count"), high.alias("upper_tail_count"), ratio(high, F.count(F.lit(1))).alias("upper_tail_share"))
