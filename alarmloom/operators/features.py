"""Episodes as vectors: TF-IDF of alarm codes and standardized shape, fitted on train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = ("event_count", "duration_seconds", "distinct_alarm_count")
ALARM_VERSION, COMBINED_VERSION = "alarm_tfidf_v1", "alarm_plus_shape_v1"
TOKEN = r"\b\w+\b"


#: Events of an episode whose codes are put in order together.
PART = 4_096


def ordered_text(rows: DataFrame, *keys: str) -> DataFrame:
    """keys with the codes of ``rows`` (event_position, alarm_code) in order as one text, and their number.

    In two levels: texts of PART places each, then those by their number; so no task sorts a whole episode.
    """
    codes = F.transform(F.array_sort(F.collect_list(F.struct("event_position", "alarm_code"))), lambda x: x["alarm_code"])
    parts = rows.groupBy(*keys, F.floor(F.col("event_position") / PART).alias("part")).agg(F.array_join(codes, " ").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.groupBy(*keys).agg(F.array_join(texts, " ").alias("alarm_document"), F.sum("n").alias("alarm_token_count"))


def alarm_documents(mapping: DataFrame, events: DataFrame) -> DataFrame:
    """Codes of each episode in order, repeats kept, with their number."""
    return ordered_text(mapping.join(events.select("source_row", "alarm_code"), "source_row"), "incident_id")


def documents_of(identified: DataFrame) -> DataFrame:
    """The same from events that know their episode, without a join."""
    return ordered_text(identified, "machine_id", "incident_id", "split")


def tokens(documents: DataFrame) -> DataFrame:
    """(incident_id, split, token, n) of each document."""
    found = documents.select("incident_id", "split", F.explode(F.regexp_extract_all("alarm_document", F.lit(TOKEN), F.lit(0))).alias("token"))
    return found.groupBy("incident_id", "split", "token").agg(F.count(F.lit(1)).alias("n"))


def fit_idf(documents: DataFrame) -> DataFrame:
    """(token, document_frequency, idf) of the train documents: ln((1 + n) / (1 + df)) + 1."""
    train = documents.where(F.col("split") == "train")
    n = train.count()
    if not n:
        raise ValueError("there are no train documents")
    frequency = tokens(train).groupBy("token").agg(F.count(F.lit(1)).alias("document_frequency"))
    return frequency.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("document_frequency"))) + 1)


def tfidf_weights(documents: DataFrame, idf: DataFrame) -> DataFrame:
    """(incident_id, token, weight): counts times idf, each document scaled to length one; unknown tokens drop out."""
    raw = tokens(documents).join(idf.select("token", "idf"), "token").withColumn("raw", F.col("n") * F.col("idf"))
    lengths = raw.groupBy("incident_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(lengths, "incident_id").select("incident_id", "token", (F.col("raw") / F.col("length")).alias("weight"))


def fit_shape(episodes: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of log1p of each measure over train; a deviation of 0 counts as 1."""
    train = episodes.where(F.col("split") == "train")
    row = train.agg(*(f(F.log1p(c)).alias(f"{n}_{c}") for c in SHAPE for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    if row[f"mean_{SHAPE[0]}"] is None:
        raise ValueError("there are no train episodes")
    return {c: (row[f"mean_{c}"], row[f"std_{c}"] or 1.0) for c in SHAPE}


def check_shape(episodes: DataFrame) -> None:
    bad = [F.count_if(~(F.col(c) >= 0) | F.isnan(F.col(c).cast("double")) | F.col(c).isNull() | (F.col(c).cast("double") == float("inf"))) for c in SHAPE]
    if sum(episodes.agg(*bad).first()):
        raise ValueError("shape measures must be finite and not negative")


def shape_columns(fitted: dict[str, tuple[float, float]]) -> list[Column]:
    return [((F.log1p(c) - F.lit(mean)) / F.lit(std)).alias(f"{c}_z") for c, (mean, std) in fitted.items()]


def shape_features(episodes: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return episodes.select("incident_id", *shape_columns(fitted))


def checked_weights(alarm: float, shape: float) -> tuple[float, float]:
    if not all(0 <= w < float("inf") for w in (alarm, shape)) or not alarm + shape:
        raise ValueError("weights must be finite and not negative, and not both zero")
    return float(alarm), float(shape)


def feature_vectors(episodes: DataFrame, documents: DataFrame, alarm: float = 1.0, shape: float = 1.0) -> DataFrame:
    """Per episode its parts as unit blocks times their weights, scaled to length one together.

    Columns: incident_id, terms (array of token and weight), shape (three numbers),
    alarm_length and shape_length (0 or 1) and norm, the length before scaling.
    """
    alarm, shape = checked_weights(alarm, shape)
    weights = tfidf_weights(documents, fit_idf(documents))
    terms = weights.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("terms"))
    shaped = shape_features(episodes, fit_shape(episodes))
    z = [f"{c}_z" for c in SHAPE]
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in z[1:]), F.col(z[0]) * F.col(z[0])))
    unit = F.array(*(F.when(length > 0, F.col(c) / length).otherwise(F.lit(0.0)) for c in z))
    none = F.array().cast("array<struct<token:string,weight:double>>")
    step = shaped.select("incident_id", unit.alias("shape"), (length > 0).cast("double").alias("shape_length")).join(terms, "incident_id", "left")
    step = step.withColumn("terms", F.coalesce("terms", none)).withColumn("alarm_length", (F.size("terms") > 0).cast("double"))
    norm = F.sqrt(F.lit(alarm * alarm) * F.col("alarm_length") + F.lit(shape * shape) * F.col("shape_length"))
    safe = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return step.withColumn("norm", norm).select(
        "incident_id",
        F.transform("terms", lambda x: F.struct(x["token"].alias("token"), (x["weight"] * F.lit(alarm) / safe).alias("weight"))).alias("terms"),
        F.transform("shape", lambda x: x * F.lit(shape) / safe).alias("shape"),
        "alarm_length",
        "shape_length",
        "norm",
    )
