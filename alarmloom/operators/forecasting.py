"""Forecasts of the codes that follow an episode: vocabularies, frequency models with fallback, evaluation, selection.

Scores of the frequency models depend only on a scope (all machines, a machine, or a
machine and its last code), so models, rankings and top-k lists are held by scope
and joined to episodes by key.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f1, ratio

GLOBAL, MACHINE, TRANSITION = "global_frequency_v1", "machine_frequency_v1", "transition_frequency_v1"
#: Simpler models go first among equals.
COMPLEXITY = {GLOBAL: 0, MACHINE: 1, TRANSITION: 2, "ovr_logistic_none_v1": 3, "ovr_logistic_balanced_v1": 3, "gru_none_v1": 4, "gru_balanced_capped_v1": 4}
LOGISTIC, LOGISTIC_BALANCED, RECURRENT, RECURRENT_BALANCED = "ovr_logistic_none_v1", "ovr_logistic_balanced_v1", "gru_none_v1", "gru_balanced_capped_v1"
GROUPS = ("rare", "medium", "common")


def complete_train(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("split") == "train") & F.col("outcome_is_complete"))


def fit_vocabulary(labels: DataFrame) -> DataFrame:
    """(alarm_code, support): codes that follow complete train episodes and how many they follow."""
    return complete_train(labels).select(F.explode("future_alarm_codes").alias("alarm_code")).groupBy("alarm_code").agg(F.count(F.lit(1)).alias("support"))


def encoded(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(incident_id, known_codes, unknown_codes, unknown_code_count, unknown_event_count) of all labels."""
    flat = labels.select("incident_id", F.explode("future_alarm_counts").alias("x")).select("incident_id", "x.alarm_code", "x.n")
    marked = flat.join(vocabulary.select("alarm_code", F.lit(True).alias("known")), "alarm_code", "left")
    known, unknown = F.when(F.col("known"), F.col("alarm_code")), F.when(F.col("known").isNull(), F.col("alarm_code"))
    sums = marked.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(known)).alias("known_codes"), F.array_sort(F.collect_list(unknown)).alias("unknown_codes"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown_event_count"),
    )
    none = F.array().cast("array<string>")
    out = labels.select("incident_id").join(sums, "incident_id", "left")
    return out.select(
        "incident_id", F.coalesce("known_codes", none).alias("known_codes"), F.coalesce("unknown_codes", none).alias("unknown_codes"),
        F.size(F.coalesce("unknown_codes", none)).cast("long").alias("unknown_code_count"), F.coalesce("unknown_event_count", F.lit(0)).alias("unknown_event_count"),
    )


def split_profile(labels: DataFrame, codes: DataFrame) -> DataFrame:
    joined = labels.join(codes, "incident_id")
    complete = F.col("outcome_is_complete")
    n, done = F.count(F.lit(1)), F.count_if(complete)
    empty = F.count_if(complete & ~F.col("has_future_alarms"))
    unknown = F.count_if(complete & (F.col("unknown_code_count") > 0))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0))

    return joined.groupBy("split").agg(
        n.alias("episode_count"), done.alias("complete_outcome_count"), ratio(done, n).alias("outcome_coverage"), (n - done).alias("incomplete_outcome_count"),
        F.count_if(complete & F.col("has_future_alarms")).alias("complete_with_future_alarm_count"), empty.alias("complete_empty_outcome_count"), ratio(empty, done).alias("complete_empty_outcome_share"),
        F.avg(F.when(complete, F.size("known_codes"))).alias("mean_known_label_count"), unknown.alias("unknown_label_query_count"), ratio(unknown, done).alias("unknown_label_query_share"),
        total("unknown_code_count").alias("unknown_alarm_code_occurrence_count"), total("unknown_event_count").alias("unknown_alarm_event_count"),
    )


def support_profile(labels: DataFrame) -> DataFrame:
    """Codes of the vocabulary by support, with the share of complete train episodes that they follow."""
    n = complete_train(labels).count()
    rank = F.row_number().over(Window.orderBy(F.col("support").desc(), "alarm_code"))
    return fit_vocabulary(labels).select(rank.alias("support_rank"), "alarm_code", F.col("support").alias("train_sample_support"), ratio(F.col("support"), F.lit(n)).alias("train_sample_share"))


def support_groups(profile: DataFrame, rare_most: int, common_least: int) -> DataFrame:
    if rare_most < 1:
        raise ValueError("the bound of rare codes must be above zero")
    if common_least <= rare_most + 1:
        raise ValueError("the bounds must leave room for medium codes")
    support = F.col("train_sample_support")
    return profile.withColumn("support_group", F.when(support <= rare_most, "rare").when(support >= common_least, "common").otherwise("medium"))


def all_groups(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(g,) for g in GROUPS], "support_group string")


def support_group_summary(grouped: DataFrame) -> DataFrame:
    sums = grouped.groupBy("support_group").agg(F.count(F.lit(1)).alias("n"), F.sum("train_sample_support").alias("p"))
    every = Window.partitionBy()
    joined = all_groups(grouped).join(sums, "support_group", "left").select("support_group", F.coalesce("n", F.lit(0)).alias("label_count"), F.coalesce("p", F.lit(0)).alias("positive_sample_count"))
    return joined.withColumn("label_share", ratio(F.col("label_count"), F.sum("label_count").over(every))).withColumn("positive_sample_share", ratio(F.col("positive_sample_count"), F.sum("positive_sample_count").over(every)))


# ---------------------------------------------------------------- frequency models


def with_context(labels: DataFrame, last_codes: DataFrame) -> DataFrame:
    """Labels with the last code of their episode."""
    return labels.join(last_codes.select("incident_id", "last_alarm_code"), "incident_id")


def hits_of(train: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, alarm_code, hits): the samples of a scope that a code follows; only codes that follow some."""
    return train.select(*keys, F.explode("future_alarm_codes").alias("alarm_code")).groupBy(*keys, "alarm_code").agg(F.count(F.lit(1)).alias("hits"))


TOP = "array<struct<rank:int,alarm_code:string,score:double>>"


def top_of_scopes(train: DataFrame, keys: tuple[str, ...], first_codes: list[str], k: int) -> DataFrame:
    """(keys, top): the k codes of the highest share of each scope's samples, then by code.

    Held are the codes that follow some sample. Of the others, whose share is 0, a scope can only need the first by code: ``first_codes``, the
    vocabulary's first 2 k, has k of them besides the less than k that a scope without k hits may have among these.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("hits").desc(), "alarm_code"))
    ranked = hits_of(train, keys).withColumn("rank", place).where(F.col("rank") <= k)
    held = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "alarm_code", "hits"))).alias("held"))
    joined = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).join(held, list(keys), "left")
    held = F.coalesce("held", F.array().cast("array<struct<rank:int,alarm_code:string,hits:bigint>>"))
    codes = F.array(*map(F.lit, first_codes)) if first_codes else F.array().cast("array<string>")
    missing = F.array_except(codes, F.transform(held, lambda x: x["alarm_code"]))
    own = F.transform(held, lambda x: F.struct(x["rank"].alias("rank"), x["alarm_code"].alias("alarm_code"), ratio(x["hits"], F.col("samples")).alias("score")))
    rest = F.transform(missing, lambda c, i: F.struct((F.size(held) + i + 1).cast("int").alias("rank"), c.alias("alarm_code"), F.lit(0.0).alias("score")))
    return joined.select(*keys, F.slice(F.concat(own.cast(TOP), rest.cast(TOP)), 1, k).alias("top"))


def top_overall(train: DataFrame, vocabulary: DataFrame, k: int) -> Column:
    """The same over all samples, as a literal of k codes."""
    n = train.count()
    best = vocabulary.orderBy(F.col("support").desc(), "alarm_code").limit(k).collect()
    return F.array(*(F.struct(F.lit(i), F.lit(r.alarm_code), F.lit(r.support / n)) for i, r in enumerate(best, 1))).cast(TOP)


def frequencies(train: DataFrame, vocabulary: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, samples, alarm_code, score): share of a scope's train samples that each code follows, zeros too.

    That is a model written out, scopes times codes; predictions do without (``top_of_scopes``).
    """
    samples = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    hits = hits_of(train, keys)
    # each scope with each code of the vocabulary: the model's own size, states times codes
    codes = vocabulary.agg(F.array_sort(F.collect_list("alarm_code")).alias("codes"))
    grid = samples.join(codes).select(*keys, "samples", F.explode("codes").alias("alarm_code"))
    return grid.join(hits, [*keys, "alarm_code"], "left").select(*keys, "samples", "alarm_code", ratio(F.coalesce("hits", F.lit(0)), F.col("samples")).alias("score"))


def fit_global(labels: DataFrame) -> DataFrame:
    """(alarm_code, score, samples)."""
    train = complete_train(labels)
    return frequencies(train, fit_vocabulary(labels), ()).select("alarm_code", "score", "samples")


def fit_machine(labels: DataFrame) -> DataFrame:
    return frequencies(complete_train(labels), fit_vocabulary(labels), ("machine_id",))


def fit_transition(labels: DataFrame) -> DataFrame:
    """``labels`` with context; a row a state (machine, last code) and code."""
    return frequencies(complete_train(labels), fit_vocabulary(labels), ("machine_id", "last_alarm_code"))


def scopes(labels: DataFrame, model: str, least_machine: int, least_transition: int) -> DataFrame:
    """For each episode the scope that scores it, and the samples of its machine and state (0 where there are none)."""
    train = complete_train(labels)
    machine = train.groupBy("machine_id").agg(F.count(F.lit(1)).alias("machine_samples"))
    joined = labels.join(machine, "machine_id", "left").withColumn("machine_samples", F.coalesce("machine_samples", F.lit(0)))
    scope = F.lit("global") if model == GLOBAL else F.when(F.col("machine_samples") >= least_machine, "machine" if model == MACHINE else "machine_fallback").otherwise("global_fallback")
    if model != TRANSITION:
        return joined.select("incident_id", "machine_id", "split", "outcome_is_complete", scope.alias("baseline_scope"), "machine_samples")
    state = train.groupBy("machine_id", "last_alarm_code").agg(F.count(F.lit(1)).alias("state_samples"))
    joined = joined.join(state, ["machine_id", "last_alarm_code"], "left").withColumn("state_samples", F.coalesce("state_samples", F.lit(0)))
    scope = F.when(F.col("state_samples") >= least_transition, "transition").otherwise(scope)
    return joined.select("incident_id", "machine_id", "last_alarm_code", "split", "outcome_is_complete", scope.alias("baseline_scope"), "machine_samples", "state_samples")


def top_codes(scores: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """(keys, top): up to k codes with their scores, highest first, then by code."""
    if k <= 0:
        raise ValueError("k must be above zero")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "alarm_code"))
    ranked = scores.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "alarm_code", "score"))).alias("top"))


def predict(labels: DataFrame, model: str = TRANSITION, k: int = 5, least_machine: int = 200, least_transition: int = 20) -> DataFrame:
    """``scopes`` with ``top``: the k codes of the scope that holds for the episode. ``labels`` has the context that the model needs."""
    if model not in (GLOBAL, MACHINE, TRANSITION):
        raise ValueError(f"unknown model {model}")
    if k <= 0:
        raise ValueError("k must be above zero")
    found, train = scopes(labels, model, least_machine, least_transition), complete_train(labels)
    vocabulary = fit_vocabulary(labels)
    out, best = found, top_overall(train, vocabulary, k)
    if model != GLOBAL:
        first_codes = [r.alarm_code for r in vocabulary.select("alarm_code").orderBy("alarm_code").limit(2 * k).collect()]
        machine = top_of_scopes(train, ("machine_id",), first_codes, k).withColumnRenamed("top", "top_machine")
        out = out.join(machine, "machine_id", "left")
        best = F.when(F.col("baseline_scope").isin("machine", "machine_fallback"), F.col("top_machine")).otherwise(best)
    if model == TRANSITION:
        state = top_of_scopes(train, ("machine_id", "last_alarm_code"), first_codes, k).withColumnRenamed("top", "top_state")
        out = out.join(state, ["machine_id", "last_alarm_code"], "left")
        best = F.when(F.col("baseline_scope") == "transition", F.col("top_state")).otherwise(best)
    return out.select(*found.columns, best.alias("top"))


def predict_scored(labels: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """The frame of ``predict`` for a model that scores each episode itself: ``scores`` has (incident_id, alarm_code, score)."""
    top = top_codes(scores, ("incident_id",), k)
    return labels.select("incident_id", "machine_id", "split", "outcome_is_complete", F.lit("model").alias("baseline_scope")).join(top, "incident_id")


def flat_predictions(predicted: DataFrame) -> DataFrame:
    return predicted.select("incident_id", "baseline_scope", F.explode("top").alias("t")).select("incident_id", "baseline_scope", "t.rank", "t.alarm_code", "t.score")


def predict_online(labels: DataFrame, asked: DataFrame, k: int = 5, hours: float = 6.0, least_machine: int = 200, least_transition: int = 20) -> DataFrame:
    """Predictions for the episodes of ``asked`` (incident_id) with the support behind each: state, machine, or all supported machines."""
    predicted = predict(labels, TRANSITION, k, least_machine, least_transition).join(asked.select("incident_id"), "incident_id", "left_semi")
    train = complete_train(labels)
    sums = train.groupBy("machine_id").count().where(F.col("count") >= least_machine).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all_samples"))
    support = F.when(F.col("baseline_scope") == "transition", F.col("state_samples")).when(F.col("baseline_scope") == "machine_fallback", F.col("machine_samples")).otherwise(F.col("all_samples"))
    flat = predicted.join(sums).select("incident_id", "baseline_scope", support.alias("train_support"), F.explode("top").alias("t"))
    return flat.select("incident_id", F.col("t.rank").alias("rank"), F.col("t.alarm_code").alias("alarm_code"), F.col("t.score").alias("model_score"), F.lit(TRANSITION).alias("model_version"), F.lit(float(hours)).alias("forecast_horizon_hours"), "baseline_scope", "train_support")


# ---------------------------------------------------------------- evaluation


def query_metrics(labels: DataFrame, codes: DataFrame, predicted: DataFrame, split: str, k: int, model: str) -> DataFrame:
    """One row a complete episode of the split; precision counts the codes that can be named, recall is null without known codes."""
    rows = labels.where((F.col("split") == split) & F.col("outcome_is_complete")).select("incident_id", "split").join(codes, "incident_id").join(predicted.select("incident_id", "top"), "incident_id")
    named = F.transform("top", lambda t: t["alarm_code"])
    step = rows.withColumn("known_label_count", F.size("known_codes").cast("long")).withColumn("true_positive_count", F.size(F.array_intersect(named, F.col("known_codes"))).cast("long"))
    return step.select(
        "incident_id", "split", F.lit(model).alias("model_version"), F.lit(k).alias("top_k"), "known_label_count", F.col("unknown_code_count").alias("unknown_alarm_code_count"),
        F.col("unknown_event_count").alias("unknown_alarm_event_count"), "true_positive_count", (F.col("true_positive_count") > 0).alias("hit_at_k"),
        ratio(F.col("true_positive_count"), F.size("top")).alias("precision_at_k"), ratio(F.col("true_positive_count"), F.col("known_label_count")).alias("recall_at_k"),
    )


def label_metrics(labels: DataFrame, codes: DataFrame, predicted: DataFrame, vocabulary: DataFrame, split: str) -> DataFrame:
    """One row a code of the vocabulary: support, predictions and hits on the split's complete episodes."""
    ids = labels.where((F.col("split") == split) & F.col("outcome_is_complete")).select("incident_id")
    truth = codes.join(ids, "incident_id", "left_semi").select("incident_id", F.explode("known_codes").alias("alarm_code"), F.lit(1).alias("truth"), F.lit(0).alias("named"))
    named = predicted.join(ids, "incident_id", "left_semi").select("incident_id", F.explode("top").alias("t")).select("incident_id", "t.alarm_code", F.lit(0).alias("truth"), F.lit(1).alias("named"))
    pairs = truth.unionByName(named).groupBy("incident_id", "alarm_code").agg(F.max("truth").alias("truth"), F.max("named").alias("named"))
    sums = pairs.groupBy("alarm_code").agg(F.sum("truth").alias("support"), F.sum("named").alias("predicted"), F.sum(F.col("truth") * F.col("named")).alias("hits"))
    out = vocabulary.select("alarm_code").join(sums, "alarm_code", "left").select("alarm_code", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "predicted", "hits")))
    precision, recall = F.coalesce(ratio("hits", "predicted"), F.lit(0.0)), F.coalesce(ratio("hits", "support"), F.lit(0.0))
    return out.select(
        "alarm_code", F.col("support").alias("evaluation_support"), F.col("predicted").alias("predicted_positive_count"), F.col("hits").alias("true_positive_count"),
        precision.alias("precision_at_k"), recall.alias("recall_at_k"), f1(precision, recall).alias("f1_at_k"),
    )


def split_metrics(labels: DataFrame, queries: DataFrame, per_label: DataFrame, split: str, model: str, k: int) -> DataFrame:
    """One row: coverage, means over complete episodes, micro and macro measures."""
    n = labels.where(F.col("split") == split).agg(F.count(F.lit(1)).alias("episode_count"))
    q = queries.agg(
        F.count(F.lit(1)).alias("complete_outcome_count"), F.count_if(F.col("known_label_count") == 0).alias("complete_empty_known_label_count"),
        F.count_if(F.col("unknown_alarm_code_count") > 0).alias("unknown_label_query_count"), F.avg(F.col("hit_at_k").cast("double")).alias("mean_hit_at_k"),
        F.avg("precision_at_k").alias("mean_precision_at_k"), F.avg("recall_at_k").alias("mean_recall_at_k"),
    )
    supported = F.col("evaluation_support") > 0
    m = per_label.agg(
        F.sum("true_positive_count").alias("tp"), F.sum("predicted_positive_count").alias("pp"), F.sum("evaluation_support").alias("ap"),
        F.avg(F.when(supported, F.col("f1_at_k"))).alias("macro_f1_at_k"), F.count_if(supported).alias("evaluated_label_count"),
    )
    precision, recall = F.coalesce(ratio("tp", "pp"), F.lit(0.0)), F.coalesce(ratio("tp", "ap"), F.lit(0.0))
    # three tables of one row each
    return n.join(q).join(m).select(
        F.lit(split).alias("split"), F.lit(model).alias("model_version"), F.lit(k).alias("top_k"), "episode_count", "complete_outcome_count", ratio("complete_outcome_count", "episode_count").alias("outcome_coverage"),
        "complete_empty_known_label_count", "unknown_label_query_count", "mean_hit_at_k", "mean_precision_at_k", "mean_recall_at_k", precision.alias("micro_precision_at_k"), recall.alias("micro_recall_at_k"),
        f1(precision, recall).alias("micro_f1_at_k"), "macro_f1_at_k", "evaluated_label_count",
    )


def support_group_metrics(per_label: DataFrame, grouped: DataFrame) -> DataFrame:
    """Measures of rare, medium and common codes; all three rows are always there."""
    joined = per_label.join(grouped.select("alarm_code", "support_group"), "alarm_code")
    supported = F.col("evaluation_support") > 0
    sums = joined.groupBy("support_group").agg(
        F.count(F.lit(1)).alias("label_count"), F.count_if(supported).alias("evaluated_label_count"), F.sum("evaluation_support").alias("evaluation_positive_count"),
        F.sum("predicted_positive_count").alias("predicted_positive_count"), F.sum("true_positive_count").alias("true_positive_count"), F.avg(F.when(supported, F.col("f1_at_k"))).alias("macro_f1_at_k"),
    )
    counts = ("label_count", "evaluated_label_count", "evaluation_positive_count", "predicted_positive_count", "true_positive_count")
    out = all_groups(per_label).join(sums, "support_group", "left").select("support_group", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "macro_f1_at_k")
    precision = F.coalesce(ratio("true_positive_count", "predicted_positive_count"), F.lit(0.0))
    recall = F.coalesce(ratio("true_positive_count", "evaluation_positive_count"), F.lit(0.0))
    return out.select("support_group", *counts, precision.alias("micro_precision_at_k"), recall.alias("micro_recall_at_k"), f1(precision, recall).alias("micro_f1_at_k"), "macro_f1_at_k")


def scope_profile(predicted: DataFrame, split: str) -> DataFrame:
    rows = predicted.where((F.col("split") == split) & F.col("outcome_is_complete"))
    return rows.groupBy("baseline_scope").agg(F.count(F.lit(1)).alias("query_count")).orderBy(F.col("query_count").desc(), "baseline_scope")


def select_model(metrics: DataFrame, tolerance: float) -> DataFrame:
    """The model with the highest micro F1 among those whose macro F1 is within ``tolerance`` of the best.

    Ties go to macro F1, then the simpler model, then the name. ``metrics`` holds one validation row a model.
    """
    if not isfinite(tolerance) or tolerance < 0:
        raise ValueError("the tolerance must be finite and not negative")
    rank = F.coalesce(*(F.when(F.col("model_version") == m, F.lit(c)) for m, c in COMPLEXITY.items()))
    best = F.max("macro_f1_at_k").over(Window.partitionBy())
    step = metrics.withColumn("best_macro_f1", best).where(F.col("macro_f1_at_k") >= F.col("best_macro_f1") - tolerance).withColumn("complexity_rank", rank)
    step = step.withColumn("eligible_model_count", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("macro_f1_tolerance", F.lit(float(tolerance)))
    return step.orderBy(F.col("micro_f1_at_k").desc(), F.col("macro_f1_at_k").desc(), "complexity_rank", "model_version").limit(1)


def check_selection(metrics: DataFrame) -> None:
    rows = metrics.select("split", "model_version", "micro_f1_at_k", "macro_f1_at_k").collect()  # a row a model
    names = [r.model_version for r in rows]
    if {r.split for r in rows} != {"validation"}:
        raise ValueError("models are selected on validation rows only")
    if len(set(names)) != len(names) or set(names) - set(COMPLEXITY):
        raise ValueError("model versions must be known and differ")
    if any(r.micro_f1_at_k is None or r.macro_f1_at_k is None for r in rows):
        raise ValueError("a measure is missing")
