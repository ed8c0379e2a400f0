"""Operators on small hand-made frames: ties, boundaries, fallbacks, and rules of time."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alarmloom.operators import baselines as B
from alarmloom.operators import episodes as E
from alarmloom.operators import features as X
from alarmloom.operators import forecasting as Y
from alarmloom.operators import ingest as I
from alarmloom.operators import investigation as V
from alarmloom.operators import profiles as P
from alarmloom.operators import retrieval as R
from alarmloom.operators import samples as S
from alarmloom.operators import sequences as Q
from alarmloom.operators import windows as W

EVENTS = "timestamp timestamp_ntz, alarm_code string, machine_id string, source_row long"
PROCESSED = EVENTS + ", duplicate_group_size long, is_exact_duplicate boolean, previous_timestamp timestamp_ntz, gap_seconds double, split string"


def at(hour, minute=0, second=0, micro=0):
    return datetime(2019, 2, 21, hour, minute, second, micro)


def processed(spark, rows):
    """rows: (time, code, machine, source_row, gap, split)"""
    return spark.createDataFrame([(t, c, m, r, 1, False, None, g, s) for t, c, m, r, g, s in rows], PROCESSED)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(at(10), "139", "4", 0), (at(10), "139", "4", 1), (at(10, 5), "31", "4", 2), (at(10, 40), "11", "4", 3), (at(10, 45), "26", "4", 4)], EVENTS)


def column(df, name, order="source_row"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_processed_events(log):
    out = I.processed_events(log, 0.5, 0.25, 0.25)
    assert column(out, "duplicate_group_size") == [2, 2, 1, 1, 1]
    assert column(out, "split") == ["train", "train", "train", "validation", "test"]
    assert column(out, "gap_seconds") == [None, 0.0, 300.0, 2100.0, 300.0]
    assert column(I.processed_events(log.repartition(3), 0.5, 0.25, 0.25), "split") == column(out, "split")


def test_bad_shares_and_overlapping_splits(spark, log):
    for shares in ((0.7, 0.3, 0.0), (0.5, 0.3, 0.3)):
        with pytest.raises(ValueError):
            I.assign_splits(log, *shares)
    bad = processed(spark, [(at(9), "1", "4", 0, None, "validation"), (at(10), "1", "4", 1, 1.0, "train"), (at(11), "1", "4", 2, 1.0, "test")])
    with pytest.raises(ValueError, match="4"):
        I.check_splits(bad)
    I.check_splits(I.processed_events(log, 0.5, 0.25, 0.25))


def test_gap_profile_and_quality(spark):
    events = spark.createDataFrame([(at(10), "139", "4", 0), (at(9), "31", "6", 1), (at(10, 5), "11", "4", 2), (at(9, 2), "26", "6", 3)], EVENTS)
    got = {r.threshold_minutes: (r.within_threshold_count, r.incident_break_count, r.estimated_incident_count) for r in P.gap_threshold_profile(events, (1, 3, 5)).collect()}
    assert got == {1.0: (0, 2, 4), 3.0: (1, 1, 3), 5.0: (2, 0, 2)}
    back = spark.createDataFrame([(at(10), "1", "4", 0), (at(9), "2", "4", 1), (at(11), "3", "4", 2), (at(11), "3", "4", 3), (at(8), "4", "4", 4)], EVENTS)
    assert tuple(P.data_quality(back).first()) == (1, 2, 1, 2, 2)


def test_starts_at_the_limit_split_change_and_ids(spark):
    rows = [(at(10), "1", "4", 0, None, "train"), (at(10, 5), "1", "4", 1, 300.0, "train"), (at(10, 35), "1", "4", 2, 1800.0, "train"), (at(11, 5, 1), "1", "4", 3, 1801.0, "train"), (at(11, 6), "1", "4", 4, 59.0, "validation"), (at(11, 7), "1", "4", 5, 60.0, "validation"), (at(10), "1", "6", 6, None, "train")]
    df = processed(spark, rows)
    assert column(E.mark_starts(df), "is_incident_start") == [True, False, False, True, True, False, True]
    ids = column(E.identify_events(df), "incident_id")
    assert ids == column(E.identify_events(df.orderBy(F.rand(3)).repartition(5)), "incident_id") and len(set(ids)) == 4
    assert column(E.event_mapping(df), "event_position") == [0, 1, 2, 0, 0, 1, 0]


def test_episodes_across_blocks_equal_a_walk_over_each_log(spark):
    """Episodes that span several days, days without a start, ties at midnight: places, numbers and openings as a plain loop gives them."""
    import random

    draw, start = random.Random(5), datetime(2020, 1, 1)
    rows = []
    for machine in ("a", "b", "c"):
        moment = start
        for _ in range(150):
            moment += timedelta(minutes=draw.choice((0, 0, 20, 29, 30, 31, 700, 2000)) if machine != "c" else 25)
            rows.append((moment, draw.choice("xyz"), machine, len(rows)))
    events = I.processed_events(spark.createDataFrame(rows, EVENTS), 0.6, 0.2, 0.2)
    got = {r.source_row: r for r in E.opened(events, (30.0, 600.0)).collect()}
    processed_rows = sorted(events.collect(), key=lambda r: (r.machine_id, r.timestamp, r.source_row))
    for i, limit in enumerate((1800, 36000)):
        last = None
        for r in processed_rows:
            fresh = last is None or last.machine_id != r.machine_id
            place = 1 if fresh else place + 1
            gap = None if fresh else (r.timestamp - last.timestamp).total_seconds()
            assert r.gap_seconds == gap and r.previous_timestamp == (None if fresh else last.timestamp)
            opens = fresh or last.split != r.split or gap > limit
            number = 0 if fresh else number + opens
            opening = (r.source_row, place) if opens else opening
            mine = got[r.source_row]
            assert (mine.place, mine[f"start_{i}"], mine[f"episode_{i}"]) == (place, opens, number)
            assert (mine[f"opening_{i}"].source_row, mine[f"opening_{i}"].place) == opening
            last = r
    for machine in ("a", "b", "c"):
        times = sorted({r.timestamp for r in processed_rows if r.machine_id == machine})
        for r in processed_rows:
            if r.machine_id == machine:
                at_place = times.index(r.timestamp)
                assert r.split == ("train" if at_place < int(len(times) * 0.6) else "validation" if at_place < int(len(times) * (0.6 + 0.2)) else "test")
    same = {}
    for r in rows:
        same[r[:3]] = same.get(r[:3], 0) + 1
    assert all(r.duplicate_group_size == same[(r.timestamp, r.alarm_code, r.machine_id)] for r in processed_rows)


def test_golden_episode_id(spark):
    df = processed(spark, [(datetime(2019, 2, 21, 19, 57, 57, 532000), "1", "4", 42, None, "train")])
    assert E.summarize(df).first().incident_id == "inc_a726ed82c68db78d"
    assert E.summarize(df, 31).first().incident_id != "inc_a726ed82c68db78d"


def test_summary_and_dominant_tie(spark):
    df = processed(spark, [(at(10), "98", "4", 0, None, "train"), (at(10, 25), "11", "4", 1, 1500.0, "train"), (at(10, 50), "98", "4", 2, 1500.0, "train"), (at(11, 20, 1), "11", "4", 3, 1801.0, "train"), (at(9), "2", "6", 4, None, "train"), (at(9), "11", "6", 5, 0.0, "train")])
    got = [(r.machine_id, r.event_count, r.duration_seconds, r.dominant_alarm_code, r.first_alarm_code, r.last_alarm_code) for r in E.summarize(df).orderBy("machine_id", "start_time").collect()]
    assert got == [("4", 3, 3000.0, "98", "98", "98"), ("4", 1, 0.0, "11", "11", "11"), ("6", 2, 0.0, "11", "2", "11")]


def test_sensitivity(spark):
    df = processed(spark, [(at(10), "a", "4", 0, None, "train"), (at(10, 10), "b", "4", 1, 600.0, "train"), (at(10, 40), "c", "4", 2, 1800.0, "train"), (at(11, 40), "c", "4", 3, 3600.0, "train")])
    got = {r.gap_minutes: (r.incident_count, r.singleton_incident_count, r.median_event_count, r.median_duration_seconds, r.mean_distinct_alarm_count) for r in E.sensitivity_profile(df).collect()}
    assert got == {15.0: (3, 2, 1.0, 0.0, 4 / 3), 30.0: (2, 1, 2.0, 1200.0, 2.0), 60.0: (1, 0, 4.0, 6000.0, 3.0)}


EPISODES = "incident_id string, machine_id string, split string, event_count long, duration_seconds double, distinct_alarm_count long"


def test_baselines_and_flags(spark):
    train = [(f"i{k}", "4", "train", k, k * 10.0, k) for k in range(1, 5)] + [("j", "19", "train", 100, 1.0, 1), ("v", "4", "validation", 999, 9.0, 9)]
    df = spark.createDataFrame(train, EPISODES)
    one = B.fit_global(df.where("machine_id = '4'")).first()
    assert (one.event_count_threshold, one.duration_seconds_threshold, one.distinct_alarm_count_threshold, one.incident_count) == (4.0, 40.0, 4.0, 4)
    machines = B.fit_machines(df, least=2)
    assert {r.machine_id: r.has_sufficient_support for r in machines.collect()} == {"4": True, "19": False}
    asked = spark.createDataFrame([("a", "4", "test", 4, 41.0, 5), ("b", "19", "test", 4, 0.0, 0), ("c", "99", "test", 101, 0.0, 0)], EPISODES)
    got = {r.incident_id: (r.baseline_scope, r.machine_train_incident_count, r.is_high_event_count, r.upper_tail_flag_count) for r in B.apply_flags(asked, B.fit_global(df), machines).collect()}
    assert got == {"a": ("machine", 4, False, 2), "b": ("global_fallback", 1, False, 0), "c": ("global_fallback", 0, True, 1)}
    with pytest.raises(ValueError):
        B.fit_global(df.where("false"))
    with pytest.raises(ValueError):
        B.check_unique_machines(machines.union(machines))


def test_upper_quantile_is_exact(spark):
    from math import ceil

    from alarmloom.functions.quantiles import upper_quantiles

    for n in (1, 2, 19, 20, 40, 1001):
        values = sorted((i * 7919) % 1009 for i in range(n))
        df = spark.createDataFrame([(v, float(v)) for v in values], "a long, b double")
        assert upper_quantiles(df, ("a", "b"), 0.95) == {c: float(values[ceil((n - 1) * 0.95)]) for c in ("a", "b")}


TIMED = "incident_id string, machine_id string, split string, start_time timestamp_ntz, end_time timestamp_ntz"


def test_outcome_window_is_open_closed(spark):
    episodes = spark.createDataFrame([("q", "4", "train", at(9), at(10)), ("n", "9", "train", at(9), at(10))], TIMED)
    rows = [(at(10), "0", "4", 0), (at(10, 0, 1), "98", "4", 1), (at(10, 30), "11", "4", 2), (at(11), "98", "4", 3), (at(11, 0, 0, 1000), "26", "4", 4), (at(10, 30), "77", "6", 5)]
    got = {r.incident_id: (r.future_event_count, r.future_alarm_codes, r.outcome_is_complete, r.has_future_alarms) for r in W.future_outcomes(episodes, spark.createDataFrame(rows, EVENTS), 1).collect()}
    assert got == {"q": (3, ["11", "98"], True, True), "n": (0, [], False, False)}
    for hours in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            W.future_outcomes(episodes, spark.createDataFrame(rows, EVENTS), hours)


def test_later_events_change_no_complete_outcome(spark):
    episodes = spark.createDataFrame([("q", "4", "train", at(9), at(10))], TIMED)
    rows = [(at(10, 0, 1), "98", "4", 1), (at(11), "11", "4", 2)]
    before, after = (W.future_outcomes(episodes, spark.createDataFrame(r, EVENTS), 1).drop("outcome_observed_through").collect() for r in (rows, rows + [(at(15), "1", "4", 3)]))
    assert before == after


def test_labels_end_with_their_split(spark):
    episodes = spark.createDataFrame([("q", "4", "train", at(9), at(10))], TIMED)
    events = processed(spark, [(at(10, 10), "98", "4", 0, None, "train"), (at(10, 50), "11", "4", 1, 1.0, "validation"), (at(12), "11", "4", 2, 1.0, "validation")])
    row = W.forecast_labels(episodes, events, 1).first()
    assert (row.future_event_count, row.future_alarm_codes, row.outcome_is_complete) == (1, ["98"], False)


def test_features(spark):
    docs = spark.createDataFrame([("a", "train", "m", "1 98 98"), ("b", "train", "m", "1 26"), ("c", "validation", "m", "999 999")], "incident_id string, split string, machine_id string, alarm_document string")
    idf = {r.token: r.idf for r in X.fit_idf(docs).collect()}
    assert set(idf) == {"1", "26", "98"} and idf["1"] == pytest.approx(1.0)
    assert {r.incident_id for r in X.tfidf_weights(docs, X.fit_idf(docs)).collect()} == {"a", "b"}
    shapes = spark.createDataFrame([("a", "m", "train", 1, 0.0, 1), ("b", "m", "train", 9, 99.0, 3), ("c", "m", "validation", 99, 999.0, 30)], EPISODES)
    z = {r.incident_id: tuple(r)[1:] for r in X.shape_features(shapes, X.fit_shape(shapes)).collect()}
    assert z["a"] == pytest.approx((-1, -1, -1)) and z["b"] == pytest.approx((1, 1, 1)) and min(z["c"]) > 1
    vectors = {r.incident_id: r for r in X.feature_vectors(shapes, docs).collect()}
    assert vectors["a"].shape == pytest.approx([-(6**-0.5)] * 3) and vectors["c"].terms == []
    for r in vectors.values():
        assert sum(t.weight**2 for t in r.terms) + sum(x * x for x in r.shape) == pytest.approx(1)
    with pytest.raises(ValueError):
        X.checked_weights(0, 0)
    with pytest.raises(ValueError):
        X.check_shape(spark.createDataFrame([("a", "m", "train", 1, -1.0, 1)], EPISODES))


@pytest.mark.parametrize("policy", R.POLICIES)
def test_blocks_of_time_find_what_one_block_finds(spark, monkeypatch, policy):
    """Small blocks, several ranges, many candidates of one moment: the same pools, counts and best candidates."""
    import random

    draw, rows = random.Random(9), []
    for k in range(90):
        begin = at(8) + timedelta(minutes=draw.choice((0, 30, 30, 30, 60, 90, 120, 400)))
        rows.append((f"e{k:02}", "4", draw.choice(("train", "test")), begin, begin + timedelta(minutes=draw.choice((1, 5, 25))), 2, 1.0, 2))
    episodes = spark.createDataFrame(rows, TIMED + ", event_count long, duration_seconds double, distinct_alarm_count long")
    docs = spark.createDataFrame([(r[0], r[2], r[1], " ".join(draw.choices("123456", k=3))) for r in rows], "incident_id string, split string, machine_id string, alarm_document string")
    outcomes = spark.createDataFrame([(r[0], r[4] + timedelta(minutes=10), draw.random() < 0.9, draw.sample(["a", "b", "c"], 2)) for r in rows], "incident_id string, outcome_end_time timestamp_ntz, outcome_is_complete boolean, future_alarm_codes array<string>")
    vectors = X.feature_vectors(episodes, docs, 1.0, 0.0)
    for search, known in ((R.Search(policy=policy), outcomes), (R.Search(policy=policy, outcome_gate=False), None)):
        whole = sorted(map(str, R.retrieve(episodes, vectors, known, episodes, search).collect()))
        with monkeypatch.context() as m:
            m.setattr(R, "QUERY_BLOCK", 7)
            m.setattr(R, "CANDIDATE_BLOCK", 5)
            assert sorted(map(str, R.retrieve(episodes, vectors, known, episodes, search).collect())) == whole
            rows = R.stored(R.searchable(episodes, vectors, known, episodes, search))
            worked = {r.incident_id: r.worked for r in R.best_candidates(rows, search).collect()}
            pools = {r.incident_id: r.pool for r in R.counted(rows, search).collect()}
            assert set(worked) == set(pools) and all(worked[i] <= pools[i] for i in pools) and sum(worked.values()) < sum(pools.values())
            assert R.retrieve(episodes, vectors, known, episodes.where("false"), search).count() == 0
        assert len(whole) > 20


def search_frames(spark):
    rows = [("query", "4", "validation", at(10), at(10, 30)), ("old_best", "4", "train", at(7), at(8)), ("tie_b", "4", "train", at(8), at(9)), ("tie_a", "6", "train", at(8), at(9)), ("edge", "4", "train", at(9), at(10)), ("future", "4", "test", at(12), at(13))]
    episodes = spark.createDataFrame([(*r, 2, 1.0, 2) for r in rows], TIMED + ", event_count long, duration_seconds double, distinct_alarm_count long")
    text = {"query": "98 11", "old_best": "98 11", "tie_a": "98", "tie_b": "98", "edge": "98 11", "future": "98 11"}
    docs = episodes.select("incident_id", "split", "machine_id").join(spark.createDataFrame(list(text.items()), "incident_id string, alarm_document string"), "incident_id")
    return episodes, docs


def test_time_gates(spark):
    episodes, _ = search_frames(spark)
    assert {r.incident_id for r in R.historical_candidates(episodes, "query").collect()} == {"old_best", "tie_a", "tie_b"}
    outcomes = spark.createDataFrame([("old_best", True, at(9)), ("tie_a", True, at(10)), ("tie_b", False, at(9))], "incident_id string, outcome_is_complete boolean, outcome_end_time timestamp_ntz")
    assert [r.incident_id for r in R.evaluable_candidates(episodes, outcomes, "query").collect()] == ["old_best"]
    with pytest.raises(KeyError):
        R.historical_candidates(episodes, "nobody")
    with pytest.raises(ValueError):
        R.historical_candidates(episodes, "query", "all")
    sizes = {r.incident_id: r.pool for r in R.pool_sizes(episodes, F.col("end_time")).collect()}
    assert sizes == {"query": 3, "old_best": 0, "tie_a": 0, "tie_b": 0, "edge": 1, "future": 5} or sizes["query"] == 3


def test_ranking_and_ties(spark):
    episodes, docs = search_frames(spark)
    found = R.retrieve(episodes, X.feature_vectors(episodes, docs, 1.0, 0.0), None, episodes.where("incident_id = 'query'").select("incident_id"), R.Search(outcome_gate=False))
    out = R.ranked_results(found, episodes, R.raw_codes(docs), X.ALARM_VERSION, "expanding_history").orderBy("rank").collect()
    assert [(r.candidate_incident_id, r.shared_alarm_codes, r.same_machine) for r in out] == [("old_best", ["11", "98"], True), ("tie_a", ["98"], False), ("tie_b", ["98"], True)]
    none = R.retrieve(episodes, X.feature_vectors(episodes, docs), None, episodes.where("incident_id = 'old_best'").select("incident_id"), R.Search(outcome_gate=False))
    assert none.count() == 0
    for bad in ({"k": 0}, {"policy": "x"}, {"thresholds": (0.0,)}):
        with pytest.raises(ValueError):
            R.Search(**bad)


def test_ranking_measures(spark):
    best = [{"similarity": 1.0, "end_us": 1, "candidate_id": str(i), "jaccard": j} for i, j in enumerate((0.1, 0.5, 0.5, 0.1))]
    found = spark.createDataFrame([("q", 4, [4], best)], f"incident_id string, pool long, relevant array<long>, best {R.BEST}")
    queries = spark.createDataFrame([("q", "validation"), ("i", "validation"), ("f", "validation"), ("n", "validation")], "incident_id string, split string")
    outcomes = spark.createDataFrame([("q", True, True), ("i", False, True), ("f", True, False), ("n", True, True)], "incident_id string, outcome_is_complete boolean, has_future_alarms boolean")
    records = R.query_records(queries, outcomes, found, R.Search(), "v").cache()
    r = {x.query_incident_id: x for x in records.collect()}
    from math import log2

    ideal = sum(1 / log2(k + 1) for k in range(1, 5))
    assert (r["q"].precision_at_k, r["q"].recall_at_k, r["q"].maximum_recall_at_k, r["q"].reciprocal_rank) == (0.4, 0.5, 1.0, 0.5)
    assert r["q"].ndcg_at_k == pytest.approx((1 / log2(3) + 1 / log2(4)) / ideal)
    assert [r[k].status for k in "ifn"] == list(R.STATUSES[:3]) and r["n"].precision_at_k is None
    one = R.split_metrics(records).first()
    assert (one.query_count, one.evaluated_query_count, one.evaluation_coverage, one.mean_precision_at_k) == (4, 1, 0.25, 0.4)


LABELS = "incident_id string, machine_id string, split string, outcome_is_complete boolean, future_alarm_codes array<string>, future_alarm_counts array<struct<alarm_code:string,n:bigint>>, has_future_alarms boolean, last_alarm_code string"


def label(i, machine, split, complete, counts, last="1"):
    return (i, machine, split, complete, sorted(counts), [{"alarm_code": c, "n": n} for c, n in sorted(counts.items())], bool(counts), last)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [label("a", "4", "train", True, {"98": 1, "11": 2}), label("b", "4", "train", True, {"98": 1}, "2"), label("x", "4", "train", False, {"137": 1}), label("c", "6", "train", True, {"26": 1}), label("e", "4", "validation", True, {"98": 1, "55": 3}), label("f", "9", "validation", True, {}), label("g", "4", "validation", False, {"98": 1})]
    return spark.createDataFrame(rows, LABELS)


def test_vocabulary_and_unknown_codes(labels):
    assert {(r.alarm_code, r.support) for r in Y.fit_vocabulary(labels).collect()} == {("98", 2), ("11", 1), ("26", 1)}
    codes = {r.incident_id: (r.known_codes, r.unknown_codes, r.unknown_event_count) for r in Y.encoded(labels, Y.fit_vocabulary(labels)).collect()}
    assert codes["e"] == (["98"], ["55"], 3) and codes["f"] == ([], [], 0)


def test_fallback_and_evaluation(labels):
    predicted = Y.predict(labels, Y.TRANSITION, 2, least_machine=2, least_transition=1).cache()
    got = {r.incident_id: (r.baseline_scope, [t.alarm_code for t in r.top]) for r in predicted.collect()}
    assert got["a"] == ("transition", ["11", "98"]) and got["b"] == ("transition", ["98", "11"])
    assert got["f"] == ("global_fallback", ["98", "11"])
    assert {r.incident_id: r.baseline_scope for r in Y.predict(labels, Y.TRANSITION, 2, 2, 9).collect()}["e"] == "machine_fallback"
    codes, vocabulary = Y.encoded(labels, Y.fit_vocabulary(labels)), Y.fit_vocabulary(labels)
    queries = Y.query_metrics(labels, codes, predicted, "validation", 2, Y.TRANSITION)
    assert {r.incident_id: (r.precision_at_k, r.recall_at_k) for r in queries.collect()} == {"e": (0.5, 1.0), "f": (0.0, None)}
    per_label = Y.label_metrics(labels, codes, predicted, vocabulary, "validation")
    one = Y.split_metrics(labels, queries, per_label, "validation", Y.TRANSITION, 2).first()
    assert (one.episode_count, one.complete_outcome_count, one.outcome_coverage, one.mean_recall_at_k) == (3, 2, pytest.approx(2 / 3), 1.0)
    groups = Y.support_groups(Y.support_profile(labels), 1, 3)
    assert sorted(r.support_group for r in Y.support_group_metrics(per_label, groups).collect()) == ["common", "medium", "rare"]
    with pytest.raises(ValueError):
        Y.support_groups(groups, 2, 3)


def test_selection(spark):
    rows = [("validation", Y.GLOBAL, 0.44, 0.05), ("validation", Y.MACHINE, 0.551, 0.072), ("validation", Y.TRANSITION, 0.553, 0.071), ("validation", "gru_none_v1", 0.6, 0.02)]
    df = spark.createDataFrame(rows, "split string, model_version string, micro_f1_at_k double, macro_f1_at_k double")
    one = Y.select_model(df, 0.01).first()
    assert (one.model_version, one.eligible_model_count, one.best_macro_f1) == (Y.TRANSITION, 2, 0.072)
    with pytest.raises(ValueError):
        Y.check_selection(df.withColumn("split", F.lit("test")))


def test_samples(spark):
    events = spark.createDataFrame([(at(0), "1", "4", 0), (at(0, 5), "1", "4", 1), (at(0, 30), "2", "4", 2), (at(1), "3", "4", 3), (at(1, 10), "3", "4", 4), (at(1, 40), "4", "4", 5)], EVENTS)
    pairs = S.paired_sequences(events, (0,), 60, 30)
    assert [(r.bin, r.x, r.y) for r in pairs.collect()] == [(0, ["1", "1", "2"], ["3", "3"])]
    both = pairs.union(pairs.withColumn("bin", F.lit(1).cast("long")))
    padded = S.padded_samples(both, sigma=1.0).orderBy("bin").collect()
    assert [(r.x, r.y, r.part) for r in padded] == [(["1", "2", "0"], ["3"], "train"), (["1", "2", "0"], ["3"], "test")]
    assert S.padded_samples(both, 1.0, before=True).first().x == ["0", "1", "2"]
    with pytest.raises(ValueError):
        S.windowed(events, (0,), 30, 60)


def test_sample_job(spark, tmp_path):
    import json

    from alarmloom.plans import sample_job as J

    events = spark.createDataFrame([(at(h, m), str(h % 3), "4", 2 * h + (m > 0)) for h in range(12) for m in (0, 20)], EVENTS)
    grid = J.parameter_grid((60, 120), (30,), (1,), (2.0,), (60,), drop=("9",))
    assert [(g.input_minutes, g.offsets, g.drop) for g in grid] == [(60, (0,), ("9",)), (120, (0, 60), ("9",))]
    done = J.create_samples(events, grid, str(tmp_path))
    for one in grid:
        plain = S.padded_samples(S.paired_sequences(events, one.offsets, one.input_minutes, one.output_minutes, one.min_count), one.sigma, one.drop)
        held = sorted(map(tuple, done[one.name].collect()))
        assert held and held == sorted(map(tuple, plain.collect()))
        again = J.create_samples(events.limit(0), [one], str(tmp_path), start=3)[one.name]  # phases 1 and 2 are taken from the store
        assert sorted(map(tuple, again.collect())) == held
    J.write_samples(again, f"{tmp_path}/json")
    assert sorted(map(tuple, J.read_samples(spark, f"{tmp_path}/json").collect())) == held
    (tmp_path / "published.json").write_text(json.dumps({"sample1": {"x_train": [1, 2], "y_train": [3], "serial": 4}, "sample2": {"x_test": [5], "y_test": [6], "serial": 4}}))
    assert sorted(map(tuple, J.read_published_samples(spark, f"{tmp_path}/published.json").collect())) == [("4", ["1", "2"], ["3"], "train"), ("4", ["5"], ["6"], "test")]
    for bad in ({"start": 0}, {"start": 4}):
        with pytest.raises(ValueError):
            J.create_samples(events, grid, str(tmp_path), **bad)
    with pytest.raises(ValueError):
        J.parameter_grid((30,), (60,), (1,), (3.0,), (10,))


def test_counts_after_episodes_equal_a_walk(spark):
    """Totals of inner buckets and events of the outer ones against every event by itself, limits and repeats included."""
    rng = random.Random(5)
    rows = [(at(0) + timedelta(minutes=rng.randrange(900)), str(rng.randrange(3)), str(rng.randrange(2)), i) for i in range(400)]
    ends = [(f"e{i}", str(i % 2), at(0) + timedelta(minutes=rng.randrange(900))) for i in range(60)]
    episodes = spark.createDataFrame(ends, "incident_id string, machine_id string, end_time timestamp_ntz")
    for hours in (1.0, 6.0, 0.05):
        found = {(r.incident_id, r.alarm_code): r.n for r in W.future_events(episodes, spark.createDataFrame(rows, EVENTS), ("machine_id",), hours).collect()}
        span = timedelta(hours=hours)
        want = Counter((e, code) for e, machine, end in ends for t, code, own, _ in rows if own == machine and end < t <= end + span)
        assert found == want


def test_sequences(spark):
    docs = spark.createDataFrame([("a", "train", "4", "98 11 98"), ("b", "test", "9", "7 11")], "incident_id string, split string, machine_id string, alarm_document string")
    got = {r.incident_id: (r.token_ids, r.sequence_length, r.machine_number) for r in Q.encode(docs, Q.fit(docs), 2).collect()}
    assert got == {"a": ([2, 3], 2, 1), "b": ([1, 2], 2, 0)}


def test_production_sequences_agree_with_their_sql_beyond_eight_events(spark):
    import duckdb
    from pathlib import Path

    from alarmloom.plans import catalogue

    folder = "/root/testdata/sf0.1"
    got = sorted(map(tuple, catalogue.queries()["sequence_encoding_production"](spark, folder).collect()))
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert got == sorted(db.execute(catalogue.oracle_sql()["sequence_encoding_production"]).fetchall())
    lengths = [row[2] for row in got]
    assert max(lengths) == 64 and sum(n > 8 for n in lengths) > len(lengths) / 2


def test_summaries():
    observed = [{"incident_id": "q", "machine_id": "4", "position": 1, "alarm_code": "98", "start_time": at(1), "end_time": at(2), "event_count": 1, "distinct_alarm_count": 1, "is_upper_tail": False}]
    evidence = [{"incident_id": "c", "rank": 1, "similarity_score": 0.5, "shared_alarm_codes": ["98"], "future_alarm_codes": [], "future_horizon_hours": 6.0}]
    found = V.Investigation(observed, evidence, [{"rank": 1, "alarm_code": "11", "model_score": 0.25, "baseline_scope": "transition", "train_support": 20}])
    plain = V.template_summary(found)
    assert "0.500" in plain.evidence[0][1] and "none" in plain.evidence[0][1] and "0.250" in plain.predictions[0] and not plain.used_fallback
    two = V.Investigation(observed, [*evidence, {**evidence[0], "rank": 2, "incident_id": "d"}], [])
    asked = []
    cited = V.guarded_summary(two, lambda request: asked.append(request) or {"overview": "x", "cited_incident_ids": ["d"], "cited_alarm_codes": ["98"]}, "p")
    assert [i for i, _ in cited.evidence] == ["d"] and {"task", "required_output"} <= set(asked[0]) and len(asked[0]["evidence"]) == 2
    good = V.guarded_summary(found, lambda _: {"overview": " fine ", "cited_incident_ids": ["c"], "cited_alarm_codes": ["11"]}, "p")
    assert (good.overview, good.generator, good.fallback_reason) == ("fine", "p", None)
    bad = V.guarded_summary(found, lambda _: {"overview": "x", "cited_incident_ids": ["z"], "cited_alarm_codes": []}, "p")
    assert bad.fallback_reason == "GuardrailError" and bad.overview == plain.overview and bad.used_fallback
    with pytest.raises(ValueError):
        V.Investigation([])
    for facts, match, score in (
        ({"event_count": 2}, {}, {}), ({"distinct_alarm_count": 0}, {}, {}), ({"gap_seconds": -1.0}, {}, {}), ({"gap_seconds": float("nan")}, {}, {}), ({"position": 2}, {}, {}), ({}, {"similarity_score": float("nan")}, {}),
        ({}, {"similarity_score": 1.1}, {}), ({}, {"rank": 0}, {}), ({}, {"future_horizon_hours": 0.0}, {}), ({}, {}, {"baseline_scope": "other"}), ({}, {}, {"train_support": -1}), ({}, {}, {"rank": 0}),
    ):
        with pytest.raises(ValueError):
            V.Investigation([{**observed[0], **facts}], [{**evidence[0], **match}], [{**found.predictions[0], **score}])


def test_one_call_investigation(spark):
    from alarmloom.plans.forecast_queries import Forecast, LEAST_MACHINE, LEAST_TRANSITION
    from alarmloom.plans.log_queries import B as baselines

    folder = "/root/testdata/sf0.001"
    forecast = Forecast(spark, folder)
    inputs = forecast.inputs
    flagged = baselines.apply_flags(inputs.episodes, baselines.fit_global(inputs.episodes), baselines.fit_machines(inputs.episodes))
    service = V.Investigator(flagged, inputs.events, inputs.documents, inputs.vectors(1.0), inputs.outcomes(6.0), forecast.labels, LEAST_MACHINE, LEAST_TRANSITION)
    episode = flagged.where("split = 'test'").orderBy("start_time", "incident_id").first()
    found = service.investigate(episode.incident_id, k=3)
    assert len(found.observed) == episode.event_count and len(found.predictions) == 3
    expected = V.retrieved_evidence(*V.online_results(inputs, "test", 3)).where(F.col("query_incident_id") == episode.incident_id).orderBy("rank").collect()
    assert [(e["rank"], e["incident_id"]) for e in found.evidence] == [(r["rank"], r.incident_id) for r in expected]
    assert all(e["end_time"] < episode.start_time for e in found.evidence)
    assert V.template_summary(found).observed_facts and service.machine_ids() and service.options(episode.machine_id).count()
    with pytest.raises(KeyError):
        service.investigate("none")


def test_csv_of_several_files(spark, tmp_path):
    from alarmloom.sources.events import read_alarm_csv, write_alarm_csv

    (tmp_path / "b.csv").write_text("timestamp,alarm,serial\n" + "".join(f"2019-02-21 10:00:{i:02d}.5,{i},4\n" for i in range(40)))
    (tmp_path / "a.csv").write_text("timestamp,alarm,serial\n" + "".join(f"2019-02-20 10:00:{i:02d}.25,{100 + i},6\n" for i in range(3)))
    got = read_alarm_csv(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [(r.source_row, r.alarm_code) for r in got] == list(enumerate([str(100 + i) for i in range(3)] + [str(i) for i in range(40)]))
    write_alarm_csv(read_alarm_csv(spark, str(tmp_path)), str(tmp_path / "out"))
    assert [tuple(r) for r in read_alarm_csv(spark, str(tmp_path / "out")).orderBy("source_row").collect()] == [tuple(r) for r in got]


def test_csv_contract(spark, tmp_path):
    from alarmloom.sources.events import ContractError, read_alarm_csv

    good = "timestamp,alarm,serial\n2019-02-21 10:00:00.000,139,4\n2019-02-21 09:00:00.123456,31,6\n"
    path = tmp_path / "a.csv"
    path.write_text(good)
    got = [tuple(r) for r in read_alarm_csv(spark, str(path)).orderBy("source_row").collect()]
    assert got == [(at(10), "139", "4", 0), (at(9, 0, 0, 123456), "31", "6", 1)]
    for bad in (good.replace("139", "x9"), good.replace(",4\n", ",\n"), good.replace("10:00:00.000", "10:00"), good.replace("serial", "other"), "timestamp,alarm\n"):
        path = tmp_path / f"{hash(bad)}.csv"
        path.write_text(bad)
        with pytest.raises(ContractError):
            read_alarm_csv(spark, str(path))


def test_settings():
    from alarmloom.plans.settings import SettingsError, parse

    assert parse({}).retrieval.top_k == 5
    for bad in ({"retrieval": {"future_horizon_hours": 6}}, {"retrieval": {"top_k": 0}}, {"forecasting": {"selected_forecast_horizon_hours": 5}}, {"forecasting": {"common_min_train_support": 50}}, {"split": {"train_ratio": 0.9}}, {"nothing": {}}, {"baselines": {"quantile": 1.5}}):
        with pytest.raises(SettingsError):
            parse(bad)


def test_artifact_folder(tmp_path, monkeypatch):
    from alarmloom.plans import artifacts as A

    assert A.artifact_folder(tmp_path) == tmp_path / "data" / "deployment" and len(A.missing_artifacts(tmp_path)) == 4
    (tmp_path / "data" / "processed").mkdir(parents=True)
    for name in A.CORE:
        (tmp_path / "data" / "processed" / name).touch()
    assert A.artifact_folder(tmp_path) == tmp_path / "data" / "processed" and not A.missing_artifacts(tmp_path)
    monkeypatch.setenv(A.FOLDER_VARIABLE, "other")
    assert A.artifact_folder(tmp_path) == tmp_path / "other"
    with pytest.raises(ValueError):
        A.checked_time(datetime(2020, 1, 1))


def test_portable_model(labels):
    from alarmloom.plans.artifacts import RuntimeModel, model_json

    model = RuntimeModel(model_json(labels, 2, 1))
    assert model.predict("4", "2", 1)[0]["alarm_code"] == "98" and model.predict("4", "2")[0]["baseline_scope"] == "transition"
    assert model.predict("4", "77")[0]["baseline_scope"] == "machine_fallback" and model.predict("4", "77")[0]["train_support"] == 2
    assert model.predict("0", "77")[0]["train_support"] == 2
    broken = model_json(labels, 2, 1)
    broken["global_scores"] = broken["global_scores"][:-1]
    with pytest.raises(ValueError):
        RuntimeModel(broken)


def test_streaming_sessions_agree_with_the_batch_rule(spark, tmp_path):
    from alarmloom.streaming.sessions import streaming_sessions

    start = at(0)
    minutes = [0, 10, 40, 71, 72, 200, 229, 260]
    rows = [(start + timedelta(minutes=m), "1", "4", i) for i, m in enumerate(minutes)] + [(start + timedelta(minutes=90), "1", "6", 90), (start + timedelta(days=3), "1", "6", 91)]
    events = spark.createDataFrame(rows, EVENTS)
    batch = E.summarize(I.add_gaps(events).withColumns({"split": F.lit("train"), "is_exact_duplicate": F.lit(False)})).select("machine_id", "start_time", "end_time", "event_count")
    assert sorted(map(tuple, streaming_sessions(events).select("machine_id", "start_time", "end_time", "event_count").collect())) == sorted(map(tuple, batch.collect()))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    closed = {r for r in map(tuple, batch.collect()) if r[2] < at(0) + timedelta(days=1)}
    assert set(map(tuple, spark.table("sessions").select("machine_id", "start_time", "end_time", "event_count").collect())) == closed


def test_jobs_end_to_end(spark, tmp_path, capsys):
    from alarmloom import cli
    from alarmloom.plans.settings import parse

    start = at(0)
    lines = ["timestamp,alarm,serial"] + [f"{start + timedelta(minutes=17 * i + (i % 5) * 13)}.000,{(i * 7) % 5},{i % 2}" for i in range(240)]
    source = tmp_path / "log.csv"
    source.write_text("\n".join(lines) + "\n")
    chosen = {"selected_feature_version": X.COMBINED_VERSION, "future_horizon_hours": 1, "relevance_threshold": 0.3}
    settings = parse({"baselines": {"minimum_incident_count": 2}, "retrieval": chosen, "forecasting": {"minimum_machine_train_samples": 2, "minimum_transition_train_samples": 1, "selected_forecast_horizon_hours": 1, "rare_max_train_support": 2, "common_min_train_support": 9}})
    out, results = str(tmp_path / "data"), str(tmp_path / "results")
    cli.prepare_data(spark, str(source), out, settings)
    args = cli.build_parser().parse_args(["prepare-samples", "--inputs", "240", "--outputs", "120", "--min-counts", "1", "--offset-steps", "120"])
    grid = cli.parameter_grid(args.inputs, args.outputs, args.min_counts, args.sigmas, args.offset_steps)
    cli.prepare_samples(spark, out, str(tmp_path / "samples"), grid, args.start)
    assert spark.read.json(f"{tmp_path}/samples/{grid[0].name}/json").count()
    cli.prepare_incidents(spark, out, settings)
    cli.test_retrieval(spark, out, settings, results)
    cli.test_forecast(spark, out, settings, results)
    for name in ("retrieval_test_results.csv", "forecast_test_results.csv", "forecast_test_support_groups.csv", "forecast_model.json"):
        assert (tmp_path / "results" / name).stat().st_size
    import json

    from alarmloom.plans.artifacts import evaluation_tables

    for name in ("retrieval_test", "forecast_test"):
        about = json.loads((tmp_path / "results" / f"{name}.metadata.json").read_text())
        assert about["is_final_test"] and about["result_rows"] == 1 and about["sources"]["events"]["sha256"] and about["generated_at"]
    assert set(evaluation_tables(spark, results)) == {"retrieval", "forecast", "groups"}
    cli.validate_retrieval(spark, out, settings, str(tmp_path / "none"), 20, diagnostics_only=True)
    assert not (tmp_path / "none").exists() and "hit_at_5" in capsys.readouterr().out


def test_entry_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", "corpus_pipeline.py")])
    check = "import __spark_entry__ as e; q = e.queries(); assert e.__file__.startswith(sys.argv[1]) and 'pipeline' not in q and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", "import sys; " + check, str(copy)], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin"})


def test_exact_places_of_a_group_of_a_million_values(spark):
    """No window sees a group: all places come from sums of ranges; hot, tied, negative and tiny groups side by side."""
    import numpy as np

    from alarmloom.functions.quantiles import neighbours, upper_place, values_at

    hot = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 1e3).alias("x"), (F.col("id") % 3).alias("y"))
    rest = [("tied", 5.0, 1)] * 40 + [("one", -2.5, 9)] + [("mixed", (-1.0) ** k * 10.0 ** (k % 9 - 4), k) for k in range(101)]
    df = hot.unionByName(spark.createDataFrame(rest, "g string, x double, y long")).cache()
    places = (upper_place(0.95, "x", "high"), *neighbours(0.5, "x", "median"), upper_place(0.3, "y", "third"))
    out = values_at(df, ("g",), places)
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r.g: r for r in out.collect()}
    for g, rows in df.toPandas().groupby("g"):
        x, y = np.sort(rows.x.to_numpy()), np.sort(rows.y.to_numpy())
        n = len(x)
        expected = (n, x[int(np.ceil((n - 1) * 0.95))], x[(n - 1) // 2], x[n // 2], float(y[int(np.ceil((n - 1) * 0.3))]))
        assert (got[g].total, got[g].high, got[g].median_low, got[g].median_high, got[g].third) == expected
    df.unpersist()


def test_cut_days_give_what_whole_days_give(spark, monkeypatch):
    import random

    draw, moment, rows = random.Random(11), datetime(2020, 1, 1, 23), []
    for k in range(600):
        moment += timedelta(seconds=draw.choice((0, 0, 1, 30, 1799, 1801)) if k % 100 else 90_000)
        rows.append((moment, draw.choice("xxy"), "b" if k % 7 == 0 else "a", k))
    rows += [(datetime(2020, 1, 3), "z", "a", 600 + k) for k in range(80)]  # one time, in one block
    events = spark.createDataFrame(rows, EVENTS)

    def results():
        done = I.processed_events(events)
        tables = (done, E.identify_events(done), E.transition_view(done), E.summarize(done))
        return [sorted(map(tuple, t.collect()), key=repr) for t in tables]

    whole = results()
    monkeypatch.setattr(I, "MOST_IN_BLOCK", 20)
    assert I.in_blocks(events).select("machine_id", "block").distinct().count() > 100
    assert results() == whole


def test_a_day_of_a_million_events_is_many_blocks(spark):
    n = 1_000_000
    moment = F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.col("id") * 40_000).cast("timestamp_ntz")
    code = (F.floor(F.col("id") / 3) % 5).cast("string")
    events = spark.range(n, numPartitions=8).select(moment.alias("timestamp"), code.alias("alarm_code"), F.lit("m").alias("machine_id"), F.col("id").alias("source_row"))
    sizes = I.in_blocks(events).groupBy("block").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 100 and sizes[1] < n / 20
    ready = events.withColumns({"gap_seconds": F.when(F.col("source_row") > 0, F.lit(0.04)), "split": F.lit("train"), "is_exact_duplicate": F.lit(False)})
    runs = E.transition_view(ready)
    assert runs.agg(F.count("*"), F.max("run"), F.countDistinct("incident_id"), F.sum("repeat_count"), F.max("repeat_count")).first()[:] == (-(-n // 3), -(-n // 3) - 1, 1, n, 3)
    back = events.withColumn("timestamp", F.when(F.col("source_row") % 100_000 == 0, F.lit(datetime(2020, 1, 1)).cast("timestamp_ntz")).otherwise(F.col("timestamp")))
    assert tuple(P.time_reversals(back).first()) == (9, 9)


def expected_transitions(rows, gap, horizon):
    """Counts of a plain walk over each machine's log: rows of (time, code, machine, row)."""
    hits, samples = Counter(), Counter()
    for machine in {r[2] for r in rows}:
        log = sorted((r for r in rows if r[2] == machine), key=lambda r: (r[0], r[3]))
        ends = [a for a, b in zip(log, log[1:]) if b[0] - a[0] > gap]
        for end in ends:
            if log[-1][0] >= end[0] + horizon:
                samples[machine, end[1]] += 1
                for code in {r[1] for r in log if end[0] < r[0] <= end[0] + horizon}:
                    hits[machine, end[1], code] += 1
    return sorted((m, last, code, n, samples[m, last]) for (m, last, code), n in hits.items())


def test_streamed_transitions_with_late_rows_and_a_restart(spark, tmp_path):
    from alarmloom.streaming.transitions import COUNTS, current_counts, write_transition_changes

    draw, moment, rows = random.Random(21), datetime(2020, 1, 1), []
    for k in range(400):
        moment += timedelta(minutes=draw.choice((0, 1, 5, 29, 30, 31, 45, 200)))
        rows.append((moment, draw.choice("abc"), draw.choice("mn"), k))
    rows.append((rows[-1][0] + timedelta(hours=6), "a", "m", 400))
    end = (rows[-1][0] + timedelta(days=2), None, None, -1)
    late = (rows[0][0], "z", "m", 401)
    log, out, state = (str(tmp_path / n) for n in ("log", "changes", "state"))

    def run(*files):
        for part in files:  # rows of a file in no order
            spark.createDataFrame(draw.sample(part, len(part)), EVENTS).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).option("maxFilesPerTrigger", 1).parquet(log)
        write_transition_changes(stream, out, state, lateness="1 hour").awaitTermination()
        return sorted(map(tuple, current_counts(spark.read.schema(COUNTS).parquet(out)).select("machine_id", "last_alarm_code", "alarm_code", "hits", "samples").collect()))

    half = run(rows[:100], rows[100:220])
    assert 0 < len(half) and sum(r[3] for r in half) < sum(r[3] for r in expected_transitions(rows, timedelta(minutes=30), timedelta(hours=6)))
    # the same checkpoint goes on: what is before the watermark is dropped, all else counted once
    assert run(rows[220:300], rows[300:], [late], [end]) == expected_transitions(rows, timedelta(minutes=30), timedelta(hours=6))


class HeldState(dict):
    """A map or value state as a dict that counts what reaches it."""

    calls = 0

    def called(name):
        def call(self, *args):
            HeldState.calls += 1
            return getattr(self, "_" + name)(*args)

        return call

    containsKey, getValue, updateValue, removeKey, exists, get, update = map(called, ("has", "at", "put", "drop", "exists", "value", "keep"))
    _has, _at, _put, _drop = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__
    _exists, _value, _keep = (lambda self: "value" in self), (lambda self: self["value"]), (lambda self, v: self.__setitem__("value", v))

    def keys(self):
        return iter(list(dict.keys(self)))

    def iterator(self):
        return iter(list(self.items()))


def test_transition_state_is_called_by_moments_and_counts_not_by_events():
    """4,000 events of 40 moments: the state is called some times a moment, whichever rows the watermark has passed."""
    import pandas as pd

    from alarmloom.streaming.transitions import TransitionCounter

    start, minute, draw = datetime(2020, 1, 1), 60_000_000, random.Random(3)
    rows = [(start + timedelta(minutes=40 * (k // 100)), draw.choice(("a", "", "c\nc", 'd"')), "m", k) for k in range(4000)]
    start_us = round((start - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    events = pd.DataFrame([(start_us + (r[0] - start) // timedelta(microseconds=1), r[3], r[1]) for r in draw.sample(rows, len(rows))], columns=["us", "source_row", "alarm_code"])

    class Handle:
        timers = []

        def getMapState(self, *_):
            return HeldState()

        def getValueState(self, *_):
            return HeldState()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Watermark:
        def __init__(self, us):
            self.us = us

        def getCurrentWatermarkInMs(self):
            return self.us // 1000

    counter, changes = TransitionCounter(30 * minute, 360 * minute), []
    counter.init(Handle())
    HeldState.calls = 0
    for part in (events[:2500], events[2500:]):
        list(counter.handleInputRows(("m",), iter([part]), None))
    assert Handle.timers[-1] * 1000 > int(events["us"].max())
    for passed in (start_us + 13 * 40 * minute + 5, start_us + 10_000 * minute):
        changes += [r for f in counter.handleExpiredTimer(("m",), Watermark(passed), None) for r in f.itertuples(index=False, name=None)]
    samples = {(m, last): n for m, last, _, _, n in sorted(changes, key=lambda r: r[4])}
    hits = {(m, last, code): n for m, last, code, n, _ in sorted((r for r in changes if r[2] is not None), key=lambda r: r[3])}
    assert sorted((m, last, code, n, samples[m, last]) for (m, last, code), n in hits.items()) == expected_transitions(rows, timedelta(minutes=30), timedelta(hours=6))
    assert HeldState.calls < 600


def test_npz_round_trip_ranges_and_failures(spark, tmp_path, monkeypatch):
    import numpy as np

    from alarmloom.sources import npz

    npz.register(spark)
    rows = [(i, f"m{i % 3}", i / 7, [str(i % 5), "é漢", ""], [i, -i]) for i in range(1000)]
    schema = "id long, machine string, x double, codes array<string>, pair array<int>"
    df, path = spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "a")
    df.write.format("npz").mode("overwrite").save(path)
    back = spark.read.format("npz").schema(schema).load(path)
    assert sorted(map(tuple, back.collect())) == rows
    assert len(list((tmp_path / "a").glob("*.npz"))) == 3 and not list((tmp_path / "a").glob("_staging*"))
    held = np.load(next((tmp_path / "a").glob("*.npz")))  # NumPy reads them without pickle
    assert held["codes"].shape[1] == 3 and held["id"].dtype == np.int64
    reader = npz.NpzReader(df.schema, path)
    with monkeypatch.context() as m:
        m.setattr(npz, "RANGE_ROWS", 100)
        parts = reader.partitions()
        assert len(parts) >= 10 and sum(len(b) for p in parts for b in reader.read(p)) == 1000
    # appended rows come besides; a failed write leaves what was there
    df.limit(10).write.format("npz").mode("append").save(path)
    assert back.count() == 1000 and spark.read.format("npz").schema(schema).load(path).count() == 1010
    bad = spark.createDataFrame([(1, None, 0.0, ["a"], [1])], schema)
    with pytest.raises(Exception, match="no nulls"):
        bad.union(df).write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").schema(schema).load(path).count() == 1010 and not list((tmp_path / "a").glob("_staging*"))
    df.limit(0).write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").schema(schema).load(path).count() == 0


def test_npz_files_and_ranges_of_wide_rows_are_bounded_by_cells(tmp_path, monkeypatch):
    """Wide rows: a task holds a file's cells, a range's and a piece's, however many rows it is given."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    from alarmloom.sources import npz

    for name, value in {"FILE_CELLS": 1000, "RANGE_CELLS": 400, "PIECE_CELLS": 150}.items():
        monkeypatch.setattr(npz, name, value)
    schema = StructType().add("id", LongType()).add("codes", ArrayType(StringType()))
    rows = [{"id": k, "codes": [str(k)] * 99} for k in range(50)]
    kind, path = pa.schema([("id", pa.int64()), ("codes", pa.list_(pa.string()))]), str(tmp_path)
    writer = npz.NpzWriter(schema, path, True)
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows[:37], kind), pa.RecordBatch.from_pylist(rows[37:], kind)]))])
    assert [len(np.load(f)["id"]) for f in tmp_path.glob("*.npz")] == [10] * 5
    reader = npz.NpzReader(schema, path)
    parts = reader.partitions()
    assert max(p.stop - p.start for p in parts) == 4
    read = [b for p in parts for b in reader.read(p)]
    assert max(b.num_rows for b in read) == 1 and sorted((r for b in read for r in b.to_pylist()), key=lambda r: r["id"]) == rows
    ragged = pa.RecordBatch.from_pylist([rows[0], {"id": 1, "codes": ["a"]}], kind)
    with pytest.raises(ValueError, match="pad them first"):
        writer.write(iter([ragged]))


def test_relevant_counts_and_best_against_all_pairs(spark):
    """Prefix and size filters lose no pair at any threshold, and the posting blocks no candidate."""
    draw, rows = random.Random(31), []
    for k in range(160):
        begin = at(0) + timedelta(minutes=draw.randint(0, 1200))
        rows.append((f"e{k:03}", draw.choice("mn"), draw.choice(("train", "test")), begin, begin + timedelta(minutes=draw.choice((1, 5, 25))), draw.randint(1, 9), draw.random() * 99, 2))
    episodes = spark.createDataFrame(rows, TIMED + ", event_count long, duration_seconds double, distinct_alarm_count long")
    docs = spark.createDataFrame([(r[0], r[2], r[1], " ".join(draw.choices("123456789", k=draw.randint(1, 6)))) for r in rows], "incident_id string, split string, machine_id string, alarm_document string")
    sets = {r[0]: sorted(draw.sample("abcdefghij", draw.randint(0, 7))) for r in rows}
    done = {r[0]: draw.random() < 0.9 for r in rows}
    outcomes = spark.createDataFrame([(r[0], r[4] + timedelta(minutes=10), done[r[0]], sets[r[0]]) for r in rows], "incident_id string, outcome_end_time timestamp_ntz, outcome_is_complete boolean, future_alarm_codes array<string>")
    for shape in (0.0, 1.0):
        vectors = X.feature_vectors(episodes, docs, 1.0, shape).cache()
        v = {r.incident_id: ({t.token: t.weight for t in r.terms}, r.shape) for r in vectors.collect()}

        def similar(q, c):
            return round(sum(w * v[c][0].get(t, 0.0) for t, w in v[q][0].items()) + sum(a * b for a, b in zip(v[q][1], v[c][1])), 12)

        def overlap(q, c):
            a, b = set(sets[q]), set(sets[c])
            return len(a & b) / len(a | b) if a | b else 0.0

        search = R.Search(k=4, thresholds=(0.1, 0.3, 0.5, 1.0))
        got = {r.incident_id: r for r in R.retrieve(episodes, vectors, outcomes, episodes, search).collect()}
        for q in rows:
            pool = [c for c in rows if done[c[0]] and c[4] + timedelta(minutes=10) < q[3]]
            assert (q[0] in got) == bool(pool)
            if pool:
                r = got[q[0]]
                assert r.pool == len(pool) and r.relevant == [sum(overlap(q[0], c[0]) >= t for c in pool) for t in search.thresholds]
                best = sorted(pool, key=lambda c: (-similar(q[0], c[0]), -c[4].timestamp(), c[0]))[:4]
                assert [b.similarity for b in r.best] == pytest.approx([similar(q[0], c[0]) for c in best], abs=1e-11)
                assert [b.jaccard for b in r.best] == [overlap(q[0], b.candidate_id) for b in r.best]


def test_relevant_counts_in_tiles_make_no_row_for_a_pair(spark, monkeypatch):
    """Sets that nearly all share codes: counted block by block, in many tiles, as brute force does, without a join of sets."""
    draw, thresholds = random.Random(47), (0.1, 0.3, 0.5, 1 / 3, 1.0)
    words = [None, "", *(f"c{k}" for k in range(40))]
    rows = [(f"e{k:03}", draw.randint(0, 300), draw.choice((None, *range(0, 300, 7))), draw.sample(words, draw.choice((0, 1, 2, 25, 38))) if k % 9 else ["x", "y"], draw.random() < 0.5) for k in range(300)]
    frame = spark.createDataFrame(rows, "incident_id string, start_us long, moment long, codes array<string>, asked boolean").cache()
    expected = {q[0]: [sum(c[2] is not None and c[2] < q[1] and bool(set(q[3]) & set(c[3])) and len(set(q[3]) & set(c[3])) / len(set(q[3]) | set(c[3])) >= t for c in rows) for t in thresholds] for q in rows if q[4]}
    for name, value in {"QUERY_BLOCK": 60, "HELD_BLOCK": 100}.items():
        monkeypatch.setattr(R, name, value)
    found = R.relevant_counts(frame, thresholds)
    assert {r[0]: list(r[1:]) for r in found.collect()} == expected
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for name, value in {"QUERY_TILE": 11, "HELD_TILE": 17, "CODE_TILE": 6}.items():
        monkeypatch.setattr(R, name, value)
    table = frame.toArrow()
    asked, held = table.filter(table["asked"]), table.filter(table["moment"].is_valid())
    assert {r[0]: list(r[1:]) for r in zip(*(R.relevant_in_block(asked, held, thresholds).to_pydict().values()))} == expected
    assert R.relevant_counts(frame.where("false"), thresholds).count() == 0


def test_bundles_are_committed_at_once(spark, tmp_path):
    from alarmloom.functions import storage
    from alarmloom.plans.bundles import Bundle, Loader

    bundle = Bundle(spark, str(tmp_path / "b"))
    with pytest.raises(KeyError):
        bundle.frame("a")
    with bundle.change() as new:
        again = new.frame("a", spark.range(5))
        new.data("sum", {"n": again.count()})
        assert bundle.manifests() == []  # nothing to see before the end
    assert bundle.frame("a").count() == 5 and bundle.data("sum") == {"n": 5} and bundle.damaged() == []
    loader = Loader(bundle)
    first, other = loader.frame("a"), loader.made("twice", ("a",), lambda: bundle.frame("a").selectExpr("id * 2 AS id"))
    with pytest.raises(ZeroDivisionError), bundle.change() as new:
        new.frame("a", spark.range(9))
        1 / 0
    assert bundle.frame("a").count() == 5 and len(list((tmp_path / "b" / "states").iterdir())) == 1
    assert loader.frame("a") is first and "InMemoryTableScan" in first._jdf.queryExecution().executedPlan().toString()
    with bundle.change() as new:
        new.frame("a", spark.range(7))
    assert bundle.frame("a").count() == 7 and bundle.data("sum") == {"n": 5}
    assert loader.frame("a") is not first and loader.frame("a").count() == 7
    assert loader.made("twice", ("a",), lambda: bundle.frame("a").selectExpr("id * 2 AS id")).agg(F.max("id")).first()[0] == 12 and not other.is_cached
    for n in range(3):
        with bundle.change() as new:
            new.data("sum", n)
    assert len(bundle.manifests()) == 2 and bundle.frame("a").count() == 7 and bundle.data("sum") == 2
    part = next((tmp_path / "b").glob("states/*/a.parquet/*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)  # a local file system's own checksum
    (tmp_path / "b" / "plain").write_bytes(b"")
    assert bundle.damaged() == ["a"]
    assert len(storage.content_digest(spark, str(tmp_path / "b" / "plain"))) == 64
    with pytest.raises(FileNotFoundError):
        storage.content_digest(spark, str(tmp_path / "none"))


def test_digests_do_not_depend_on_tasks(spark, tmp_path, monkeypatch):
    import hashlib

    from alarmloom.functions import storage

    for folder in ("a", "b"):
        (tmp_path / folder / "in").mkdir(parents=True)
        for k in range(9):
            (tmp_path / folder / "in" / f"f{k}.bin").write_bytes(bytes(range(256)) * (k * 40))
    monkeypatch.setattr(storage, "CHUNK", 1000)
    one = storage.content_digest(spark, str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert storage.content_digest(spark, str(tmp_path / "b")) == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    data = (tmp_path / "a" / "in" / "f3.bin").read_bytes()
    leaf = hashlib.sha256("".join(hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)).encode()).hexdigest()
    group = hashlib.sha256(f":{leaf}".encode()).hexdigest()
    got = storage.content_digest(spark, str(tmp_path / "a" / "in" / "f3.bin"))
    assert got in {hashlib.sha256(f"{g:03}:{group}".encode()).hexdigest() for g in range(256)}
    (tmp_path / "b" / "in" / "f8.bin").rename(tmp_path / "b" / "in" / "f9.bin")
    assert storage.content_digest(spark, str(tmp_path / "b")) != one


def test_investigation_from_a_bundle(spark, tmp_path):
    from alarmloom.plans.bundles import Bundle, Loader, load_investigation_resources, write_investigation_bundle

    draw, moment, rows = random.Random(3), datetime(2020, 1, 1), []
    for k in range(300):
        moment += timedelta(minutes=draw.choice((1, 5, 40, 90)))
        rows.append((moment, draw.choice("abc"), draw.choice("mn"), k))
    events = I.processed_events(spark.createDataFrame(rows, EVENTS)).cache()
    episodes = E.summarize(events).cache()
    flagged = B.apply_flags(episodes, B.fit_global(episodes), B.fit_machines(episodes, least=5))
    bundle = Bundle(spark, str(tmp_path / "b"))
    write_investigation_bundle(bundle, events, flagged, E.event_mapping(events))
    loader = Loader(bundle)
    held = load_investigation_resources(loader)
    asked = episodes.orderBy(F.col("start_time").desc(), "incident_id").first().incident_id
    found = held.investigate(asked, k=3)
    assert len(found.observed if hasattr(found, "observed") else next(iter(vars(found).values())))
    again = load_investigation_resources(loader)
    assert all(getattr(again, n) is getattr(held, n) for n in ("flagged", "events", "documents", "vectors", "outcomes", "labels"))


def test_a_session_made_first_gets_the_package(tmp_path):
    """Workers of a session that was started before the entry was imported, elsewhere, import the package too."""
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(1).count()
import sys
sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
import __spark_entry__
print("ROWS", __spark_entry__.queries()["retrieval_topk_alarm"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_text_of_a_very_long_episode(spark):
    n = 3 * X.PART + 5
    rows = spark.range(n).select(F.lit("m").alias("machine_id"), F.lit("i").alias("incident_id"), F.lit("train").alias("split"), F.col("id").alias("event_position"), (F.col("id") % 97).cast("string").alias("alarm_code"))
    one = X.documents_of(rows.orderBy(F.rand(2)).repartition(5)).first()
    assert one.alarm_token_count == n and one.alarm_document == " ".join(str(k % 97) for k in range(n))
