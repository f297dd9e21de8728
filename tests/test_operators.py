"""Formulas against short plain definitions, edge rows, and planted outliers."""

import json
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietsignal import cli
from quietsignal.functions.score import combine, exp_scale, logistic_scale, tag
from quietsignal.operators import alerts, density, drift, explore, forecast, forest, models, profile, projection, record, series
from quietsignal.operators.record import Settings
from quietsignal.plans import sql, workflows
from quietsignal.sources import files, generators
from quietsignal.streaming import scorers

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, rows, schema="k string, i long, v double"):
    return spark.createDataFrame(rows, schema)


@FEW
@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=12))
def test_zscore_formula(spark, values):
    rows = [("a", i, float(v)) for i, v in enumerate(values)]
    s = Settings(["k"], ["v"])
    got = {r["i"]: r["score"] for r in record.zscore(table(spark, rows), models.moments(table(spark, rows), ["k"], ["v"]), s).collect()}
    m, sd = statistics.fmean(values), statistics.pstdev(values)
    for i, v in enumerate(values):
        if sd > 1e-6:
            assert got[i] == pytest.approx(abs(v - m) / sd, rel=1e-6, abs=1e-6)


@FEW
@given(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=12), st.floats(-50, 50), st.floats(0.5, 4))
def test_robust_zscore_ignores_shift_and_scale(spark, values, shift, scale):
    run = lambda vs: [r["score"] for r in record.detect(table(spark, [("a", i, float(v)) for i, v in enumerate(vs)]), "robustZscore", Settings([], ["v"], threshold=3)).orderBy("i").collect()]
    a, b = run(values), run([shift + scale * v for v in values])
    med = statistics.median(values)
    if statistics.median(abs(v - med) for v in values) > 1e-3:
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)


def test_scores_without_a_model_or_spread(spark):
    rows = table(spark, [("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, 1.0), ("b", 4, 3.0), ("c", 5, 2.0), (None, 6, None)])
    model = models.moments(rows.where("k <> 'c'"), ["k"], ["v"])
    out = {r["i"]: (r["score"], r["tag"]) for r in record.zscore(rows, model, Settings(["k"], ["v"])).withColumn("tag", tag(F.col("score"), 0.5)).collect()}
    assert out[1] == (None, "I") and out[5] == (None, "I") and out[3] == (1.0, "O") and out[6] == (None, "I")


@pytest.mark.parametrize(("how", "weights", "want"), [("average", None, 2.0), ("weightedAverage", [1, 5, 3], 2.5), ("median", None, 2.0), ("max", None, 3.0), ("min", None, 1.0)])
def test_combinations_leave_out_nulls(spark, how, weights, want):
    row = spark.range(1).select(combine([F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)], how, weights).alias("x"), combine([F.lit(None).cast("double")], how, [1.0]).alias("y")).first()
    assert row["x"] == want and row["y"] is None


def test_scaling(spark):
    row = spark.range(1).select(exp_scale(2, F.lit(0.5)).alias("e"), logistic_scale(5000, F.lit(-100.0)).alias("l")).first()
    assert row["e"] == pytest.approx(1 - math.exp(-1)) and row["l"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize(("polarity", "low", "want"), [("high", None, "NNO"), ("low", None, "ONN"), ("both", 2.0, "OON"), ("all", None, "AAA")])
def test_polarity(spark, polarity, low, want):
    limit = 2.0 if polarity in ("high", "low") else 5.0
    rows = table(spark, [("a", i, float(v)) for i, v in enumerate([0.0 if polarity != "low" else 1.0, 1.0 if polarity == "both" else 2.0, 3.0])])
    assert "".join(r["t"] for r in rows.orderBy("i").select(tag(F.col("v"), limit, polarity, low).alias("t")).collect()) == want


def test_mahalanobis_in_three_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0, 0, 2]])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    got = [r["score"] for r in record.detect(rows, "mahalanobis", Settings([], ["a", "b", "c"])).orderBy("i").collect()]
    d = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T, bias=True)), d))


def test_unseen_bins(spark):
    old, new = table(spark, [("a", i, float(i % 3)) for i in range(9)]), table(spark, [("a", 1, 0.0), ("a", 2, 77.0), ("z", 3, 0.0)])
    bins = {"b": models.bin_of(F.col("v"), 1)}
    h = models.histogram(old, ["k"], list(bins.values()), ["b"])
    out = {r["i"]: r["score"] for r in record.bin_probability(new, h, ["k"], bins, "log").collect()}
    assert out[1] == pytest.approx(math.log(3)) and out[2] == 20.0 and out[3] is None
    marginal = {r["i"]: r["score"] for r in record.marginal_probability(new, h, ["k"], bins, [1.0], only_if_missing=True).collect()}
    assert marginal[1] == 0.0 and marginal[2] == 1.0
    gain = {r["i"]: r["score"] for r in record.entropy_increase(new, h, ["k"], bins).collect()}
    assert gain[2] > 0


def test_lof_finds_the_far_point_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 2)), [[9.0, 9.0]]])
    rows = spark.createDataFrame([("k", i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "k string, i long, v array<double>")
    one, many = (density.nearest(rows, ["k"], "i", "v", 3, block=b) for b in (1000, 9))
    assert sorted(one.collect()) == sorted(many.collect())
    assert density.lof(one).orderBy(F.col("lof").desc()).first()["source"] == 60
    turned = rows.withColumn("v", F.array(-F.get("v", F.lit(1)) + 5, F.get("v", F.lit(0))))
    a, b = ({r["source"]: r["lof"] for r in density.lof(density.nearest(d, ["k"], "i", "v", 3)).collect()} for d in (rows, turned))
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    with pytest.raises(ValueError, match="all pairs"):
        density.pair_distances(rows, ["k"], "i", "v", most_rows=10)


def test_discord_against_plain_version(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30)
    rows = table(spark, [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)])
    got = {(r["k"], r["i"]): r["score"] for r in series.discord(rows, ["k"], "v", "i", "i", 5).collect()}
    w = [x[i : i + 5] for i in range(26)]
    d = [min(math.sqrt(((w[i] - w[j]) ** 2).mean()) for j in range(26) if abs(i - j) >= 5) for i in range(26)]
    for i in range(30):
        assert got["a", i] == pytest.approx(max(d[max(0, i - 4) : min(i, 25) + 1]))
    assert got["b", 0] == 0.0


@pytest.mark.parametrize("size", [12, 50])
def test_discord_by_blocks_equals_one_search(spark, monkeypatch, size):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=60), rng.normal(size=33)
    rows = table(spark, [("a", i, float(v)) for i, v in enumerate(x)])
    other = table(spark, [("a", i, float(v)) for i, v in enumerate(y)])
    monkeypatch.setattr(profile, "BLOCK", size)
    monkeypatch.setattr(profile, "PIECE", size // 2 - 1)
    w, z = ([v[i : i + 5] for i in range(len(v) - 4)] for v in (x, y))
    for ref, others, gap in ((None, w, 5), (other, z, 0)):
        d = [min(math.sqrt(((w[i] - v) ** 2).mean()) for j, v in enumerate(others) if abs(i - j) >= gap) for i in range(56)]
        got = {r["i"]: r["score"] for r in series.discord(rows, ["k"], "v", "i", "i", 5, ref).collect()}
        assert all(got[i] == pytest.approx(max(d[max(0, i - 4) : min(i, 55) + 1])) for i in range(60))


@pytest.mark.parametrize("size", [12, 200])
def test_discord_with_nulls(spark, monkeypatch, size):
    """Windows that hold a null are left out, in blocks and at their edges; only null rows have no score."""
    monkeypatch.setattr(profile, "BLOCK", size)
    monkeypatch.setattr(profile, "PIECE", 5)
    rng = np.random.default_rng(2)
    x = [None if i in (0, 11, 12, 30) else float("nan") if i == 59 else float(v) for i, v in enumerate(rng.normal(size=70))]
    rows = table(spark, [("a", i, v) for i, v in enumerate(x)] + [("b", i, None) for i in range(9)])
    whole = [i for i in range(66) if all(v is not None and v == v for v in x[i : i + 5])]
    d = {i: min(math.sqrt(sum((a - b) ** 2 for a, b in zip(x[i : i + 5], x[j : j + 5], strict=True)) / 5) for j in whole if abs(i - j) >= 5) for i in whole}
    got = {(r["k"], r["i"]): r["score"] for r in series.discord(rows, ["k"], "v", "i", "i", 5).collect()}
    for i, v in enumerate(x):
        want = None if v is None or v != v else max((d[j] for j in range(i - 4, i + 1) if j in d), default=0.0)
        assert got["a", i] == (want if want is None else pytest.approx(want))
    assert all(got["b", i] is None for i in range(9))


def test_pieces_that_hold_nothing_nearer_are_left_out(monkeypatch):
    """On a series of distinct levels that come back, most cells are never worked out, and the distances stay right."""
    monkeypatch.setattr(profile, "PIECE", 64)
    rng = np.random.default_rng(3)
    x = np.repeat(np.arange(8) * 10.0, 128) + rng.normal(size=1024) * 0.1
    part = profile.Part.of(pd.DataFrame({"__at": range(1024), "__v": x}), 10)
    near, other, cells = profile.search(part, part, 10, True, True, True)
    w = np.lib.stride_tricks.sliding_window_view(x, 10)
    d = ((w[:, None] - w[None]) ** 2).sum(2)
    d[np.abs(np.subtract.outer(np.arange(1015), np.arange(1015))) < 10] = np.inf
    assert np.allclose(part.best, d.min(1)) and cells < 1015**2 / 3


def test_discord_against_a_reference_finds_the_fault(spark):
    rows = generators.vibration(spark, machines=2, steps=600)
    out = workflows.reference_discord(rows, ~F.col("planted") & (F.col("ts") < 3000), ["machine"], "value", "ts", "ts", 20, 9.0)
    hit = out.where("machine = 'm1'").groupBy("planted").agg(F.avg("score").alias("s"))
    by = {r["planted"]: r["s"] for r in hit.collect()}
    assert by[True] > 1.5 * by[False], by


def test_change_points_of_a_jump(spark):
    rows = table(spark, [("a", i, float(i % 3 + (50 if i >= 40 else 0))) for i in range(80)])
    for stat, critical in (("KS", 0.99), ("CVM", 1.0), ("AD", 10.0)):
        found = series.change_points(rows, ["k"], "v", "i", "i", 20, stat, critical)
        assert found.orderBy(F.col("stat").desc(), "i").first()["i"] == 40
    since = spark.createDataFrame([("a", 45)], "k string, checkpoint long")
    assert series.change_points(rows, ["k"], "v", "i", "i", 20, "KS", 0.99, since).count() == 0
    assert 0.3 < series.critical_value("KS", 10) < 0.9


def test_sequence_matcher(spark):
    a, b = F.array(*map(F.lit, "aabbc")), F.array(*map(F.lit, "aabxc"))
    r = spark.range(1).select(*[series.sequence_match(a, b, h).alias(h) for h in ("count", "adjacency", "longest")], series.sequence_match(a, b, distance=True).alias("d")).first()
    assert (r["count"], r["adjacency"], r["longest"]) == (4, 7, 3) and r["d"] == pytest.approx(0.2)


def test_sequence_match_compares_whole_sequences(spark):
    from quietsignal.plans.catalogue import QUERIES

    sequences = {}
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "event_type").collect(), key=lambda r: r["event_id"]):
        sequences.setdefault(r["user_id"], []).append(r["event_type"])
    assert max(map(len, sequences.values())) > 21
    expected = {}
    for user, s in sequences.items():
        runs = [len(x) for x in "".join("01"[x == y] for x, y in zip(s, s[1:])).split("0")]
        same = sum(runs)
        expected[user] = (same, 1 - same / (len(s) - 1) if len(s) > 1 else None, max(runs), sum(n * (n + 1) / 2 for n in runs))
    got = {r["user_id"]: r for r in QUERIES["sequence_match"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(expected)
    for user, (same, distance, longest, adjacency) in expected.items():
        r = got[user]
        assert (r["matches"], r["longest"], r["adjacency"]) == (same, longest, adjacency)
        assert r["distance"] == (distance if distance is None else pytest.approx(distance, abs=6e-5))


def test_numeric_sorter_keeps_all_orders(spark):
    from quietsignal.plans.catalogue import QUERIES

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    assert len(orders) > 100
    got = [tuple(r) for r in QUERIES["numeric_sorter"](spark, "/root/testdata/sf0.001").collect()]
    assert got == sorted(map(tuple, orders), key=lambda r: (-r[1], r[0]))




def test_markov_marks_unknown_keys_and_short_series(spark):
    rows = spark.createDataFrame([("a", i, "xy"[i % 2]) for i in range(8)] + [("b", 0, "x")], "k string, i long, s string")
    model = series.transition_model(rows.where("k = 'a'"), ["k"], "s", "i", "i", ["x", "y"])
    out = {(r["k"], r["i"]): (r["score"], r["tag"]) for r in series.markov(rows, model, ["k"], "s", "i", "i", 3, "conditionalProbability", 5.0).collect()}
    assert out["b", 0] == (-1.0, "I") and out["a", 0] == (0.0, "N") and out["a", 5][0] > 0


GAPPY = {("a", "a"): 0.6, ("a", "b"): 0.4, ("b", "a"): 1.0, ("b", "b"): 0.0}


@pytest.mark.parametrize("strategy", ["conditionalProbability", "missProbability", "missRate", "entropyReduction"])
@pytest.mark.parametrize("cumulative", [False, True])
def test_impossible_and_unknown_transitions_in_batch_and_stream(spark, tmp_path, strategy, cumulative):
    """Probability 0, states the model lacks and null states: batches and streams agree, and with a plain version."""
    rows = spark.createDataFrame([(k, i, x) for k in ("k", "l") for i, x in enumerate(["a", "b", "b", "b", "z", "a", "z", "z", None, "a", "a", "b", "a"])], "k string, i long, s string")
    model = spark.createDataFrame([("all", a, b, p) for (a, b), p in GAPPY.items()], "__all string, prev string, cur string, prob double")
    batch = {(r["k"], r["i"]): (r["score"], r["tag"]) for r in series.markov(rows, model, ["k"], "s", "i", "i", 3, strategy, 1.0, cumulative=cumulative, model_keys=[]).collect()}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scorers.markov(scorers.read_files(spark, str(tmp_path / "in"), rows.schema), "k", "s", "i", GAPPY, 3, 1.0, cumulative=cumulative, strategy=strategy)
    scorers.run_to_folder(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        want = batch[r["k"], r["i"]][0]
        assert r["score"] == (want if want is None else pytest.approx(want)), (r["i"], strategy)
    high = {"conditionalProbability": (math.log(1e6) - math.log(0.4)) / 2, "missProbability": 0.8, "missRate": 1.0, "entropyReduction": None}[strategy]
    if high and not cumulative:
        assert batch["k", 2][0] == pytest.approx(high) and batch["k", 7][0] == pytest.approx(math.log(1e6) if strategy == "conditionalProbability" else 1.0)
        assert [batch["k", i][1] for i in (8, 9, 10)] == ["I", "I", "I"] and batch["k", 8][0] is None and batch["k", 11][0] is not None


def test_forecast_replaces_outliers(spark):
    values = [10.0 + i % 2 for i in range(30)]
    values[20] = 500.0
    out = {r["i"]: r for r in forecast.replacing(table(spark, [("a", i, v) for i, v in enumerate(values)]), ["k"], "v", "i", "i", 4, 0.9).collect()}
    assert out[20]["score"] > 0.99 and out[21]["prediction"] < 12
    for how in ("weightedAverage", "exponentialSmoothing"):
        assert 1 < forecast.predict([1.0, 2.0, 3.0], how, None, 0.5) < 3


def test_forecast_goes_on_from_saved_residuals(spark):
    rng = np.random.default_rng(9)
    rows = table(spark, [("a", i, float(v)) for i, v in enumerate(rng.normal(size=60))])
    whole = series.one_step_ahead(rows, ["k"], "v", "i", "i", 4)
    saved = series.residual_stats(whole.where("i < 40"), ["k"], "v")
    later = series.one_step_ahead(rows.where("i >= 36"), ["k"], "v", "i", "i", 4, initial=saved)
    a, b = ({r["i"]: r["score"] for r in d.where("i >= 40").collect()} for d in (whole, later))
    assert all(a[i] == pytest.approx(b[i]) for i in range(40, 60))


def test_drift_monitors_on_a_planted_change(spark):
    rows = generators.classifier_errors(spark, streams=2, steps=1500).select("id", "ts", "err", "err2", "planted")
    at = ("ts", "ts")
    runs = {"ddm": drift.ddm(rows, ["id"], "err", *at, 100, 3.0), "eddm": drift.eddm(rows, ["id"], "err", *at, 300, 0.8), "fhddm": drift.fhddm(rows, ["id"], "err", *at, 60, 0.001), "lp": drift.paired_learners(rows, ["id"], "err", "err2", *at, 0.1, 100), "ecdd": drift.ecdd(rows, ["id"], "err", *at, 0.05, 4.0, 100)}
    for name, out in runs.items():
        share = {r["planted"]: r["s"] for r in out.groupBy("planted").agg(F.avg("drift").alias("s")).collect()}
        assert share[True] > 0.05 and share[True] > 2 * share[False], name


@pytest.mark.parametrize("criterion", ["entropy", "gini"])
def test_threshold_learner_finds_a_clean_split(spark, criterion):
    rows = spark.createDataFrame([(s / 20, s >= 12) for s in range(20)], "score double, bad boolean")
    stumps = alerts.learn_threshold(rows, [], F.col("bad"), [0.0, 0.3, 0.6, 0.9, 5.0], criterion)
    assert {r["split"] for r in stumps.collect()} == {0.3, 0.6, 0.9}
    assert alerts.best_split(stumps, []).first()["split"] == 0.6


def test_roll_up_with_a_singleton_and_an_orphan(spark):
    h = spark.createDataFrame(generators.streams_hierarchy(), "type string, id string, parentType string, parentId string, singleton boolean")
    rows = spark.createDataFrame([("prodSale", "p0", 1, 10.0, 0.5, "N"), ("prodSale", "p2", 1, 20.0, 0.9, "O"), ("cartAbandon", "c7", 1, 5.0, 0.2, "N"), ("odd", "x", 1, 1.0, 0.1, "N")], "type string, id string, seq long, value double, score double, tag string")
    out = {(r["type"], r["id"]): (r["value"], r["tag"]) for r in alerts.roll_up(rows, h).collect()}
    assert out == {("dept", "d0"): (20.0, "O"), ("sale", "sale0"): (5.0, "N"), (None, None): (1.0, "N")}
    assert workflows.chain_roll_up(rows.where("type = 'prodSale'"), h, 3).count() == 3


def test_counter_counts_every_tag(spark):
    rows = spark.createDataFrame([("a", t) for t in "OONIA"], "k string, tag string")
    r = alerts.count_tags(rows, ["k"], stamp=True).first()
    assert (r["outlier_count"], r["normal_count"], r["unknown_count"], r["ambiguous_count"], r["outlier_pct"]) == (2, 1, 1, 1, 40.0) and r["counted_at"]


def test_clusters_by_average_gap(spark):
    rows = spark.createDataFrame([("a", i, float(i), 0.1 * i, "O") for i in (1, 2, 3, 50, 51)] + [("a", 60, 60.0, 0.0, "I")], "k string, i long, s double, score double, tag string")
    out = {r["i"]: r["tag"] for r in alerts.cluster_alerts(rows, ["k"], "s", "i", average_gap=10).collect()}
    assert out == {1: "N", 2: "O", 3: "N", 50: "O", 51: "N", 60: "I"}


def test_forest_ranks_the_planted_point_first(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(200, 2)), [[12.0, -12.0]]])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    nodes = forest.fit_by_key(rows, [], ["a", "b"], trees=40, subsample=200).drop(models.ALL)
    assert forest.score(rows, nodes, ["a", "b"]).orderBy(F.col("score").desc()).first()["i"] == 200
    assert forest.score(rows, nodes, ["a", "b"], key_filter="i < 5").count() == 5


def test_growing_on_keeps_old_splits():
    rng = np.random.default_rng(7)
    import pandas as pd

    a, b = rng.normal(size=(50, 2)), rng.normal(size=(50, 2))
    names = [c.split()[0] for c in forest.NODES.split(", ")]
    old = pd.DataFrame(forest.grow(a, 1, 3, forest.hash_choice), columns=names)
    new = pd.DataFrame(forest.grow(np.vstack([a, b]), 1, 6, forest.hash_choice, old), columns=names)
    kept = old[~old["leaf"]].merge(new[~new["leaf"]], on="node")
    assert len(kept) == (~old["leaf"]).sum() and np.allclose(kept["split_x"].astype(float), kept["split_y"].astype(float))
    assert new[new["leaf"]]["n"].sum() == 100


def test_autoencoder_and_components_find_what_does_not_fit(spark):
    rng = np.random.default_rng(8)
    t = rng.normal(size=300)
    x = np.c_[t, 2 * t, -t] + rng.normal(scale=0.05, size=(300, 3))
    x[-1] = [2.0, -4.0, 2.0]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    attrs = ["a", "b", "c"]
    pca = projection.reconstruction_error(rows, projection.fit_components(rows, [], attrs, 1), [], attrs, 1, threshold=1.0)
    assert [r["i"] for r in pca.where("tag = 'O'").collect()] == [299]
    net = projection.regeneration_error(rows, attrs, projection.fit_autoencoder(rows, attrs, 1))
    assert net.orderBy(F.col("score").desc()).first()["i"] == 299


def test_spectral_residue_finds_the_spike(spark):
    values = [math.sin(i / 3) for i in range(64)]
    values[40] += 8
    out = projection.spectral_residue(table(spark, [("a", i, v) for i, v in enumerate(values)]), ["k"], "v", "i", "i", 64)
    assert abs(out.orderBy(F.col("score").desc()).first()["i"] - 40) <= 1
    x, wide = np.array(values), lambda v, w: np.convolve(np.pad(v, (w // 2, w - 1 - w // 2), mode="edge"), np.ones(w) / w, mode="valid")
    f = np.fft.fft(x)
    log = np.log(np.abs(f))
    s = np.abs(np.fft.ifft(np.exp(log - wide(log, 5) + 1j * np.angle(f))))
    assert np.allclose([r["score"] for r in out.orderBy("i").collect()], np.abs(s - wide(s, 3)))
    assert projection.spectral_residue(table(spark, [("a", 0, 1.0)]), ["k"], "v", "i", "i", 8).first()["score"] == 0.0


@pytest.mark.parametrize(("make", "keys", "attr", "least"), [(generators.product_sale, ["product"], "qty", 0.9), (generators.tickets, ["severity", "priority"], "service_hours", 0.95), (generators.order_process, ["cur_state"], "elapsed", 0.95), (generators.card_transactions, [], "amount", 0.95)])
def test_planted_outliers_are_found(spark, make, keys, attr, least):
    out = record.detect(make(spark), "robustZscore", Settings(keys, [attr], threshold=5.0))
    r = alerts.precision_recall(out.where("tag = 'O'").withColumn("h", F.xxhash64("*")), out.where("planted").withColumn("h", F.xxhash64("*")), ["h"]).first()
    assert r["recall"] >= least and r["precision"] > 0.7


def test_locations_out_of_quarantine(spark):
    out = record.out_of_range(generators.locations(spark), generators.quarantine(spark), Settings(["phone"], ["lat", "long"], "max"), 5000.0)
    r = out.groupBy("planted").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {x["planted"]: x for x in r}
    assert by[True]["lo"] > 0.9 and by[False]["hi"] < 0.5


@pytest.mark.parametrize("make", [generators.cpu_usage, generators.blood_sugar, generators.cannibalised_sale, generators.cart_abandonment, generators.inventory, generators.web_sessions, generators.transaction_states, generators.churn])
def test_generators_do_not_depend_on_partitions(spark, make):
    a = make(spark)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b = make(spark).repartition(5)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a.count() == b.count() > 0 and a.agg(F.sum(F.hash("*").cast("long"))).first() == b.agg(F.sum(F.hash("*").cast("long"))).first()


def test_decomposition_adds_up(spark):
    rows = table(spark, [("a", i, 0.5 * i + [0, 3, -3, 0][i % 4]) for i in range(40)])
    for period in (4, 5):
        out = explore.decompose(rows, ["k"], "v", "i", "i", period).where("trend IS NOT NULL").collect()
        assert all(r["v"] == pytest.approx(r["trend"] + r["seasonal"] + r["rest"]) for r in out)


def test_files_round_trip(spark, tmp_path):
    text = json.dumps({"attributes": [{"name": "v", "ordinal": 1, "dataType": "double", "bucketWidth": 5}, {"name": "k", "ordinal": 0, "dataType": "string"}]})
    schema = files.schema_from_json(text)
    assert schema.names == ["k", "v"] and schema["v"].metadata["bucketWidth"] == 5
    files.write_delimited(spark.createDataFrame([("a ", 1.23456)], "k string, v double"), f"{tmp_path}/csv", sep="[]")
    back = files.read_delimited(spark, f"{tmp_path}/csv", schema, sep="[]").first()
    assert back["k"] == "a" and back["v"] == 1.235
    (tmp_path / "h.json").write_text(json.dumps({"streams": [{"id": "p0", "type": "prod", "parentId": "d0", "parentType": "dept", "singleton": False}, {"id": "d0", "type": "dept", "childrenId": ["p1"], "childrenType": "prod"}]}))
    assert {(r["id"], r["parentId"]) for r in files.read_hierarchy(spark, f"{tmp_path}/h.json").collect()} == {("p0", "d0"), ("p1", "d0")}
    (tmp_path / "m.txt").write_text("k1,0.9,0.1,0.2,0.8\n")
    (tmp_path / "l.txt").write_text("k1\n0.9,0.1\n0.2,0.8\n")
    a, b = files.read_transitions(spark, f"{tmp_path}/m.txt", ["k"], ["x", "y"]), files.read_transition_lines(spark, f"{tmp_path}/l.txt", ["k"], ["x", "y"])
    assert sorted(a.collect()) == sorted(b.collect())
    (tmp_path / "r.txt").write_text("p,1,2,3,4\n")
    assert files.read_ranges(spark, f"{tmp_path}/r.txt", ["k"], ["a", "b"]).first()["b_hi"] == 4
    files.write_all({"one": a}, f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all/one").count() == 4 and "prob" in files.peek(a, 1)


def test_sql_functions(spark):
    sql.register(spark)
    table(spark, [("a", i, float(i * i)) for i in range(8)]).createOrReplaceTempView("series_view")
    assert spark.sql("SELECT outlier_tag(exp_scale(1, zscore(9, 3, 2)), 0.9) AS t").first()["t"] == "O"
    got = spark.sql("SELECT s.seq, s.score FROM neighborhood_score(TABLE(SELECT k, i AS seq, v AS value FROM series_view) PARTITION BY k ORDER BY seq) s").collect()
    want = series.local_neighborhood(spark.table("series_view"), ["k"], "v", "i", "i", 5, nearest=2).where("score > 0")
    assert sorted((r["seq"], r["score"]) for r in got) == sorted((r["i"], r["score"]) for r in want.collect())


def test_command_line(spark, tmp_path):
    table(spark, [("a", i, float(i)) for i in range(9)]).write.parquet(f"{tmp_path}/in")
    cli.main(["zscore", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--keys", "k", "--attrs", "v", "--threshold", "1.2"])
    assert spark.read.parquet(f"{tmp_path}/out").where("tag = 'O'").count() == 2
    for job in ("discord", "neighborhood", "forecast", "fhddm", "changePoint"):
        args = cli.build().parse_args([job, "--input", "x", "--output", "y", "--keys", "k", "--attrs", "v", "--seq", "i", "--window", "3" if job == "neighborhood" else "2"])
        assert cli.plan(args, spark.read.parquet(f"{tmp_path}/in")).columns


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [("ab"[i % 2], i, "xyz"[(i * i + i // 3) % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, s string")
    for n in range(3):
        df.where(f"i >= {20 * n} AND i < {20 * n + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    model = series.transition_model(df, [], "s", "i", "i", ["x", "y", "z"])
    p = {(r["prev"], r["cur"]): r["prob"] for r in model.collect()}
    stream = scorers.read_files(spark, f"{tmp_path}/in/*", df.schema, "*.parquet")
    scorers.run_to_folder(scorers.markov(stream, "k", "s", "i", p, 4, 1.0), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["k"], r["i"]): r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = series.markov(df, model, ["k"], "s", "i", "i", 4, "conditionalProbability", 1.0, model_keys=[])
    assert len(got) == 60 and all(got[r["k"], r["i"]] == pytest.approx(r["score"]) for r in want.collect())


def test_entities_of_stream_lines(spark):
    out = scorers.split_entity(spark.createDataFrame([("e1,a,b",), ("alone",)], "value string")).collect()
    assert [(r["entity"], r["record"]) for r in out] == [("e1", "a,b"), ("alone", "")]


def test_empty_input(spark):
    none = table(spark, [])
    assert record.detect(none, "zscore", Settings(["k"], ["v"])).count() == 0
    assert series.discord(none, ["k"], "v", "i", "i", 3).count() == 0
    assert alerts.count_tags(none.withColumn("tag", F.lit("O")), ["k"]).count() == 0
    assert drift.ddm(none.withColumn("e", F.lit(1)), ["k"], "e", "i", "i", 5, 3.0).count() == 0


def test_every_strategy_detects_and_serves_streams(spark, tmp_path):
    rows = [("ab"[i % 2], i, float(i * i % 37), float(i * 7 % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for strategy in [*record.STRATEGIES, "interPercentile", "mahalanobis", *record.BINNED]:
        one = strategy in ("attributeProbability", "cumulativeProbability")
        s = record.Settings(["k"], ["v"] if one else ["v", "w"], threshold=0.5, extra={"widths": {"v": 10, "w": 4}})
        batch = {r["i"]: (r["score"], r["tag"]) for r in record.detect(df, strategy, s).collect()}
        assert len(batch) == 80 and all(t in "ONI" for _, t in batch.values())
        stream = scorers.read_files(spark, f"{tmp_path}/in", df.schema, "*.parquet")
        scorers.run_to_folder(scorers.score(stream, record.fit(df, strategy, s), strategy, s), f"{tmp_path}/{strategy}/out", f"{tmp_path}/{strategy}/state")
        got = {r["i"]: (r["score"], r["tag"]) for r in spark.read.parquet(f"{tmp_path}/{strategy}/out").collect()}
        assert {i: (pytest.approx(x), t) for i, (x, t) in batch.items()} == got
    with pytest.raises(ValueError):
        record.detect(df, "unheard", s)


@pytest.mark.parametrize("strategy", ["missProbability", "missRate", "entropyReduction", "conditionalProbability"])
def test_stream_metrics_equal_batch_metrics(spark, tmp_path, strategy):
    df = spark.createDataFrame([("ab"[i % 2], i, "xyz"[(i * i + i // 3) % 3]) for i in range(60)], "k string, i long, s string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    model = series.transition_model(df, [], "s", "i", "i", ["x", "y", "z"])
    p = {(r["prev"], r["cur"]): r["prob"] for r in model.collect()}
    stream = scorers.read_files(spark, f"{tmp_path}/in", df.schema, "*.parquet")
    scorers.run_to_folder(scorers.markov(stream, "k", "s", "i", p, 4, 1.0, strategy=strategy), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["k"], r["i"]): r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = series.markov(df, model, ["k"], "s", "i", "i", 4, strategy, 1.0, model_keys=[]).collect()
    assert len(got) == 60 and all(got[r["k"], r["i"]] == pytest.approx(r["score"]) for r in want)


def test_keyed_forests_score_their_own_keys(spark):
    rows = [("ab"[i % 2], i, float(i * 31 % 97), float(i * i % 53) + 40 * (i % 2)) for i in range(400)] + [("c", 999, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w double")
    nodes = forest.fit_by_key(df.where("k <> 'c'"), ["k"], ["v", "w"], trees=20, subsample=32)
    got = {r["i"]: r["score"] for r in forest.score(df, nodes, ["v", "w"], keys=["k"]).collect()}
    assert got[999] is None and len(got) == 401
    for k in "ab":
        own = {r["i"]: r["score"] for r in forest.score(df.where(f"k = '{k}'"), nodes.where(f"k = '{k}'").drop("k"), ["v", "w"]).collect()}
        assert all(got[i] == pytest.approx(x) for i, x in own.items())
    plain = nodes.where("k = 'a'").toPandas()

    def path(tree, x, node=1):
        r = tree[node]
        if r.leaf:
            return node.bit_length() - 1 + float(forest.path_norm(r.n))
        return path(tree, x, 2 * node + int(x[int(r.attr)] >= r.split))

    trees = [{r.node: r for r in part.itertuples()} for _, part in plain.groupby("tree")]
    norm = float(forest.path_norm(sum(t[1].n for t in trees) / len(trees)))
    for k, i, v, w in rows[:60:2]:
        assert got[i] == pytest.approx(2 ** (-sum(path(t, (v, w)) for t in trees) / len(trees) / norm))


def test_scaled_neighbours_are_those_of_all_pairs(spark):
    rows = [(i % 2, i, [float(i * 7 % 13), float(i * i % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, id long, v array<double>")
    near = {(r["source"], r["target"]): (r["dist"], r["rank"]) for r in density.nearest(df, ["k"], "id", "v", 4, block=7, scale=10).collect()}
    pairs = density.pair_distances(df, ["k"], "id", "v", scale=10).collect()
    for source in range(60):
        best = sorted((r["dist"], r["target"]) for r in pairs if r["source"] == source)[:4]
        assert {t: (d, i + 1) for i, (d, t) in enumerate(best)} == {t: x for (s, t), x in near.items() if s == source}


@pytest.mark.parametrize("cut", [3, 11, 47])
def test_drift_monitors_go_on_as_if_never_cut(spark, cut):
    rng = np.random.default_rng(cut)
    rows = [(k, i, int(rng.random() < (0.2 if i < 40 else 0.6)), int(rng.random() < 0.3)) for k in ("a", "b") for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i long, x int, y int")
    monitors = {
        "ddm": lambda d, **o: drift.ddm(d, ["k"], "x", "i", "i", 10, 2.0, **o), "eddm": lambda d, **o: drift.eddm(d, ["k"], "x", "i", "i", 15, 0.8, **o), "fhddm": lambda d, **o: drift.fhddm(d, ["k"], "x", "i", "i", 12, 0.2, **o),
        "paired": lambda d, **o: drift.paired_learners(d, ["k"], "x", "y", "i", "i", 0.1, 10, **o), "ecdd": lambda d, **o: drift.ecdd(d, ["k"], "x", "i", "i", 0.2, 1.5, 10, **o),
    }
    for name, run in monitors.items():
        whole = {(r["k"], r["i"]): r["drift"] for r in run(df).collect()}
        saved = drift.state(run(df.where(f"i < {cut}"), keep=True), ["k"], ["state"], "i", "i")
        rest = {(r["k"], r["i"]): r["drift"] for r in run(df.where(f"i >= {cut}"), saved=saved).collect()}
        assert rest == {k: v for k, v in whole.items() if k[1] >= cut}, name
        assert sum(whole.values()), name
