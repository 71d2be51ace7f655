"""ROC analysis, draws, model comparison, imputation and forests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnkit.models import compare, detection, draws, forest, holdout, importance, impute, roc


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for model, imp in (("m_2024", 1), ("m_2024", 2), ("m_a", 1), ("m_a", 2)):
        for i in range(120):
            positive = rng.random() < 0.4
            rows.append((model, imp, i, "detected" if positive else "not_detected", round(rng.random() * 0.7 + positive * 0.2, 1)))
    rows += [("m_one", 1, i, "detected", 0.5) for i in range(5)]
    return spark.createDataFrame(rows, "model string, imp int, row_id int, truth string, score double"), rows


def by_fit(rows):
    fits = {}
    for model, imp, i, truth, score in rows:
        fits.setdefault((model, imp), []).append((truth == "detected", score, i))
    return fits


def pair_auc(data):
    pos, neg = [s for t, s, _ in data if t], [s for t, s, _ in data if not t]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting_and_trapezoid(scored):
    df, rows = scored
    got = {(r["model"], r["imp"]): r["auc"] for r in roc.auc(df, pieces=5).collect()}
    curves = {}
    for r in roc.roc_curve(df, pieces=5).collect():
        curves.setdefault((r["model"], r["imp"]), []).append((r["threshold"], r["sensitivity"], r["specificity"]))
    for fit, data in by_fit(rows).items():
        if pair_auc(data) is None:
            assert got[fit] is None
            continue
        assert got[fit] == pytest.approx(pair_auc(data))
        points = sorted(curves[fit])
        area = sum((a[1] + b[1]) / 2 * (b[2] - a[2]) for a, b in zip(points, points[1:]))
        assert area == pytest.approx(got[fit])
        assert points[0][0] == -math.inf and points[0][1:] == (1.0, 0.0) and points[-1][1:] == (0.0, 1.0)


def test_roc_minimum_threshold(scored):
    df, _ = scored
    assert roc.roc_curve(df, min_threshold=0.25).agg(F.min("threshold")).first()[0] == pytest.approx(0.3)


def test_lookup_row_by_row_and_sensitivity_at(scored):
    df, rows = scored
    lookup = roc.sens_spec_lookup(df, pieces=5)
    got = {(r["model"], r["imp"], r["row_id"]): (r["sensitivity"], r["specificity"]) for r in lookup.collect()}
    best = {(r["model"], r["imp"], r["specificity"]): r["sensitivity"] for r in roc.sensitivity_at(lookup, ["model", "imp"], [0.5, 0.8]).collect()}
    for fit, data in by_fit(rows).items():
        pos, neg = sum(t for t, _, _ in data), sum(not t for t, _, _ in data)
        if not neg:
            continue
        tp = fp = 0
        points = []
        for t, _, i in sorted(data, key=lambda d: (-d[1], d[2])):
            tp, fp = tp + t, fp + (not t)
            assert got[(*fit, i)] == (pytest.approx(tp / pos), pytest.approx(1 - fp / neg))
            points.append((tp / pos, 1 - fp / neg))
        assert best[(*fit, 0.8)] == pytest.approx(max(s for s, c in points if c >= 0.8))


def test_bands_fall_with_specificity(scored):
    df, _ = scored
    bands = roc.roc_bands(roc.roc_curve(df), pieces=5).collect()
    assert {r["model_type"] for r in bands if r["model"] == "m_2024"} == {"Tested on 2024"}
    for model in ("m_2024", "m_a"):
        ordered = sorted((r for r in bands if r["model"] == model), key=lambda r: r["specificity"])
        for name in ("lower", "sensitivity", "upper"):
            values = [r[name] for r in ordered]
            assert values == sorted(values, reverse=True)
        assert all(r["lower"] <= r["sensitivity"] <= r["upper"] for r in ordered)


def test_auc_summary_of_one_fit_has_equal_bounds(spark):
    df = spark.createDataFrame([("m", 1, 0.7512), ("n", 1, 0.5), ("n", 2, 0.9)], "model string, imp int, auc double")
    got = {r["model"]: tuple(r) for r in roc.auc_summary(df, labels={"m": "Lake"}).collect()}
    assert got["m"] == ("m", 0.751, 0.751, 0.751, "Lake") and got["n"][2] == 0.7 and got["n"][4] == "n"


def test_class_weights_balance(scored):
    df, _ = scored
    weighted = holdout.class_weights(df, "truth", ["model", "imp"])
    totals = weighted.groupBy("model", "imp", "truth").agg(F.sum("weight").alias("w")).collect()
    assert {round(r["w"], 6) for r in totals if r["model"] != "m_one"} == {60.0}


def test_best_parameters_and_grid(spark):
    rows = [(1, 3, 5, "accuracy", 0.8), (2, 3, 5, "accuracy", 0.9), (1, 2, 9, "accuracy", 0.9), (2, 2, 9, "accuracy", 0.8),
            (1, 2, 4, "accuracy", 0.85), (1, 9, 9, "accuracy", 0.1), (1, 1, 1, "rmse", 5.0), (1, 4, 4, "rmse", 2.0)]
    df = spark.createDataFrame(rows, "imp int, mtry int, min_n int, metric string, value double")
    best = holdout.best_parameters(df).first()
    assert (best["mtry"], best["min_n"]) == (2, 4)
    assert holdout.best_parameters(df, "rmse").first()["mtry"] == 4
    assert len(holdout.regular_grid(33)) == 25 and holdout.regular_grid(33)[0] == (1, 2) and holdout.regular_grid(33)[-1] == (33, 40)


def test_importance_of_a_single_model_has_equal_bounds(spark):
    rows = [("a_2024", i, v, s * i) for i in (1, 2, 3) for v, s in (("x", 2.0), ("y", 1.0))]
    rows += [(m, 1, v, s) for m, x, y in (("b", 1.0, 4.0), ("c", 2.0, 1.0)) for v, s in (("x", x), ("y", y))]
    df = spark.createDataFrame(rows, "model string, imp int, variable string, importance double")
    got = {(r["model_type"], r["variable"]): tuple(r)[2:] for r in importance.importance_summary(df).collect()}
    assert got["Tested on 2024", "x"] == (100.0, 100.0, 100.0) and got["Tested on 2024", "y"] == (50.0, 50.0, 50.0)
    assert got["Tested on Location", "x"] == (62.5, 43.75, 81.25)


def test_top_shared_flags_both_lists(spark):
    first = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 8.0), ("d", 1.0)], "variable string, avg_importance double")
    second = spark.createDataFrame([("b", 9.0), ("x", 8.0), ("d", 1.0)], "variable string, avg_importance double")
    got = {(r["target"], r["variable"]): r["shared"] for r in importance.top_shared(first, second, ("grab", "passive"), 2).collect()}
    assert got == {("grab", "a"): "Not shared", ("grab", "b"): "Shared predictor", ("grab", "c"): "Not shared",
                   ("passive", "b"): "Shared predictor", ("passive", "x"): "Not shared"}


def approx(points, target, clamp=True):
    merged = {}
    for x, p in points:
        merged.setdefault(p, []).append(x)
    curve = sorted((p, sum(x) / len(x)) for p, x in merged.items())
    if len(curve) < 2:
        return None
    if target <= curve[0][0]:
        return curve[0][1] if clamp or target == curve[0][0] else None
    if target >= curve[-1][0]:
        return curve[-1][1] if clamp or target == curve[-1][0] else None
    for (p0, x0), (p1, x1) in zip(curve, curve[1:]):
        if p0 <= target <= p1:
            return x0 + (target - p0) / (p1 - p0) * (x1 - x0)


def test_crossing_points_with_ties_and_curves_that_turn(spark):
    rng = random.Random(8)
    rows = [("l", 2022, w, d, float(x), round(rng.random(), 1)) for w in range(4) for d in range(6) for x in range(9)]
    rows += [("l", 2022, 9, 1, float(x), 0.3) for x in range(5)]
    df = spark.createDataFrame(rows, "location string, year int, week int, draw int, x double, p double")
    for mode in ("clamp", "none"):
        got = {(r["week"], r["draw"], r["probability"]): r["threshold"] for r in draws.crossing_points(df, extrapolate=mode).collect()}
        for week, draw, target in got:
            points = [(r[4], r[5]) for r in rows if r[2] == week and r[3] == draw]
            expected = approx(points, target, mode == "clamp")
            assert got[week, draw, target] == (None if expected is None else pytest.approx(expected))
    assert got[9, 1, 0.5] is None


def test_crossing_points_invert_a_line(spark):
    df = spark.range(11).select(
        F.lit("l").alias("location"), F.lit(1).alias("year"), F.lit(1).alias("week"), F.lit(1).alias("draw"),
        (F.col("id") * 3.0).alias("x"), (F.col("id") / 10).alias("p"),
    )
    got = {r["probability"]: r["threshold"] for r in draws.crossing_points(df).collect()}
    assert got[0.5] == pytest.approx(15.0) and got[0.75] == pytest.approx(22.5) and got[0.95] == pytest.approx(28.5)


def test_summary_ignores_missing_thresholds(spark):
    df = spark.createDataFrame([("l", 1, 40.0, 0.5, v) for v in (1.0, None, 3.0)], "location string, year int, week double, probability double, threshold double")
    got = draws.threshold_summary(df).first()
    assert (got["median"], got["q25"], got["q75"], str(got["date"])) == (2.0, 1.5, 2.5, "2023-10-08")


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (0.3,), (1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(draws.right_closed_bin("p")).collect()] == [None, 1, 2, 3, 10, None]


def test_model_comparison(spark):
    a, b = [-1.0, -2.0, -1.5], [-1.5, -2.5, -1.0]
    df = spark.createDataFrame(
        [("a", i, v, 0.8) for i, v in enumerate(a)] + [("b", i, v - 1, 1.2) for i, v in enumerate(b)], "model string, obs int, lpd double, khat double"
    )
    got = {r["model"]: r for r in compare.comparison_table(df, digits=6).collect()}
    assert got["a"]["elpd_diff"] == 0 and got["a"]["se_diff"] == 0 and got["a"]["looic"] == 9.0
    diff = [y - 1 - x for x, y in zip(a, b)]
    mean = sum(diff) / 3
    sd = math.sqrt(sum((d - mean) ** 2 for d in diff) / 2)
    assert got["b"]["elpd_diff"] == pytest.approx(sum(diff), abs=1e-6) and got["b"]["se_diff"] == pytest.approx(math.sqrt(3) * sd, abs=1e-6)
    assert got["b"]["delta_looic"] == pytest.approx(got["b"]["looic"] - 9.0, abs=1e-6)
    assert (got["a"]["n_khat_gt_07"], got["a"]["n_khat_gt_1"], got["b"]["n_khat_gt_1"]) == (3, 0, 3)


def test_donors_are_among_the_nearest(spark):
    rng = random.Random(6)
    donors = [(i, float(rng.randint(0, 40)), float(i)) for i in range(200)]
    recipients = [(1000 + i, float(rng.choice([7, 7, 7, -5, 90, rng.randint(0, 40)]))) for i in range(300)]
    d = spark.createDataFrame(donors, "id bigint, prediction double, observed double")
    r = spark.createDataFrame(recipients, "id bigint, prediction double")
    got = {x["id"]: x["observed"] for x in impute.match_donors(d, r, "id", "prediction", "observed", k=5, pieces=4).collect()}
    assert len(got) == 300
    again = {x["id"]: x["observed"] for x in impute.match_donors(d, r, "id", "prediction", "observed", k=5, pieces=9).collect()}
    assert got == again
    for key, p in recipients:
        limit = sorted(abs(q - p) for _, q, _ in donors)[4]
        assert abs(donors[int(got[key])][1] - p) <= limit
    assert len({got[k] for k, p in recipients if p == 7.0}) == 5


def test_fewer_donors_than_asked_for(spark):
    d = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.6, 20.0)], "id bigint, prediction double, observed double")
    r = spark.createDataFrame([(7, 0.1), (8, 9.0)], "id bigint, prediction double")
    got = impute.match_donors(d, r, "id", "prediction", "observed", k=5).collect()
    assert len(got) == 2 and {x["observed"] for x in got} <= {10.0, 20.0}


@pytest.fixture(scope="module")
def gappy(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        z = rng.random()
        site = "s1" if z < 0.5 else "s2"
        rows.append((i, z, None if rng.random() < 0.2 else 10 * z + rng.random(), None if rng.random() < 0.1 else site,
                     "detected" if z > 0.6 else "not_detected", 2022 + i % 3))
    return spark.createDataFrame(rows, "id bigint, z double, y double, site string, truth string, year int"), rows


def test_imputation_fills_gaps_with_observed_values(gappy):
    df, rows = gappy
    stacked = impute.impute_multiple(df, "id", ["y", "site"], ["z"], ["truth"], imputations=2, sweeps=1, trees=8, depth=4).collect()
    assert len(stacked) == 480 and {r["imp"] for r in stacked} == {1, 2}
    observed = {r[2] for r in rows if r[2] is not None}
    source = {r[0]: r for r in rows}
    close = []
    for r in stacked:
        assert r["y"] in observed and r["site"] in ("s1", "s2")
        if source[r["id"]][2] is not None:
            assert r["y"] == source[r["id"]][2]
        else:
            close.append(abs(r["y"] - 10 * r["z"]))
    assert sum(close) / len(close) < 2.0


def test_sweeps_store_changes_once_for_all_imputations(gappy, monkeypatch):
    """One merge a sweep, whatever the columns and imputations; a sweep that does not lower the out-of-bag error is not taken."""
    df, rows = gappy
    merges, kept = [], impute.merge_changes
    monkeypatch.setattr(impute, "merge_changes", lambda *args: merges.append(1) or kept(*args))
    errors = iter([0.5, 0.5, 0.4, 0.6, 0.9])
    args = dict(columns=["y", "site"], predictors=["z"], trees=3, depth=2, at_once=1)
    done = impute.impute_stacked(df, "id", seeds={1: 5, 2: 6}, sweeps=2, stop=False, **args)
    assert len(merges) == 2 and done.dropna().count() == 2 * len(rows)
    first = {r["id"]: (r["y"], r["site"]) for r in impute.impute_once(df, "id", seed=5, sweeps=1, **args).collect()}
    assert len(merges) == 3
    monkeypatch.setattr(impute, "_error", lambda *_: next(errors))
    stopped = {r["id"]: (r["y"], r["site"]) for r in impute.impute_once(df, "id", seed=5, sweeps=9, **args).collect()}
    assert len(merges) == 4 and stopped == first


def test_imputation_of_complete_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id int, y double, s string")
    assert sorted(tuple(r) for r in impute.impute_once(df, "id", ["y", "s"]).collect()) == [(1, 2.0, "a"), (2, 3.0, "b")]


def test_curves_are_dealt_out_by_their_number_of_points(spark):
    rows = [(k, 2020 + k % 3, k % 2, k % 5, float(i), (i + 0.5) / 10) for k in range(40) for i in range(10)]
    table = spark.createDataFrame(rows, "location int, year int, week int, draw int, x double, p double")
    few, many = draws.crossing_points(table), draws.crossing_points(table, points_at_once=10)
    tasks = [x.select("location", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().count() for x in (few, many)]
    assert tasks[0] <= 4 < tasks[1]
    assert sorted(many.collect()) == sorted(few.collect())


def test_holdout_forest_learns_and_reports_importance(gappy):
    df, _ = gappy
    table = df.withColumn("imp", F.lit(1)).withColumn("noise", F.abs(F.hash("id")) % 7)
    spec = forest.ForestSpec("truth", ("z", "noise"), trees=10, mtry=1, min_n=2, max_depth=4)
    splits = [holdout.Holdout(f"hold_{y}", "year", y) for y in (2022, 2023)]
    predictions, importances = forest.run_holdouts(table, spec, splits, [1], "id", at_once=2)
    assert predictions.count() == 160
    assert predictions.filter("score < 0 or score > 1").count() == 0
    assert all(r["auc"] > 0.95 for r in roc.auc(predictions).collect())
    for r in importances.groupBy("model").agg(F.sum("importance").alias("s"), F.max_by("variable", "importance").alias("top")).collect():
        assert r["s"] == pytest.approx(1.0) and r["top"] == "z"


def test_saved_predictions_and_regression_mode(gappy, tmp_path):
    df, _ = gappy
    table = df.filter("y is not null").withColumn("imp", F.lit(1)).withColumn("noise", F.lit(1.0))
    spec = forest.ForestSpec("y", ("z", "noise"), mode="regression", trees=8, mtry=2, max_depth=5)
    path = str(tmp_path / "predictions")
    splits = [holdout.Holdout(f"held out/{y}", "year", y) for y in (2022, 2023, 2024)]
    forest.run_holdouts(table, spec, splits, [1], "id", path=path, at_once=3)
    predictions, _ = forest.run_holdouts(table, spec, splits[:1], [1], "id", path=path)
    assert predictions.count() == table.count()
    assert {r["model"] for r in predictions.select("model").distinct().collect()} == {s.name for s in splits}
    error = predictions.agg(F.sqrt(F.avg((F.col("score") - F.col("truth")) ** 2))).first()[0]
    assert error < 1.5


def test_tuning_prefers_the_useful_setting(gappy):
    df, _ = gappy
    table = df.withColumn("imp", F.lit(1)).withColumn("noise", F.abs(F.hash("id")) % 7)
    spec = forest.ForestSpec("truth", ("z", "noise"), trees=5, max_depth=3)
    best, metrics = forest.tune_forest(table, spec, [1], "id", grid=[(2, 2), (2, 100)], folds=2, repeats=1)
    assert best == (2, 2) and metrics.count() == 4


def test_folds_are_repeatable_and_even(spark):
    df = spark.range(1000)
    first = holdout.add_fold(df, "id", 5, 3).groupBy("fold").count().collect()
    assert {r["fold"] for r in first} == set(range(5)) and all(150 < r["count"] < 250 for r in first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, holdout.add_fold(df.repartition(7), "id", 5, 3).groupBy("fold").count().collect()))


def test_bootstrap_weights_are_poisson(spark):
    weights = spark.range(20000).select(detection.poisson_weight("id", 1).alias("w"))
    got = weights.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert got["m"] == pytest.approx(1, abs=0.03) and got["v"] == pytest.approx(1, abs=0.05)
    assert got["z"] == pytest.approx(math.exp(-1), abs=0.015)


def test_detection_draws_rise_with_the_predictor(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("ab"), 2022 + i % 2, float(rng.randint(20, 45)), rng.random() * 6) for i in range(600)]
    rows = [(*r, "detected" if rng.random() < 1 / (1 + math.exp(3 - r[4])) else "not_detected") for r in rows]
    df = spark.createDataFrame(rows, "id bigint, location string, year int, week double, x double, truth string")
    models = detection.bootstrap_models(df, "id", F.col("truth") == "detected", "location", "year", "week", "x", replicates=2)
    grid = draws.prediction_grid(df, ["location", "year"], {"week": ("week", 2), "x": ("x", 6)})
    table = detection.draws_on_grid(models, grid, "location", "year", "week", "x")
    for draw, model in enumerate(models, 1):
        direct = model.transform(detection.with_season(grid, "week")).collect()
        expected = {(r["location"], r["year"], r["week"], r["x"]): r["_probability"][1] for r in direct}
        mine = table.filter(F.col("draw") == draw).collect()
        assert all(r["p"] == pytest.approx(expected[r["location"], r["year"], r["week"], r["x"]]) for r in mine)
    assert table.count() == 2 * 4 * 2 * 6 and table.filter("p < 0 or p > 1").count() == 0
    ends = table.groupBy("location", "year", "week", "draw").agg(F.min_by("p", "x").alias("lo"), F.max_by("p", "x").alias("hi"))
    assert ends.filter("hi <= lo").count() == 0
    assert draws.threshold_summary(draws.crossing_points(table)).count() == 4 * 2 * 3


def test_tuning_sees_training_rows_only(spark, monkeypatch):
    rows = [(k, 1, ["a", "b", "c"][k % 3], "yes" if (k * 7) % 5 < 2 else "no", float(k % 11), float(k % 7)) for k in range(90)]
    table = spark.createDataFrame(rows, "id int, imp int, location string, target string, x double, y double")
    spec = forest.ForestSpec("target", ("x", "y"), positive="yes", trees=3)
    seen = []

    def spy(df, spec, imputations, row_id, **options):
        seen.append({r["location"] for r in df.select("location").distinct().collect()})
        return (1, 4), None

    monkeypatch.setattr(forest, "tune_forest", spy)
    splits = [holdout.Holdout(f"hold_{x}", "location", x) for x in ("a", "b")]
    predictions, importances = forest.run_holdouts(table, spec, splits, [1], "id", tune={"folds": 2})
    assert seen == [{"b", "c"}, {"a", "c"}]
    assert predictions.count() == 60 and importances.count() == 4


def test_many_tied_donors_are_all_used(spark):
    donors = spark.createDataFrame([(k, 1.0, float(k)) for k in range(200)], "id long, prediction double, observed double")
    recipients = spark.createDataFrame([(1000 + k, 1.0) for k in range(300)], "id long, prediction double")
    got = impute.match_donors(donors, recipients, "id", "prediction", "observed", k=5).collect()
    assert len(got) == 300 and len({r["observed"] for r in got}) > 100


@pytest.fixture(scope="module")
def tuning_table(spark):
    rows = [(k, i, ["a", "b", "c", None][k % 4], "yes" if (k * 7) % 5 < 2 else None if k % 13 == 0 else "no", float(k % 11), float(k % 7))
            for k in range(120) for i in (1, 2)]
    return spark.createDataFrame(rows, "id int, imp int, location string, target string, x double, y double")


def test_no_held_out_row_enters_the_tuning(spark, tuning_table, monkeypatch, tmp_path):
    fits, grow = [], forest.fit_forest

    def spy(rows, spec):
        weights = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.first("weight").alias("w")).collect()}
        fits.append(({r["row_id"] for r in rows.collect()}, spec.mtry, spec.min_n, weights))
        return grow(rows, spec)

    monkeypatch.setattr(forest, "fit_forest", spy)
    spec = forest.ForestSpec("target", ("x", "y"), positive="yes", trees=2, max_depth=3)
    splits = [holdout.Holdout(f"hold_{x}", "location", x) for x in ("a", "b")]
    options = dict(grid=[(1, 2), (2, 8)], folds=2, repeats=1, at_once=1, path=str(tmp_path / "fits"))
    chosen, metrics = forest.tune_holdouts(tuning_table, spec, splits, [1, 2], "id", **options)
    known = {r["id"]: r["location"] for r in tuning_table.filter("target IS NOT NULL").collect()}
    assert len(fits) == 2 * 2 * 2 * 2 and metrics.count() == 16
    for place, (ids, mtry, min_n, _) in enumerate(fits):
        allowed = {"b", "c"} if place < 8 else {"a", "c"}
        assert {known[i] for i in ids} == allowed and (mtry, min_n) in [(1, 2), (2, 8)]
    halves = fits[0][0], fits[2][0]
    assert not halves[0] & halves[1] and halves[0] | halves[1] == {i for i, x in known.items() if x in ("b", "c")}
    yes = tuning_table.filter("imp = 1 AND location IN ('b', 'c')").groupBy("target").count().collect()
    sizes = {r["target"]: r["count"] for r in yes}
    assert fits[0][3][1.0] * sizes["yes"] == pytest.approx(fits[0][3][0.0] * sizes["no"])
    assert set(chosen) == {"hold_a", "hold_b"} and set(chosen.values()) <= {(1, 2), (2, 8)}
    for name, pair in chosen.items():
        means = {(r["mtry"], r["min_n"]): r["v"] for r in metrics.filter(F.col("model") == name).groupBy("mtry", "min_n").agg(
            F.avg("value").alias("v")).collect()}
        assert means[pair] == max(means.values())
    fits.clear()
    again, same = forest.tune_holdouts(tuning_table, spec, splits, [1, 2], "id", **options)
    assert not fits and again == chosen and sorted(same.collect()) == sorted(metrics.collect())


def test_chosen_parameters_reach_the_fits(spark, tuning_table, monkeypatch):
    used, grow = [], forest.fit_forest
    monkeypatch.setattr(forest, "fit_forest", lambda rows, spec: used.append((spec.mtry, spec.min_n)) or grow(rows, spec))
    spec = forest.ForestSpec("target", ("x", "y"), positive="yes", trees=2, max_depth=3)
    splits = [holdout.Holdout(f"hold_{x}", "location", x) for x in ("a", "b")]
    forest.run_holdouts(tuning_table, spec, splits, [1], "id", at_once=1, chosen={"hold_a": (1, 9)})
    assert used == [(1, 9), (None, 2)]


def test_tuning_without_rows_is_an_error(spark, tuning_table):
    spec = forest.ForestSpec("target", ("x", "y"), positive="yes", trees=2)
    with pytest.raises(ValueError, match="no results"):
        forest.tune_holdouts(tuning_table.limit(0), spec, [holdout.Holdout("h", "location", "a")], [1], "id", grid=[(1, 2)], folds=2, repeats=1)
