"""All bootstrap replicates at once, against one Spark ML fit a replicate."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnkit.models import bootstrap, detection


def table(spark, rows=900, sites=7, seed=3):
    draw = random.Random(seed)
    data = []
    for k in range(rows):
        site, year, week, x = draw.randrange(sites), 2021 + draw.randrange(3), draw.randrange(1, 53), draw.gauss(0, 1)
        logit = -0.4 + 0.3 * (site - 3) + 0.2 * (year - 2022) + 0.8 * x + math.sin(week / 8)
        known = draw.random() < 0.95
        data.append((k, f"s{site}", year, float(week), x if draw.random() < 0.97 else None, (draw.random() < 1 / (1 + math.exp(-logit))) if known else None))
    return spark.createDataFrame(data, "id long, location string, year int, week double, x double, found boolean")


def test_weights_equal_those_of_spark(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("h"), *[detection.poisson_weight("id", 1543 + b).alias(f"w{b}") for b in range(3)]).collect()
    got = bootstrap.poisson_weights(np.array([r["h"] for r in rows]), np.array([1543, 1544, 1545]))
    assert got.tolist() == [[r[f"w{b}"] for b in range(3)] for r in rows]


@pytest.fixture(scope="module")
def fitted(spark):
    df = table(spark).persist()
    return df, bootstrap.bootstrap_coefficients(df, "id", F.col("found"), "location", "year", "week", "x", 3)


def test_equal_to_one_fit_a_replicate(spark, fitted):
    df, found = fitted
    assert found.passes <= 10
    rows = detection.with_season(df, "week").withColumn("_label", F.col("found").cast("double")).dropna(subset=["_label", "x"])
    by_location = {r["location"]: r for r in found.by_location.collect()}
    effects, common = {r["year"]: r["effect"] for r in found.by_year.collect()}, found.by_location.first()
    for b in range(3):
        pipeline = detection.detection_pipeline("location", "year", "x", 0.01)
        pipeline.getStages()[-1].setTol(1e-13).setMaxIter(2000)
        model = pipeline.fit(rows.withColumn("_weight", detection.poisson_weight("id", 1543 + b)))
        places, years = (t.collect() for t in detection.coefficient_tables(spark, [model]))
        for r in places:
            got = by_location[r[1]]
            assert (got["base"][b], got["slope"][b]) == pytest.approx((r[2], r[3]), abs=1e-6)
            assert [common[c][b] for c in bootstrap.SEASON] == pytest.approx(list(r[4:8]), abs=1e-6)
        for r in years:
            assert effects[r["_year"]][b] == pytest.approx(r["_effect"], abs=1e-6)


def test_pieces_blocks_and_merges_give_the_same(spark, fitted, monkeypatch):
    df, found = fitted
    for name, value in (("BLOCK", 2), ("PIECE_ROWS", 20), ("CHUNK", 7), ("FAN", 3)):
        monkeypatch.setattr(bootstrap, name, value)
    again = bootstrap.bootstrap_coefficients(df, "id", F.col("found"), "location", "year", "week", "x", 3)
    one, two = ({r["location"]: r for r in x.by_location.collect()} for x in (found, again))
    for name, r in one.items():
        assert two[name]["base"] == pytest.approx(r["base"], abs=1e-8) and two[name]["slope"] == pytest.approx(r["slope"], abs=1e-8)


def test_small_and_large_locations_together_give_the_same(spark, fitted, monkeypatch):
    df, found = fitted
    sizes = [r["count"] for r in df.dropna().groupBy("location").count().collect()]
    monkeypatch.setattr(bootstrap, "PIECE_ROWS", 10 * sorted(sizes)[3])
    assert min(sizes) <= bootstrap.PIECE_ROWS // 10 < max(sizes)
    again = bootstrap.bootstrap_coefficients(df, "id", F.col("found"), "location", "year", "week", "x", 3)
    one, two = ({r["location"]: r for r in x.by_location.collect()} for x in (found, again))
    for name, r in one.items():
        assert two[name]["base"] == pytest.approx(r["base"], abs=1e-8) and two[name]["slope"] == pytest.approx(r["slope"], abs=1e-8)


def test_nothing_by_small_location_is_merged_or_stored_in_a_pass(spark, monkeypatch):
    keys, plain = [], bootstrap.merged
    monkeypatch.setattr(bootstrap, "merged", lambda parts, by, count: keys.append(by) or plain(parts, by, count))
    bootstrap.bootstrap_coefficients(table(spark, rows=300, sites=40), "id", F.col("found"), "location", "year", "week", "x", 3)
    assert keys and all(k == ["block"] for k in keys)


def test_own_terms_settle_where_shared_terms_are_far_off():
    rows = np.column_stack([np.ones(6), np.ones(6), np.zeros((6, 4)), [0.1, -2, 3, 50, 0, 1]])
    shared = np.array([[-9.0, 0, 0, 0, 0, 0, 0.0]])
    one = bootstrap.Profile(rows, np.array([0, 4]), np.ones(6), np.ones((1, 6)), shared, np.array([1e-4]))
    one.settle(1e-9)
    assert np.isfinite(one.own).all() and np.abs(one.step).max() < 1e-9


def test_thousands_of_replicates_in_few_passes(spark):
    df = table(spark, rows=300, sites=3)
    found = bootstrap.bootstrap_coefficients(df, "id", F.col("found"), "location", "year", "week", "x", 4000)
    assert found.passes <= 10
    row = found.by_location.orderBy("location").first()
    assert len(row["base"]) == 4000 and all(map(math.isfinite, row["base"]))
    spread = np.std(row["base"])
    assert 0.05 < spread < 1.5


def test_draws_on_the_grid(spark, fitted):
    df, found = fitted
    grid = spark.createDataFrame([("s1", 2021, 10.0, 0.5), ("s6", 2023, 30.0, -1.0), ("new", 2021, 1.0, 0.0), ("s1", 1999, 1.0, 0.0)],
                                 "location string, year int, week double, x double")
    rows = bootstrap.draws_of(found, grid, "location", "year", "week", "x").collect()
    assert len(rows) == 12 and sorted({r["draw"] for r in rows}) == [1, 2, 3]
    assert all((r["p"] is None) == (r["location"] == "new" or r["year"] == 1999) for r in rows)
    by_location, effects, common = ({r["location"]: r for r in found.by_location.collect()}, {r["year"]: r["effect"] for r in found.by_year.collect()},
                                    found.by_location.first())
    season = detection.with_season(grid, "week").where("location = 's6'").first()
    one = next(r for r in rows if r["location"] == "s6" and r["draw"] == 2)
    logit = by_location["s6"]["base"][1] - by_location["s6"]["slope"][1] + effects["2023"][1] + sum(common[c][1] * season[f"_{c}"] for c in bootstrap.SEASON)
    assert one["p"] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_draws_of_a_small_grid_are_made_in_many_tasks(spark, fitted):
    _, found = fitted
    grid = spark.createDataFrame([(f"s{k}", 2021, 10.0, 0.5) for k in range(7)], "location string, year int, week double, x double").coalesce(1)
    rows = bootstrap.draws_of(found, grid, "location", "year", "week", "x")
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_score_equations_vanish_at_the_fit_only(spark, fitted):
    df, found = fitted
    args = ("id", F.col("found"), "location", "year", "week", "x")
    rows = bootstrap.score_equations(df, found, *args).collect()
    assert len(rows) == 3 * (2 * 7 + 3 + 6) and max(abs(r["score"]) for r in rows) < 1e-8
    assert max(abs(r["score"]) for r in bootstrap.score_equations(df, found, *args, seed=99).collect()) > 1e-3


def test_a_replicate_of_one_outcome_has_no_fit(spark):
    df = spark.createDataFrame([(k, "a", 2021, float(k), float(k % 3), k == 0) for k in range(12)],
                               "id long, location string, year int, week double, x double, found boolean")
    found = bootstrap.bootstrap_coefficients(df, "id", F.col("found"), "location", "year", "week", "x", 40)
    base = found.by_location.first()["base"]
    weights = bootstrap.poisson_weights(np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()]), 1543 + np.arange(40))
    assert [b is None for b in base] == (weights[0] == 0).tolist() and any(b is None for b in base) and not all(b is None for b in base)


def test_no_complete_rows(spark):
    with pytest.raises(ValueError):
        bootstrap.bootstrap_coefficients(table(spark).where("false"), "id", F.col("found"), "location", "year", "week", "x", 2)
