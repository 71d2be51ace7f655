"""The study's chains on small files shaped like its inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnkit.models.forest import ForestSpec
from tarnkit.sources import csv
from tarnkit.study import names as N
from tarnkit.study import predict, prepare, reports

SITES = ["Banook 1", "Tower Road", "Kearney", "Elsewhere"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Weekly samples at four sites over two years and daily weather of two stations, as CSV."""
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("raw")
    weather = folder / "weather"
    weather.mkdir()
    for name in ("MONCTON", "HALIFAX"):
        lines = ["Station Name,Date/Time,Year,Month,Day,Max Temp (C),Min Temp (C),Mean Temp (C),Total Precip (mm),Total Precip Flag,Data Quality"]
        for year in (2022, 2023):
            day = dt.date(year, 3, 25)
            while day < dt.date(year, 11, 1):
                t = rng.uniform(5, 25)
                rain = "NA" if rng.random() < 0.05 else f"{rng.uniform(0, 9):.1f}"
                row = f"{name} A,{day},{day.year},{day.month},{day.day},{t + 4:.1f},{t - 4:.1f},{t:.1f},{rain},,"
                lines += [row] * (2 if day.day == 1 else 1)
                day += dt.timedelta(days=1)
        (weather / f"en_climate_{name}.csv").write_text("\n".join(lines) + "\n")
    (weather / "readme.csv").write_text("nothing\n1\n")
    water = [c for c in N.WATER]
    header = ["id", "sample", "location", "sample_date", "sample_time", "year", "week", "grab_mclr", "passive_mclr",
              "spe_grab_mclr", "grab_mclr_lod", "passive_mclr_lod", "spe_grab_mclr_lod", *N.GENES,
              *[f"lod_{g}" for g in N.GENES], *water, "dn", "phosphate", "rdl_phosphate", "rdl_chloride", "ul_p"]
    lines, number = [",".join(header)], 0
    for site in SITES:
        for year in (2022, 2023):
            for week in range(20, 40):
                number += 1
                day = dt.date(year, 1, 3) + dt.timedelta(weeks=week)
                mcye = 10 ** rng.uniform(0, 5)
                passive = "NA" if rng.random() < 0.1 else f"{(2.0 if rng.random() < min(0.95, mcye / 3e4) else 0.1):.2f}"
                grab = "NA" if rng.random() < 0.3 else f"{rng.choice([0.05, 0.05, 0.4])}"
                fields = [number, "s", site, day, "10:00", year, week, grab, passive, "0.3", "0.1", "0.5", "0.05",
                          f"{rng.uniform(1, 9):.2f}", f"{mcye:.2f}", f"{rng.uniform(1, 9):.2f}", f"{mcye * 20:.2f}",
                          "2", "5", "2", "3", *[("NA" if rng.random() < 0.08 else f"{rng.uniform(1, 30):.2f}") for _ in water],
                          "1.0", "NA" if rng.random() < 0.7 else "3.0", "1.0", "2.0", "900"]
                lines.append(",".join(map(str, fields)))
    (folder / "samples.csv").write_text("\n".join(lines) + "\n")
    return csv.read_csv(spark, str(folder / "samples.csv")), csv.read_many(spark, str(weather), "en_climate*.csv")


@pytest.fixture(scope="module")
def weather(raw):
    return prepare.trailing_weather(prepare.compile_weather(raw[1])).cache()


@pytest.fixture(scope="module")
def table(raw, weather):
    return prepare.analysis_table(raw[0], weather).cache()


def test_weather_is_one_row_per_station_and_day_in_season(raw, weather):
    compiled = prepare.compile_weather(raw[1])
    assert set(compiled.columns) == {"station_name", "date_time", "max_temp_c", "min_temp_c", "mean_temp_c", "total_precip_mm", "region"}
    assert compiled.groupBy("station_name", "date_time").count().filter("count > 1").count() == 0
    assert compiled.agg(F.min(F.month("date_time"))).first()[0] == 4
    assert {r["region"] for r in compiled.select("region").distinct().collect()} == {"nb", "ns"}
    assert weather.filter("temp_7d_mean is null").count() == 12 and weather.filter("precip_3d_sum is null").count() == 4


def test_analysis_table(raw, table):
    assert {r["location"] for r in table.select("location").distinct().collect()} == {"Lake Banook 1", "Tower Road Reservoir", "Kearney Lake"}
    assert table.count() == 120 and "phosphate" not in table.columns and "rdl_phosphate" not in table.columns
    assert not {"dn", "region", "spe_grab_mclr"} & set(table.columns) and "spe_mclr_lod" in table.columns
    assert table.columns[-1].startswith("rdl") and table.filter("grab_mclr is null").count() == 0
    assert table.filter("mean_temp_c is null").count() == 0


def test_repeated_weather_keys_are_an_error(raw, weather):
    with pytest.raises(ValueError, match="repeated"):
        prepare.analysis_table(raw[0], weather.unionByName(weather))


def test_reports(table):
    by_site, by_year = reports.chemistry_tables(table)
    assert by_site.count() == 3 and by_year.count() == 6
    assert by_site.columns == ["location", *[f"median_{c}" for c in N.TABLE_COLUMNS], *[f"sd_{c}" for c in N.TABLE_COLUMNS]]
    tests, pairs = reports.site_tests(table)
    assert {r["df"] for r in tests.collect()} == {2} and pairs.count() == 6 * 3
    found = reports.site_detections(table).collect()
    assert [r["n_detections"] for r in found] == sorted((r["n_detections"] for r in found), reverse=True)
    assert any(r["label"].startswith("TRR<br>(") for r in found)
    assert {r["name"] for r in reports.detection_correlations(table).collect()} == {"p_ugl", "tn_ugl", "colour", "toc_mgl", "tn_tp_ratio"}
    assert reports.grab_and_passive(table).count() == 6
    levels = reports.gene_levels(table)
    assert levels.filter("mcye_ndaf < 0").count() == 0


def test_forests_from_imputed_stack(table):
    short = table.drop(*[c for c in N.WATER if c not in ("p", "tn", "toc", "chloride")], *[c for c in N.WEATHER if c not in ("mean_temp_c",)])
    stacked = predict.imputed_stack(short, "id", imputations=2, sweeps=1, trees=4, depth=3)
    assert stacked.count() == 240
    features = ("p", "tn", "toc", "mcye_ndaf", "total_cyano", "mean_temp_c", "tn_tp_ratio", "lag_mcye", "lag_tc")
    rows = predict.forest_table(stacked)
    assert stacked.filter(" or ".join(f"{c} is null" for c in features if c in stacked.columns)).count() == 0
    assert rows.filter("lag_mcye is null").count() == 6
    report = predict.forest_report(
        rows, ForestSpec("truth", features, trees=6, mtry=3, max_depth=4), predict.study_holdouts(["Kearney Lake"], 2023), [1, 2], "id",
        tune={"grid": [(2, 2), (3, 5)], "folds": 2, "repeats": 1}, min_threshold=0.0, min_detections=3, top_n=4,
    )
    assert report["tuning"].count() == 2 * 2 * 2 * 2
    assert 4 <= report["importance"].count() < len(features)
    auc = {r["model"]: r for r in report["auc"].collect()}
    assert set(auc) == {"full_test_2023", "full_test_kearney_lake"} and auc["full_test_kearney_lake"]["location"] == "Kearney Lake"
    assert all(r["auc"] > 0.5 for r in auc.values())
    assert {r["model_type"] for r in report["importance"].collect()} == {"Tested on Location"}
    assert report["roc"].filter("sensitivity < 0 or sensitivity > 1").count() == 0


def test_thresholds_from_the_detection_model(table):
    rows, constants = predict.model_table(table)
    assert rows.filter("passive_mclr_binary is null").count() == 0 and rows.filter("cens_lag_mcye is null").count() == 0
    scored = rows.agg(F.avg("s_mcye").alias("m")).first()["m"]
    assert abs(scored) < 0.3
    summary, means = predict.threshold_curves(rows, constants, "id", replicates=3, weeks=3, levels=20)
    got = summary.collect()
    assert len(got) == 6 * 3 * 3 and means.count() == 6 * 3 * 20
    span = rows.agg(F.min("mcye"), F.max("mcye")).first()
    assert all(span[0] - 1e-9 <= r["median"] <= span[1] + 1e-9 and r["q25"] <= r["median"] <= r["q75"] for r in got)
