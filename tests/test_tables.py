"""Selectors, cleaning, reshaping, joins, summaries, detections and files."""

import pytest
from pyspark.sql import functions as F

from tarnkit.operators import cleaning, detections, joins, reshape, selectors, summaries
from tarnkit.sources import csv, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_clean_names():
    names = ["Station Name", "Date/Time", "Max Temp (°C)", "Total Precip (mm)", "maxTempC", "2nd", "Year"]
    assert [selectors.snake_case(n) for n in names] == [
        "station_name", "date_time", "max_temp_c", "total_precip_mm", "max_temp_c", "x2nd", "year"
    ]


def test_clean_names_makes_repeats_unique(spark):
    df = spark.createDataFrame([(1, 2)], ["Max Temp", "maxTemp"])
    assert selectors.clean_names(df).columns == ["max_temp", "max_temp_2"]


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, 4.0)], "id int, temp double, name string, rdl_p double, lod_p double")
    assert selectors.column_names(df, selectors.numeric(), exclude=["id", selectors.contains("rdl", "lod")]) == ["temp"]
    assert selectors.column_names(df, selectors.between("temp", "rdl_p")) == ["temp", "name", "rdl_p"]
    assert selectors.column_names(df, selectors.any_of(["lod_p", "absent"])) == ["lod_p"]
    assert selectors.column_names(df, selectors.matches("^rdl_")) == ["rdl_p"]
    with pytest.raises(KeyError):
        selectors.select_cols(df, "absent")
    moved = selectors.relocate(df, selectors.contains("rdl"), last=True)
    assert moved.columns == ["id", "temp", "name", "lod_p", "rdl_p"]
    assert selectors.relocate(df, "name", after="id").columns[:2] == ["id", "name"]
    assert selectors.rename(df, {"t": "temp"}).columns[1] == "t"


def test_missing_fraction_in_blocks_and_sparse_columns(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, None, 9.0), (2, None, None, None, 9.0), (3, 5.0, 2.0, None, 9.0)],
        "id int, al double, p double, spe double, rdl_al double",
    )
    got = dict(rows(cleaning.missing_fraction(df, ["al", "p", "spe"], per=2), "name", "prop_missing"))
    assert got == {"al": pytest.approx(2 / 3), "p": pytest.approx(1 / 3), "spe": 1.0}
    kept = cleaning.drop_sparse_columns(df, ["al", "p", "spe"], 0.4, exempt="spe")
    assert kept.columns == ["id", "p", "spe"]


def test_unique_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(cleaning.key_violations(df, ["k"]), "k", "n") == [("a", 2)]
    with pytest.raises(ValueError, match="repeated"):
        cleaning.verify_unique(df, ["k"])
    assert cleaning.verify_unique(df.distinct(), ["k"]).count() == 2


def test_longer_keeps_missing_and_wider_undoes_it(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    long = reshape.longer(df, ["id"])
    assert long.count() == 4
    wide = reshape.wider(long, ["id"], "name", ["a", "b"], {"": F.first("value", ignorenulls=True)})
    assert rows(wide, "id", "a", "b") == rows(df, "id", "a", "b")


def test_wider_with_several_statistics_glues_names(spark):
    df = spark.createDataFrame([("s", "p", 1.0), ("s", "p", 3.0), ("s", "q", 5.0)], "g string, name string, value double")
    wide = reshape.wider(df, ["g"], "name", ["p", "q"], {"max": F.max("value"), "n": F.count("value")})
    assert wide.columns == ["g", "max_p", "max_q", "n_p", "n_q"]
    assert tuple(wide.first()) == ("s", 3.0, 5.0, 2, 1)


def test_longer_paired_and_split(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 6.0)], "id int, grab_value double, grab_lod double, passive_value double")
    long = reshape.longer_paired(df, ["id"])
    assert rows(long, "method", "value", "lod") == [("grab", 5.0, 2.0), ("passive", 6.0, None)]
    parts = reshape.split_in_two(spark.createDataFrame([("A - B",)], "c string"), "c", ["x", "y"], " - ")
    assert tuple(parts.first()) == ("A", "B")


def test_joins_match_missing_keys_only_on_request(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    assert rows(joins.equi_join(left, right, "k"), "v", "w") == [(1, 10), (2, None)]
    assert rows(joins.equi_join(left, right, "k", null_safe=True), "v", "w") == [(1, 10), (2, 20)]
    named = right.withColumnRenamed("k", "other")
    assert joins.equi_join(left, named, {"k": "other"}, "inner").columns == ["k", "v", "w"]


def test_lookup_is_broadcast_only_when_counted_small(spark):
    big, look = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    small = joins.lookup_join(big, look.withColumn("w", F.lit(1)), "k", rows=50)
    large = joins.lookup_join(big, look.withColumn("w", F.lit(1)), "k", rows=49)
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (small, large)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert not joins.fits_broadcast(look.withColumn("t", F.repeat(F.lit("x"), 1000)), 50, size=10_000)
    assert small.filter("w = 1").count() == large.filter("w = 1").count() == 50


def test_flags_grids_stacks_and_sets(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "v string")
    right = spark.createDataFrame([("b",), ("b",), ("c",)], "v string")
    assert rows(joins.flag_matching(left, right, "v", "hit"), "v", "hit") == [("a", False), ("b", True), ("b", True)]
    assert joins.keep_matching(left, right, "v").count() == 2
    assert rows(joins.common_values(left, right), "v") == [("b",)]
    assert rows(joins.values_only_in(left, right), "v") == [("a",)]
    grid = joins.expand_grid(left.distinct(), x=[1, 2, 3], y=joins.even_steps(F.lit(0.0), F.lit(1.0), 5))
    assert grid.count() == 30 and grid.agg(F.max("y")).first()[0] == 1.0
    stacked = joins.stack({"l": left, "r": right.withColumn("w", F.lit(1))}, "source")
    assert stacked.columns == ["source", "v", "w"] and stacked.count() == 6


@pytest.mark.parametrize("largest,expected", [(True, [9, 9, 9]), (False, [1, 2])])
def test_top_keeps_ties(spark, largest, expected):
    df = spark.createDataFrame([("g", v) for v in (9, 9, 9, 5, 1, 2, None)], "g string, v int")
    got = summaries.top_with_ties(df, ["g"], "v", 2, largest)
    assert sorted(r["v"] for r in got.collect()) == expected
    assert sorted(r["v"] for r in summaries.top_with_ties(df, [], "v", 2, largest).collect()) == expected


def test_chemistry_table_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.04, None), ("a", 2.0, None), ("b", 7.0, 3.0)], "g string, p double, q double")
    got = {r["g"]: r.asDict() for r in summaries.chemistry_table(df, ["g"], ["p", "q"]).collect()}
    assert got["a"]["median_p"] == 1.5 and got["a"]["median_q"] is None and got["a"]["sd_q"] is None
    assert got["b"]["sd_p"] is None and got["b"]["median_q"] == 3.0


def test_rescale_and_percent_of_max(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", None)], "g string, v double")
    scaled = {(r["g"], r["v"]): r["s"] for r in summaries.rescale(df, "v", {"s": (0.4, 1)}).collect()}
    assert scaled["a", 2.0] == 0.4 and scaled["a", 4.0] == 1.0 and scaled["b", None] is None
    percent = {(r["g"], r["v"]): r["p"] for r in summaries.percent_of_max(df, ["g"], "v", "p").collect()}
    assert percent["a", 2.0] == 50.0 and percent["b", 3.0] == 100.0


def test_paired_detections(spark):
    data = [  # site, day, grab, passive
        ("s", 1, 0.0, 9.0), ("s", 2, 0.0, None), ("s", 3, 9.0, 0.0), ("s", 4, 9.0, 9.0), ("s", 5, None, 9.0), ("t", 1, 9.0, 9.0),
    ]
    df = spark.createDataFrame(data, "site string, day int, grab double, passive double").withColumn("lod", F.lit(1.0))
    got = detections.paired_detections(df, ["site"], "day", ("grab", "lod"), ("passive", "lod"), pieces=3)
    assert rows(got, "site", "n_detects", "same_week", "prev_week", "two_weeks") == [("s", 2, 1, 0, 1), ("t", 1, 1, 0, 0)]
    summary = detections.detection_summary(df, ["site"], "passive", "lod")
    assert rows(summary, "site", "label", "detection_rate") == [("s", "3 / 4", 0.75), ("t", "1 / 1", 1.0)]
    assert rows(detections.groups_with_detections(df, ["site"], "grab", "lod", 2), "site") == [("s",)]


def test_csv_round_trip_with_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, None)], "id int, v double, s string")
    csv.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert "2,NA,NA" in text
    back = csv.read_csv(spark, str(tmp_path / "out"))
    assert rows(back, "id", "v", "s") == rows(df, "id", "v", "s")
    typed = csv.read_csv(spark, str(tmp_path / "out"), "id int, v double, s string")
    assert rows(typed, "id", "v", "s") == rows(df, "id", "v", "s")


def test_many_files_by_name(spark, tmp_path):
    (tmp_path / "en_climate_a.csv").write_text("station,t\nA,1.0\nA,NaN\n")
    (tmp_path / "en_climate_b.csv").write_text("station,t\nB,NA\n")
    (tmp_path / "notes.csv").write_text("other\nx\n")
    (tmp_path / "extra.csv").write_text("station,rain\nC,4\n")
    df = csv.read_many(spark, str(tmp_path), "en_climate*.csv", "station string, t double", "file")
    assert rows(df, "station", "t", "file") == [
        ("A", 1.0, "en_climate_a.csv"), ("A", None, "en_climate_a.csv"), ("B", None, "en_climate_b.csv")
    ]
    mixed = csv.read_layouts(spark, [str(tmp_path / "en_climate_a.csv"), str(tmp_path / "extra.csv")])
    assert mixed.columns == ["station", "t", "rain"] and mixed.count() == 3


def test_saved_table_prunes_partitions(spark, tmp_path):
    df = spark.range(20).withColumn("imp", (F.col("id") % 4).cast("int"))
    saved = tables.save_table(df, str(tmp_path / "t"), ["imp"])
    assert saved.count() == 20
    one = tables.load_table(spark, str(tmp_path / "t"), imp=2)
    assert one.count() == 5
    assert "PartitionFilters: [isnotnull(imp" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_read_many_by_name(spark, tmp_path):
    (tmp_path / "en_climate_1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "en_climate_2.csv").write_text("b,a\n4,3\n")
    (tmp_path / "en_climate_3.csv").write_text("a,b,c\n5,6,7\n")
    rows = csv.read_many(spark, str(tmp_path), "en_climate*.csv").orderBy("a").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(1, 2, None), (3, 4, None), (5, 6, 7)]
    typed = csv.read_many(spark, str(tmp_path), "en_climate*.csv", "a double, b int", "file").orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in typed] == [(1.0, 2), (3.0, 4), (5.0, 6)] and typed[1]["file"] == "en_climate_2.csv"


def test_save_table_spreads_a_hot_key_over_few_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id % 7 ELSE 1 END AS key").repartition(16)
    tables.save_table(df, str(tmp_path / "t"), ["key"], files_per_key=3)
    files = {k: len(list((tmp_path / "t" / f"key={k}").glob("*.parquet"))) for k in range(7)}
    assert max(files.values()) <= 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_save_table_gives_a_hot_key_writers_by_its_size(spark, tmp_path):
    df = spark.range(300_000).selectExpr("repeat('same', 20) AS text", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 200 + 1 END AS key").repartition(16)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        saved = tables.save_table(df, str(tmp_path / "t"), ["key"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {k: len(list((tmp_path / "t" / f"key={k}").glob("*.parquet"))) for k in range(201)}
    assert saved.count() == 300_000 and files[0] > 2  # equal rows, too
    assert sum(files.values()) < 16 * 201 / 2
