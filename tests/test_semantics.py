"""Missing values, division, recoding and dates."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions import dates, semantics as S


def column(spark, schema, rows, **expressions):
    df = spark.createDataFrame(rows, schema)
    return [row.asDict() for row in df.select(*[e.alias(n) for n, e in expressions.items()]).collect()]


def test_if_else_keeps_null(spark):
    got = column(spark, "c boolean", [(True,), (False,), (None,)], v=S.if_else3(F.col("c"), F.lit(1), F.lit(0)))
    assert [r["v"] for r in got] == [1, 0, None]


def test_division_by_zero(spark):
    got = column(spark, "a double, b double", [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0)], v=S.divide("a", "b"))
    assert [r["v"] for r in got] == [math.inf, -math.inf, None, 1.5, None]


def test_nan_becomes_null_before_median_and_comparison(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    clean = S.nan_to_null(df)
    assert clean.agg(F.median("x")).first()[0] == 1.5
    assert [r[0] for r in clean.select(C.detected("x", F.lit(1.5))).collect()] == [False, True, None]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.agg(S.sum0("x")).first()[0] == 0


def test_log10_of_zero(spark):
    got = column(spark, "x double", [(0.0,), (100.0,), (-1.0,), (None,)], v=S.log10("x"))
    assert [r["v"] for r in got] == [-math.inf, 2.0, None, None]


def test_recode_keeps_unmatched_and_null(spark):
    got = column(spark, "x string", [("a",), ("b",), (None,)], v=S.recode("x", {"a": "A"}), o=S.level_order("x", ["b", "c"]))
    assert [r["v"] for r in got] == ["A", "b", None]
    assert [r["o"] for r in got] == [None, 1, None]


def test_paste_prints_missing_and_interaction_does_not(spark):
    got = column(spark, "a string, b int", [("x", 1), ("x", None)], p=S.paste("a", "b", sep=" / "), i=S.interaction("a", "b"))
    assert [r["p"] for r in got] == ["x / 1", "x / NA"]
    assert [r["i"] for r in got] == ["x.1", None]


def test_later_columns_see_earlier_ones(spark):
    df = S.in_order(spark.createDataFrame([(100.0,)], "x double"), x=F.log10("x"), y=F.col("x") * 10)
    assert tuple(df.first()) == (2.0, 20.0)


def test_filter_drops_only_definite_matches(spark):
    df = spark.createDataFrame([("p", 300.0), ("p", None), ("q", 300.0)], "name string, value double")
    assert df.filter(S.keep_unless((F.col("name") == "p") & (F.col("value") > 250))).count() == 2


@pytest.mark.parametrize("value,flag,cens,at_limit", [(5.0, True, "none", 5.0), (2.0, False, "left", 2.0), (1.0, False, "left", 2.0), (None, None, "none", None)])
def test_censoring_rules(spark, value, flag, cens, at_limit):
    got = column(spark, "x double", [(value,)], d=C.detected("x", F.lit(2.0)), c=C.censoring("x", F.lit(2.0)), s=C.at_least_limit("x", F.lit(2.0)))[0]
    assert (got["d"], got["c"], got["s"]) == (flag, cens, at_limit)


def test_inclusive_detection_and_labels(spark):
    got = column(spark, "x double", [(2.0,), (None,)], d=C.detected("x", F.lit(2.0), inclusive=True), l=C.detection_label("x", F.lit(2.0)))
    assert [(r["d"], r["l"]) for r in got] == [(True, "not_detected"), (None, None)]


def test_ratios_and_copies(spark):
    got = column(
        spark, "tn double, p double, toc double", [(0.28, 31.0, 2.4)],
        a=C.nitrogen_phosphorus("tn", "p"), b=C.carbon_nitrogen("toc", "tn"), c=C.carbon_phosphorus("toc", "p"),
        g=C.gene_copies(F.lit(9.0), F.lit(100.0), F.lit(50.0)),
    )[0]
    assert got["a"] == pytest.approx(20.0) and got["b"] == pytest.approx(10.0)
    assert got["c"] == pytest.approx(200.0) and got["g"] == 18.0


def test_iso_weeks_and_seasons(spark):
    rows = [(dt.date(2021, 1, 1),), (dt.date(2024, 2, 29),), (dt.date(2023, 7, 4),)]
    got = column(spark, "d date", rows, y=dates.iso_year("d"), w=dates.iso_week("d"), s=dates.season_date("d", 2022), l=dates.season_date("d", 2024))
    assert (got[0]["y"], got[0]["w"]) == (2020, 53)
    assert [r["s"] for r in got] == [dt.date(2022, 1, 1), None, dt.date(2022, 7, 4)]
    assert got[1]["l"] == dt.date(2024, 2, 29)


def test_week_to_date(spark):
    got = column(spark, "w double", [(0.0,), (40.0,), (1.5,)], d=dates.week_to_date("w"))
    assert [r["d"] for r in got] == [dt.date(2023, 1, 1), dt.date(2023, 10, 8), dt.date(2023, 1, 11)]
